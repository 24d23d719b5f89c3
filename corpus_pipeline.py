"""From raw documents to token ids: each stage's rows are stored and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgrid.llm import line_dedup, mixing, ngram_join, pieces, toxicity
from snapgrid.llm.common import materialise, session, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic."""
    session(spark)
    return toxicity.score(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others share; n_chars follows the text.  A text that loses nothing is untouched."""
    session(spark)
    found = line_dedup.drop_shared_lines(docs)
    text = F.when(F.size("lines") == F.size("kept"), F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    return found.withColumn("text", text).select(
        *[F.col("text") if name == "text" else F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema[name].dataType).alias(name)
          if name == "n_chars" else F.col(f"row.`{name}`") for name in docs.columns])


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    session(spark)
    return ngram_join.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    session(spark)
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document of the mix, and the text that they decode to."""
    session(spark)
    coded = pieces.round_trip(docs.select("doc_id", "source", "lang", "text"))
    return coded.select("row.doc_id", "row.source", "row.lang", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_join", join_stage),
    ("mixing", mix_stage),
    ("sentencepiece", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
