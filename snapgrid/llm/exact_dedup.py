"""Exact duplicates by recipes of content-defined chunks (native).

A text, without its spaces, is cut where its own characters say so, so that equal passages give equal chunks wherever
they stand.  A chunk's identifier is its 64-bit hash and, should different chunks ever share a hash, their rank among
them: all distinct chunks are compared by their bytes once, so equal identifiers mean equal chunks.  A text is then its
ordered list of identifiers, and only these short lists are grouped and joined; long texts move once, cut and
de-duplicated, to be verified.

Defined cases: NULL is the empty text, whose list is empty; texts of spaces only equal it; among equal texts the row
with most code points, then the smallest id stays, an id before none, and one only where rows agree in both; ids may be of any
type that has an order; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgrid.llm.common import SPACE, materialise, sha256_hex, table, text_or_empty

SHORTEST, LONGEST = 256, 4096
SALTS = 16

# A cut stands before two characters of the first set and one of the second.  Each set holds about a quarter of
# frequent Latin letters, and above them blocks of 256 in every 1,024 code points of the basic plane.
_BLOCKS = "".join(f"\\u{start:04X}-\\u{start + 0xFF:04X}" for start in range(0x0400, 0xD800, 0x0400))
_CUT = f"[dhlortDHLORT0369{_BLOCKS}][aeinuyAEINUY1478{_BLOCKS}][cgmnsvCGMNSV258{_BLOCKS}]"


def chunks_of(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The chunks in order; they join to the text."""
    cut = f"(?s).{{{shortest},{longest}}}?(?={_CUT})|(?s).{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def _clashing(chunks: DataFrame) -> DataFrame:
    """(h, chunk, rank) of different chunks under one hash; next to always empty."""
    distinct = chunks.select("h", "chunk").distinct()
    hashes = materialise(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "clashes")
    ranks = Window.partitionBy("h").orderBy("chunk")
    return materialise(chunks.join(hashes, "h", "left_semi").select("h", "chunk").distinct()
                       .withColumn("rank", F.row_number().over(ranks)), "clash-ranks")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            chunk_hash: Callable[[Column], Column] = F.xxhash64, **sizes: int) -> DataFrame:
    """(id, n_chars, text_sha256, recipe): one row per document, the recipe an array of (h, rank)."""
    text = text_or_empty(text_col)
    bare = F.regexp_replace(text, SPACE + "+", "")
    cut = docs.select(F.col(id_col).alias("id"), F.char_length(text).alias("n_chars"), bare.alias("bare"))
    cut = cut.withColumn("chunks", chunks_of(F.col("bare"), **sizes))
    single = cut.select("id", "n_chars", F.explode("chunks").alias("chunk")).select("*", chunk_hash(F.col("chunk")).alias("h"))
    clashes = _clashing(single)
    fields = [F.col("id"), F.col("n_chars"), sha256_hex(F.col("bare")).alias("text_sha256")]
    if clashes.isEmpty():  # every hash stands for one chunk
        steps = F.transform("chunks", lambda c: F.struct(chunk_hash(c).alias("h"), F.lit(0).alias("rank")))
        return cut.select(*fields, steps.alias("recipe"))
    # rows need a name of their own here: the same id may come with several texts
    named = cut.select(*fields, F.col("bare"), F.posexplode_outer("chunks").alias("pos", "chunk"))
    named = named.withColumn("h", chunk_hash(F.col("chunk")))
    ranked = (named.join(clashes.withColumnRenamed("rank", "found"), ["h", "chunk"], "left")
              .withColumn("rank", F.coalesce("found", F.lit(0))))
    step = F.when(F.col("pos").isNotNull(), F.struct("pos", "h", "rank"))
    per_text = ranked.groupBy("id", "n_chars", "text_sha256", "bare").agg(
        F.array_sort(F.collect_set(step)).alias("steps"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("rows"))
    recipe = F.transform("steps", lambda s: F.struct(s["h"].alias("h"), s["rank"].alias("rank")))
    return (per_text.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
            .select("id", "n_chars", "text_sha256", recipe.alias("recipe")))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row."""
    listed = recipes(docs, id_col, text_col, **more).withColumn("row", F.monotonically_increasing_id())
    listed = materialise(listed, "recipes")  # from here on a row's number is fixed
    place = F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("none"), "id", "row")
    groups = listed.groupBy("recipe").agg(F.count("*").alias("size"), F.min(place).alias("best")).where("size > 1")
    # a group meets its rows in SALTS places, so that the copies of one text are not one task's
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = listed.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["recipe", "salt"], "left")
    alone = F.col("size").isNull()
    return met.select("id", F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
                      F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                      (alone | (F.col("row") == F.col("best.row"))).alias("kept"), "text_sha256")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return mark_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP5_SQL = """
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS bare
  FROM documents
), best AS (
  SELECT bare, count(*) AS group_size, first(doc_id ORDER BY n_chars DESC, doc_id) AS keep_id FROM bare GROUP BY bare
)
SELECT b.doc_id, s.keep_id, s.group_size::BIGINT AS group_size, b.doc_id = s.keep_id AS kept, sha256(b.bare) AS text_sha256
FROM bare b JOIN best s ON s.bare = b.bare
"""
