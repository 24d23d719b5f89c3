"""Dropping lines that many documents share.

Lines are split at ``\\n``, normalised (spaces stripped at both ends, A-Z lowered) and hashed to 128 bits.  A key of at
least ``min_chars`` code points held by at least ``min_docs`` distinct documents loses its lines everywhere except in the
greatest id that holds it.  Only hashes are shuffled to count; the texts move once, to meet their own list of keys,
which is binned so that the work for one text of n lines grows with n to the power 1.5 at most.

Defined cases: a NULL or empty text is one empty line; rows that share an id are one document; rows without an id are one
document, below all others; an empty table gives no rows; a document may lose all its lines and then has an empty text;
other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgrid.llm.common import SPACES, sha256_hex, table, text_or_empty

MIN_CHARS = 20
MIN_DOCS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normalised(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACES))
    plain = F.octet_length(bare) == F.char_length(bare)  # ASCII only: lower() then changes A-Z alone, and is faster
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _key(line: Column, min_chars: int) -> Column:
    """Hash of the normalised line, NULL where it is too short to count."""
    def hashed(bare: Column) -> Column:
        return F.when(F.char_length(bare) >= min_chars,
                      F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("second"), bare).alias("b")))
    return F.element_at(F.transform(F.array(_normalised(line)), hashed), 1)


def _bins(keys: Column) -> Column:
    """The keys in as many bins as the root of their number, so that a look-up in a very long text's list stays short."""
    count = F.ceil(F.sqrt(F.size(keys))).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.filter(keys, lambda k: F.pmod(k["a"], count) == b))


def _binned(bins: Column, key: Column) -> Column:
    return F.array_contains(F.element_at(bins, (F.pmod(key["a"], F.size(bins)) + 1).cast("int")), key)


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                      min_docs: int = MIN_DOCS) -> DataFrame:
    """Each input row as struct ``row``, with ``lines`` (before) and ``kept`` (after), both arrays in the text's order."""
    lines = F.split(text_or_empty(text_col), "\n", -1)
    keys = F.transform(lines, lambda line: _key(line, min_chars))
    held = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.array_compact(keys))).alias("key")).distinct()
    shared = (held.groupBy("key").agg(F.count("*").alias("holders"), F.max("id").alias("keeper"))
              .where(F.col("holders") >= min_docs).select("key", "keeper"))
    losing = (held.join(shared, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
              .groupBy("id").agg(F.collect_list("key").alias("drop")).select("id", _bins(F.col("drop")).alias("drop")))
    rows = docs.select(F.struct("*").alias("row"), lines.alias("lines"), F.col(id_col).alias("row_id"))
    met = rows.join(losing, F.col("row_id").eqNullSafe(F.col("id")), "left")
    keyed = F.transform(F.col("lines"), lambda line: F.struct(line.alias("line"), _key(line, min_chars).alias("key")))
    kept = F.transform(
        F.filter(keyed, lambda x: x["key"].isNull() | ~_binned(F.col("drop"), x["key"])), lambda x: x["line"])
    return met.select("row", "lines", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(kept).alias("kept"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = drop_shared_lines(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        sha256_hex(F.array_join("kept", "\n")).alias("kept_sha256"))


OP4_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, len(lines) AS n_lines, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key
  FROM numbered
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN shared s ON s.key = k.key
)
SELECT doc_id, any_value(n_lines)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
