"""Sharding by a lookup table that the shards fill in turns (native).

Every shard has its own order of preference over the slots of a prime-sized table.  The shards take turns; each claims
the first slot of its order that is still free, until none is.  A row's key hashes to a slot, and the slot names the shard.
The table has a fixed size, whatever the data, so broadcasting it is bounded.  Dropping a shard moves few rows of the others.

Defined cases: a NULL key hashes like the empty text; equal keys share a shard; an empty table gives no rows; other
columns of the input are kept as they are, and the added columns replace none (see ``place``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from snapgrid.llm.common import sha256_hex, table
from snapgrid.session import scratch_dir

SLOTS = 65_537  # prime
SHARDS = tuple(f"shard-{number:03d}" for number in range(64))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the position of its shard in ``shards``."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, at least one")
    if slots < len(shards) or any(slots % factor == 0 for factor in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("the number of slots must be a prime, at least the number of shards")
    # offset and stride walk through all slots, as the table's size is prime
    at = [_number(f"offset {name}") % slots for name in shards]
    stride = [_number(f"stride {name}") % (slots - 1) + 1 if slots > 2 else 1 for name in shards]
    owner, free = [-1] * slots, slots
    while free:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + stride[shard]) % slots
            owner[at[shard]] = shard
            free -= 1
            if not free:
                break
    return owner


def table_of(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """The lookup table as rows (slot, shard)."""
    rows = [(slot, shards[owner]) for slot, owner in enumerate(lookup_table(shards, slots))]
    return spark.createDataFrame(rows, "slot int, shard string")


def slot_of(key: str, slots: int = SLOTS):
    """Slot of a column: the first 60 bits of the MD5 digest of its text, modulo the table's size."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.lit(slots)


def place(docs: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS,
          shard_col: str = "shard") -> DataFrame:
    """The rows with the shard of each in ``shard_col``, which must be a new name."""
    if shard_col.lower() in (name.lower() for name in docs.columns):
        raise ValueError(f"the input already has a column {shard_col}")
    rows = docs.select(F.struct("*").alias("row"), slot_of(key, slots).cast("int").alias("slot"))
    placed = rows.join(F.broadcast(table_of(docs.sparkSession, shards, slots)), "slot")
    return placed.select("row.*", F.col("shard").alias(shard_col))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> None:
    """Store the rows in one folder per shard; the rebalance hint lets large shards take several files."""
    place(docs, key, shards, slots).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """Whole documents stored by shard; of what is read back, each one's shard, the one it would have without the last, and its text's digest."""
    path = scratch_dir(spark, "shards")
    docs = table(spark, sf_dir, "documents")
    write_shards(docs, path)
    stored = spark.read.schema(StructType([*docs.schema.fields, StructField("shard", StringType())])).parquet(path)
    return place(stored, shards=SHARDS[:-1], shard_col="shard_without_last").select(
        "doc_id", "source", "shard", "shard_without_last", sha256_hex(F.col("text")).alias("text_sha256"))


def _owners(shards: Sequence[str]) -> str:
    return f"string_split('{' '.join(map(str, lookup_table(shards)))}', ' ')"


# The slot from the digest; the tables are the rule's own, listed.
OP3_SQL = f"""
WITH slotted AS (
  SELECT doc_id, source, text, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents
), tables AS (
  SELECT unnest(range({SLOTS})) AS slot, unnest({_owners(SHARDS)}) AS whole, unnest({_owners(SHARDS[:-1])}) AS fewer
)
SELECT doc_id, source, 'shard-' || lpad(whole::VARCHAR, 3, '0') AS shard, 'shard-' || lpad(fewer::VARCHAR, 3, '0') AS shard_without_last,
  sha256(text) AS text_sha256
FROM slotted JOIN tables USING (slot)
"""
