"""What several operators share: settings, scratch tables, bounded Arrow slices and word hashes.

Words are runs of ``[^\\x20\\x09-\\x0D]``.  Hashes are 64-bit; sets of documents are compared by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgrid.session import configure, scratch_dir

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\t\n\x0b\x0c\r "

# Text rows can be long, so Arrow batches hold few of them.
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
}


def session(spark: SparkSession) -> SparkSession:
    """The session with the settings these operators rely on."""
    configure(spark)
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table below the shared scratch folder and read it back: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sha256_hex(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds ``limit`` bytes of text, or one row that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        ends, start = np.cumsum(sizes + 16), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # workers live on and share the executor's memory


def mixed(values: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix, elementwise."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, dtype=np.uint64)
    if count:
        steps[0] = 1
    return np.multiply.accumulate(steps)


def word_hashes(texts: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    coded = [text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass") for text in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", dtype=np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.diff(np.concatenate(([True], space)).view(np.int8))
    starts, stops = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    back = _powers(_INVERSE, len(data))
    hashes = mixed((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64))
    ends = np.cumsum([len(text) + 1 for text in coded])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
    return hashes, counts


def shingle_hashes(texts: list[str] | list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; a shorter text has one, of all its words."""
    hashes, counts = word_hashes(texts)
    total = len(hashes)
    grams = np.zeros(max(0, total - width + 1), dtype=np.uint64)
    for step in range(width):
        grams = mixed(grams * np.uint64(_BASE) + hashes[step:step + len(grams)])
    out, start = [], 0
    for count in counts:
        if count >= width:
            out.append(np.unique(grams[start:start + count - width + 1]))
        else:
            short = np.zeros(min(1, count), dtype=np.uint64)
            for value in hashes[start:start + count]:
                short = mixed(short * np.uint64(_BASE) + value)
            out.append(short)
        start += count
    return out
