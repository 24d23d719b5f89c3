"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fraction of the hash range, and a text's ``LEAST`` least ones however few lie
there, so the set of a shorter text is kept whole.  Every hash up to a sketch's bound, which the sketch itself tells, is
in it; the share of one sketch found in another, up to the lower of their bounds, estimates containment between texts of
any two lengths.  The sketch of a joined text is the union of sketches up to the lowest bound.  A fingerprint writes the
kept hashes, ascending, in 11 hexadecimal digits each.  Shares of texts of at most ``LEAST`` shingles are exact but for chance agreement
of 44-bit hashes; those of longer texts are estimates.

Defined cases: NULL is the empty text; a text of one to four words has one shingle; only a text without words has an
empty fingerprint; containment of an empty sketch is 1 in an empty one and 0 else, as is that of a sketch without a hash up
to the other's bound; an empty table gives no rows; rows that share an id follow each other in the order of their texts;
NULL ids come last; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgrid.llm.common import session, shingle_hashes, slices, table, text_or_empty

SHINGLE = 5
FRACTION = 1 / 8
LEAST = 512
DIGITS = 11  # of 16
_SHIFT = np.uint64(64 - 4 * DIGITS)
_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def _below(fraction: float) -> int:
    return min(int(fraction * 2.0 ** 64), 2 ** 64 - 1)


def sketches(texts: list[str], fraction: float = FRACTION, shingle: int = SHINGLE, least: int = LEAST) -> list[np.ndarray]:
    """Kept hashes of each text, ascending, reduced to the digits that fingerprints write."""
    below, out = np.uint64(_below(fraction)), []
    for found in shingle_hashes(texts, shingle):
        reduced = np.unique(found >> _SHIFT)
        out.append(reduced[:max(least, int(np.searchsorted(reduced, below >> _SHIFT)))] if fraction < 1 else reduced)
    return out


def bound(sketch: np.ndarray, fraction: float = FRACTION, least: int = LEAST) -> int:
    """A sketch holds all its text's hashes up to here."""
    if fraction >= 1 or len(sketch) < least:
        return 2 ** (4 * DIGITS) - 1
    return max((_below(fraction) >> int(_SHIFT)) - 1, int(sketch[-1]))


def written(sketch: np.ndarray) -> str:
    nibbles = np.empty((len(sketch), DIGITS), dtype=np.uint8)
    for digit in range(DIGITS):
        nibbles[:, digit] = (sketch >> np.uint64(4 * (DIGITS - 1 - digit))) & np.uint64(15)
    return _HEX[nibbles].tobytes().decode("ascii")


def read(fingerprint: str) -> np.ndarray:
    return np.array([int(fingerprint[at:at + DIGITS], 16) for at in range(0, len(fingerprint), DIGITS)], dtype=np.uint64)


def containment(part: np.ndarray, whole: np.ndarray, fraction: float = FRACTION, least: int = LEAST) -> float:
    """Estimated share of ``part``'s shingles that ``whole`` has."""
    if not len(part):
        return 0.0 if len(whole) else 1.0
    last = np.uint64(min(bound(part, fraction, least), bound(whole, fraction, least)))
    part, whole = (x[:np.searchsorted(x, last, side="right")] for x in (part, whole))
    return len(np.intersect1d(part, whole, assume_unique=True)) / len(part) if len(part) else 0.0


def merged(*fingerprints: str, fraction: float = FRACTION, least: int = LEAST) -> str:
    """Fingerprint of all the texts' shingles together, up to what all the fingerprints hold."""
    found = [read(x) for x in fingerprints]
    both = np.unique(np.concatenate(found))
    last = np.uint64(min(bound(x, fraction, least) for x in found))
    both = both[:np.searchsorted(both, last, side="right")]
    if fraction >= 1:
        return written(both)
    return written(both[:max(least, int(np.searchsorted(both, np.uint64(_below(fraction)) >> _SHIFT)))])


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many characters from the start of the next, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_SCHEMA = ("id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double")


def _compared(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Result rows of (id, text, next text), each the next of the one before."""
    texts = [text for _, text, _ in pairs]
    changed = [edited(text, following) for _, text, following in pairs]
    own, other = sketches([*texts, pairs[-1][2]]), sketches(changed)
    return pa.RecordBatch.from_arrays([
        pa.array([doc for doc, *_ in pairs], pa.int64()), pa.array(map(len, texts), pa.int64()),
        pa.array([hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() for text in changed]),
        pa.array(map(written, own[:-1]), pa.string()), pa.array(map(written, other), pa.string()),
        pa.array([containment(a, b) for a, b in zip(own, other)], pa.float64()),
        pa.array([containment(a, b) for a, b in zip(own, own[1:])], pa.float64())],
        [field.split()[0] for field in _SCHEMA.split(", ")])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result rows of a part's documents; its last row only follows them."""
    last = None
    for piece in slices(batches, "text", 1_000_000):
        pairs = []
        for follows, doc, text in zip(*(piece.column(name).to_pylist() for name in ("follows", "id", "text"))):
            if last is not None:
                pairs.append((*last, text))
            last = None if follows else (doc, text)
            if follows and pairs:
                yield _compared(pairs)
                pairs = []
        if pairs:
            yield _compared(pairs)


def _parted(rows: DataFrame, parts: int) -> DataFrame:
    """The rows with ``part``: ranges of ids with about as many rows each, numbered upwards, NULL ids last."""
    values = rows.withColumn("value", F.col("id").cast("double"))
    bounds = sorted(set(values.approxQuantile("value", [n / parts for n in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    if bounds:
        splits = [float("-inf"), *bounds, float("inf")]
        values = Bucketizer(splits=splits, inputCol="value", outputCol="bucket", handleInvalid="keep").transform(values)
    number = F.col("bucket").cast("int") if bounds else F.lit(0)
    return values.select(F.when(F.col("id").isNull(), parts).otherwise(number).alias("part"), *rows.columns)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Each text is compared with its edited form and with the next document's, by ascending id, the first following the
    last.  The texts move once, by ranges of ids; a part gets the first text of the next one besides its own.
    """
    spark = session(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _parted(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")), parts)

    heads = rows.groupBy("part").agg(F.min("id").alias("head"))  # one row per part
    leads = F.broadcast(heads.withColumnRenamed("part", "next_part"))
    firsts = rows.join(leads, (F.col("part") == F.col("next_part")) & F.col("id").eqNullSafe(F.col("head")))
    firsts = firsts.groupBy("next_part").agg(F.min("text").alias("text"))
    lowest = F.min("part").over(Window.partitionBy())
    after = heads.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), lowest).alias("next_part"))
    ends = after.join(firsts, "next_part").select("part", F.lit(True).alias("follows"), F.lit(None).cast("long").alias("id"), "text")

    dealt = rows.select("part", F.lit(False).alias("follows"), "id", "text").unionByName(ends).repartitionById(parts + 1, "part")
    ordered = dealt.sortWithinPartitions("part", "follows", F.col("id").asc_nulls_last(), "text")
    return ordered.mapInArrow(_within, _SCHEMA)


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
