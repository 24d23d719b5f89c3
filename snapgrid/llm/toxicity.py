"""Toxicity by two class-conditional Kneser-Ney models over the bytes of words.

A word is lower-cased and read byte by byte after a blank, up to a closing blank; a gram is a byte with the five before it.
Each class (toxic, ordinary) has its own counts of whole grams, from labelled documents; both back off to the same
lower orders (four bytes, two, one), whose counts are numbers of distinct continuations over *all* documents.  Where
neither class has seen a context, their likelihoods are equal, so only contexts from labelled texts enter the model.
A document's log-likelihood ratio, divided by its number of words and by the root of it, is turned into a score by
logistic regression, together with the part of it that single words have above ``EXCESS`` (few words make a text toxic).

Labels come from documents whose crc32(id as text) modulo 3 is 0 for the counts, 2 for the regression, never 1.  The
regression alone uses a bounded sample (``CALIBRATION`` labelled documents); counts have no bound.  The model is sent to
the tasks in portions of at most ``PORTION`` entries, one pass over the documents each, so no task holds more.

Defined cases: a NULL text is empty and has ratio 0; a NULL id counts as the empty text in crc32 and has no label; of
several labels of a document the greatest counts, NULL labels do not; without labels of both classes every score is 0;
an empty table gives no rows; further columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgrid.llm.common import materialise, slices, table

THRESHOLD = 0.7
CALIBRATION = 20_000
PORTION = 8_000_000
DISCOUNT = 0.75
ORDER = 6
EXCESS = 4.0
_CONTEXT = 1 << 50  # marks entries of contexts, which follow grams of 48 bits in the model
_DISTINCT = 200_000


def _fold_of(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of the words, and the number of each word's grams."""
    coded = [word.encode("utf-8", "surrogatepass") for word in words]
    sizes = np.array([len(word) + 1 for word in coded], dtype=np.int64)
    data = np.frombuffer(b" " + b" ".join(coded) + b" ", dtype=np.uint8)[: int(sizes.sum()) + 1].astype(np.uint64)
    # bytes back to the blank before the word, which is part of the context
    back = np.arange(1, len(data)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    out = data[1:].copy()
    for step in range(1, ORDER):
        shifted = np.zeros(len(out), dtype=np.uint64)
        shifted[step - 1:] = data[: len(data) - step]
        out |= np.where(back >= step, shifted, np.uint64(0)) << np.uint64(8 * step)
    return out, sizes


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, toxic, ordinary) counts of labelled texts, summed per task as far as memory allows."""
    def out(held: dict[int, Counter]) -> pa.RecordBatch:
        words = list(held[0].keys() | held[1].keys())
        found, sizes = grams(words)
        names, place = np.unique(found, return_inverse=True)
        sums = [np.bincount(place, np.repeat([held[c][word] for word in words], sizes), len(names)).astype(np.int64) for c in (1, 0)]
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), *map(pa.array, sums)], ["gram", "toxic", "ordinary"])

    held = {0: Counter(), 1: Counter()}
    for piece in slices(batches, "text"):
        for text, label in zip(piece.column("text").to_pylist(), piece.column("label").to_pylist()):
            held[label].update(_words(text))
        if len(held[0]) + len(held[1]) > _DISTINCT:
            yield out(held)
            held = {0: Counter(), 1: Counter()}
    if held[0] or held[1]:
        yield out(held)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct grams of all texts, per task as far as memory allows."""
    def out(words: set[str], known: np.ndarray) -> np.ndarray:
        return np.union1d(known, grams(list(words))[0])

    words, known = set(), np.zeros(0, dtype=np.uint64)
    for piece in slices(batches, "text"):
        for text in piece.column("text").to_pylist():
            words.update(_words(text))
        if len(words) > _DISTINCT:
            words, known = set(), out(words, known)
            if len(known) > 10 * _DISTINCT:
                yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int64))], ["gram"])
                known = known[:0]
    if words:
        known = out(words, known)
    if len(known):
        yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int64))], ["gram"])


def _low(name: str, n_bytes: int) -> Column:
    return F.col(name).bitwiseAND((1 << 8 * n_bytes) - 1)


def _shared(all_grams: DataFrame) -> DataFrame:
    """(four, p): smoothed probability of a byte after three, from distinct continuations in all documents."""
    fours = all_grams.select(F.col("gram"), _low("gram", 4).alias("four")).groupBy("four").agg(F.count("*").alias("n"))
    twos = fours.select(_low("four", 2).alias("two")).groupBy("two").agg(F.count("*").alias("n2"))
    ones = twos.select(_low("two", 1).alias("one")).groupBy("one").agg(F.count("*").alias("n1"))
    everything, by_two, by_four = Window.partitionBy(), Window.partitionBy("before"), Window.partitionBy("before")
    ones = ones.select("one", (F.col("n1") / F.sum("n1").over(everything)).alias("p1"))
    twos = twos.withColumn("before", F.shiftright("two", 8)).withColumn("one", _low("two", 1))
    total, kinds = F.sum("n2").over(by_two), F.count("*").over(by_two)
    twos = (twos.withColumn("own", (F.col("n2") - DISCOUNT) / total).withColumn("rest", DISCOUNT * kinds / total)
            .join(ones, "one").select("two", (F.col("own") + F.col("rest") * F.col("p1")).alias("p2")))
    fours = fours.withColumn("before", F.shiftright("four", 8)).withColumn("two", _low("four", 2))
    total, kinds = F.sum("n").over(by_four), F.count("*").over(by_four)
    fours = fours.withColumn("own", (F.col("n") - DISCOUNT) / total).withColumn("rest", DISCOUNT * kinds / total)
    return fours.join(twos, "two").select("four", (F.col("own") + F.col("rest") * F.col("p2")).alias("p"))


def model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(key, ratio): log of toxic over ordinary likelihood, of grams seen in labelled texts and of their contexts."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = _labels(labels, id_col, label_col, 0)
    labelled = texts.where(_fold_of("id") == 0).join(known, "id").select("text", "label")
    counts = (labelled.mapInArrow(_counted, "gram bigint, toxic bigint, ordinary bigint")
              .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    distinct = materialise(texts.select("text").mapInArrow(_distinct, "gram bigint").distinct(), "grams")
    context = Window.partitionBy("context")
    counts = counts.withColumn("context", F.shiftright("gram", 8)).withColumn("four", _low("gram", 4))
    for name in ("toxic", "ordinary"):
        total = F.sum(name).over(context)
        kinds = F.count_if(F.col(name) > 0).over(context)
        seen = total > 0
        counts = (counts.withColumn(f"{name}_own", F.when(seen, F.greatest(F.col(name) - DISCOUNT, F.lit(0.0)) / total).otherwise(0.0))
                  .withColumn(f"{name}_rest", F.when(seen, DISCOUNT * kinds / total).otherwise(1.0)))
    rows = materialise(counts.join(_shared(distinct), "four"), "gram-counts")
    chance = {name: F.col(f"{name}_own") + F.col(f"{name}_rest") * F.col("p") for name in ("toxic", "ordinary")}
    whole = rows.select(F.col("gram").alias("key"), F.log(chance["toxic"] / chance["ordinary"]).cast("float").alias("ratio"))
    unseen = rows.groupBy("context").agg(F.first(F.log(F.col("toxic_rest") / F.col("ordinary_rest"))).cast("float").alias("ratio"))
    return whole.unionByName(unseen.select((F.col("context") + _CONTEXT).alias("key"), "ratio"))


def _labels(labels: DataFrame, id_col: str, label_col: str, fold: int) -> DataFrame:
    return (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (_fold_of(id_col) == fold))
            .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label")))


def _portions(entries: DataFrame) -> list:
    """The model as broadcast pairs of arrays, each of at most PORTION entries; a context stays whole in one."""
    spark = entries.sparkSession
    entries = materialise(entries, "model")
    parts = max(1, math.ceil(entries.count() / (0.8 * PORTION)))
    context = F.when(F.col("key") >= _CONTEXT, F.col("key") - _CONTEXT).otherwise(F.shiftright("key", 8))
    out = []
    for part in range(parts):
        got = entries.where(F.pmod(F.xxhash64(context), F.lit(parts)) == part).toArrow()
        keys, ratios = got["key"].to_numpy().astype(np.int64), got["ratio"].to_numpy().astype(np.float32)
        order = np.argsort(keys)
        out.append(spark.sparkContext.broadcast((keys[order], ratios[order])))
    return out


def _ratios(found: np.ndarray, keys: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The entry of each gram, else of its context, else 0."""
    if not len(keys):
        return np.zeros(len(found))
    names, place = np.unique(found.astype(np.int64), return_inverse=True)

    def looked_up(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, ratios[at]

    hit, value = looked_up(names)
    seen, context = looked_up((names >> 8) + _CONTEXT)
    return np.where(hit, value, np.where(seen, context, 0.0))[place]


def log_ratios(docs: DataFrame, portions: list, text_col: str) -> DataFrame:
    """The rows as struct ``row`` with ``ratio``, ``excess`` and ``words``.

    ``ratio`` is the log-likelihood ratio of the whole text, ``excess`` the sum of what single words have above EXCESS.
    With several portions, each pass adds its part of every word's ratio, and the last one sums them up.
    """
    def added(portion, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, ratios = portion.value
            scores: dict[str, float] = {}
            for piece in slices(batches, "text"):
                cut = [_words(text) for text in piece.column("text").to_pylist()]
                if len(scores) > 2 * _DISTINCT:
                    scores.clear()
                if new := list({word for words in cut for word in words if word not in scores}):
                    found, sizes = grams(new)
                    values = _ratios(found, keys, ratios)
                    scores.update(zip(new, np.add.reduceat(values, np.cumsum(sizes) - sizes).tolist()))
                parts = [np.array([scores[word] for word in words]) for words in cut]
                if not first:
                    parts = [part + np.array(before) for part, before in zip(parts, piece.column("parts").to_pylist())]
                if last:
                    made = [pa.array([part.sum() for part in parts], pa.float64()),
                            pa.array([np.maximum(part - EXCESS, 0.0).sum() for part in parts], pa.float64()),
                            pa.array(map(len, cut), pa.int64())]
                    yield pa.RecordBatch.from_arrays([piece.column("row"), *made], ["row", "ratio", "excess", "words"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("row"), piece.column("text"), pa.array(parts, pa.list_(pa.float64()))], ["row", "text", "parts"])
        return run

    rows = docs.select(F.struct(*[docs[name] for name in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    between = T.StructType([*rows.schema.fields, T.StructField("parts", T.ArrayType(T.DoubleType()))])
    after = T.StructType([rows.schema["row"], T.StructField("ratio", T.DoubleType()), T.StructField("excess", T.DoubleType()),
                          T.StructField("words", T.LongType())])
    for number, portion in enumerate(portions):
        last = number == len(portions) - 1
        rows = (materialise(rows, "ratios") if number else rows).mapInArrow(added(portion, not number, last), after if last else between)
    return rows


def _features() -> list[Column]:
    n = F.greatest(F.col("words").cast("double"), F.lit(1.0))
    return [F.col(name) / size for name in ("ratio", "excess") for size in (n, F.sqrt(n))]


def _calibrated(docs: DataFrame, labels: DataFrame, portions: list, id_col: str, text_col: str, label_col: str) -> list[float] | None:
    """Weights of the features, and the constant, from a bounded sample of labelled documents; None without both classes."""
    order = F.xxhash64(F.lit("calibration"), "id")
    sample = materialise(_labels(labels, id_col, label_col, 2).orderBy(order, "id").limit(CALIBRATION), "calibration")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(_fold_of("id") == 2)
    rows = rows.join(F.broadcast(sample), "id").select("text", "label")  # CALIBRATION rows at most
    names = [f"x{number}" for number in range(len(_features()))]
    found = log_ratios(rows, portions, "text").select("row.label", *[f.alias(name) for f, name in zip(_features(), names)])
    got = found.groupBy("label", *names).count().toArrow()
    y, times = (got["label"].to_numpy() > 0).astype(float), got["count"].to_numpy().astype(float)
    if not y.any() or y.all():
        return None
    x = np.column_stack([got[name].to_numpy() for name in names])
    scale = np.maximum(x.std(axis=0), 1e-9)
    x = np.column_stack([x / scale, np.ones(len(x))])
    weights, ridge = np.zeros(len(names) + 1), np.array([1e-2] * len(names) + [1e-6])
    for _ in range(100):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (times * (p - y)) + ridge * weights
        bend = (x * (times * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        weights -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return [*(weights[:-1] / scale), weights[-1]]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          threshold: float = THRESHOLD) -> DataFrame:
    """The rows as struct ``row`` with held_out, score, predicted, ratio, excess and words."""
    portions = _portions(model(docs, labels, id_col, text_col, label_col))
    weights = _calibrated(docs, labels, portions, id_col, text_col, label_col)
    rows = log_ratios(docs, portions, text_col)
    if weights is None:
        chance = F.lit(0.0)
    else:
        logit = sum((f * float(w) for f, w in zip(_features(), weights)), F.lit(float(weights[-1])))
        chance = 1.0 / (1.0 + F.exp(-logit))
    return (rows.withColumn("score", chance).withColumn("held_out", _fold_of(f"row.`{id_col}`") == 1)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, table(spark, sf_dir, "labels"))
    return found.select("row.doc_id", "held_out", "score", "predicted", F.col("ratio").alias("log_ratio"), "words")
