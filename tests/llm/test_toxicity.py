"""The class-conditional models: probabilities by hand, held-out accuracy, and the pipeline's stages."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from conftest import SF_DIR
from snapgrid.llm import line_dedup, toxicity
from snapgrid.llm.common import session


def fold(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 3


def plain_grams(word):
    data = b" " + word.encode() + b" "
    return [bytes(max(0, 6 - end)) + data[max(0, end - 6):end] for end in range(2, len(data) + 1)]


def number(gram):
    return int.from_bytes(gram, "big")


@pytest.fixture
def corpus(spark):
    session(spark)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdef", k=rng.randint(1, 6))) for _ in range(80)]
    rows, labels = [], []
    for doc in range(400):
        toxic = doc % 5 == 0
        text = rng.choices(words, k=rng.randint(5, 60)) + (["Zrkwort" + rng.choice("xyq")] * rng.randint(1, 2) if toxic else [])
        rng.shuffle(text)
        rows.append((doc, " ".join(text), "c"))
        if doc % 4:
            labels.append((doc, int(toxic), 1))
    rows += [(None, "abc", "c"), (900, None, "c"), (901, "", "c"), (7, "abc fed", "c")]
    labels += [(2, None, 1), (None, 1, 1), (5, 0, 0), (5, 1, 0)]
    return (spark.createDataFrame(rows, "doc_id bigint, text string, score string"),
            spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int"))


def test_grams():
    found, sizes = toxicity.grams(["idiot", "é", "", "x"])
    want = [g for word in ["idiot", "é", "", "x"] for g in plain_grams(word)]
    assert found.tolist() == [number(g) for g in want] and sizes.tolist() == [6, 3, 1, 2]


def test_model_by_hand(corpus):
    docs, labels = corpus
    label = {}
    for r in labels.collect():
        if r["toxic"] is not None and r["doc_id"] is not None:
            label[r["doc_id"]] = max(label.get(r["doc_id"], 0), r["toxic"])
    counts, everything = {0: Counter(), 1: Counter()}, set()
    for r in docs.collect():
        found = [g for word in (r["text"] or "").lower().split() for g in plain_grams(word)]
        everything.update(found)
        if fold(r["doc_id"]) == 0 and r["doc_id"] in label:
            counts[label[r["doc_id"]]].update(found)
    fours = Counter(g[2:] for g in everything)
    twos = Counter(g[2:] for g in fours)
    ones = Counter(g[1:] for g in twos)
    d = toxicity.DISCOUNT

    def tail(grams, gram, lower):
        before = defaultdict(list)
        for g, n in grams.items():
            before[g[:-1]].append(n)
        mine = before[gram[:-1]]
        return (grams[gram] - d) / sum(mine) + d * len(mine) / sum(mine) * lower

    def shared(gram):
        return tail(fours, gram[2:], tail(twos, gram[4:], ones[gram[5:]] / sum(ones.values())))

    def rest(c, context):
        seen = [n for g, n in counts[c].items() if g[:-1] == context]
        return (d * len(seen) / sum(seen), sum(seen)) if seen else (1.0, 0)

    got = {r["key"]: r["ratio"] for r in toxicity.model(docs, labels).collect()}
    grams = set(counts[0]) | set(counts[1])
    assert len(got) == len(grams) + len({g[:-1] for g in grams})
    for gram in sorted(grams)[::25]:
        p = []
        for c in (1, 0):
            back, total = rest(c, gram[:-1])
            p.append((max(counts[c][gram] - d, 0) / total if total else 0) + back * shared(gram))
        assert got[number(gram)] == pytest.approx(math.log(p[0] / p[1]), rel=1e-4, abs=1e-5)
        context = math.log(rest(1, gram[:-1])[0] / rest(0, gram[:-1])[0])
        assert got[number(gram[:-1]) + (1 << 50)] == pytest.approx(context, rel=1e-4, abs=1e-5)


def test_held_out_accuracy_and_odd_rows(corpus):
    docs, labels = corpus
    rows = toxicity.score(docs, labels).select("row.*", F.col("score").alias("p"), "held_out", "predicted").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert all(fold(r["doc_id"]) == 1 for r in held)
    right = sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["p"] <= 1 and r["predicted"] == (r["p"] >= 0.7) for r in rows)


def test_portions_do_not_change_scores(corpus, monkeypatch):
    docs, labels = corpus
    whole = sorted((tuple(r) for r in toxicity.score(docs, labels).select("row.doc_id", F.round("score", 6), F.round("ratio", 4)).collect()), key=str)
    monkeypatch.setattr(toxicity, "PORTION", 400)
    parts = sorted((tuple(r) for r in toxicity.score(docs, labels).select("row.doc_id", F.round("score", 6), F.round("ratio", 4)).collect()), key=str)
    assert len(toxicity._portions(toxicity.model(docs, labels))) > 1
    assert [a[0] for a in whole] == [b[0] for b in parts]
    assert all(abs(a[1] - b[1]) < 1e-3 and abs(a[2] - b[2]) < 1e-2 for a, b in zip(whole, parts))


def test_without_labels_or_rows(corpus):
    docs, labels = corpus
    assert {r["score"] for r in toxicity.score(docs.select("doc_id", "text"), labels.limit(0)).select("score").collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_query(spark):
    got = driver.queries()["op6_toxicity"](spark, SF_DIR)
    assert {"doc_id", "held_out", "score", "predicted"} <= set(got.columns)
    assert got.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, SF_DIR).persist()
        if name != "sentencepiece":
            assert at.columns == docs.columns
        if name == "toxicity":
            called = toxicity.score(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")).where("predicted = 1").select("row.doc_id")
            assert {r[0] for r in at.select("doc_id").collect()} == {
                r[0] for r in docs.select("doc_id").subtract(called).collect()}
        elif name == "line_dedup":
            want = line_dedup.drop_shared_lines(before).select("row.doc_id", F.array_join("kept", "\n").alias("text"))
            assert at.count() == before.count()
            assert at.select("doc_id", "text").exceptAll(want).count() == 0
            assert at.where(F.col("n_chars") != F.length("text")).count() == 0
        elif name == "ngram_join":
            assert 0 < at.count() <= before.count() and at.exceptAll(before).count() == 0
        elif name == "mixing":
            assert at.select("doc_id").subtract(before.select("doc_id")).count() == 0
        else:
            assert at.count() == before.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "sentencepiece"]


def test_nothing_through_the_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0
