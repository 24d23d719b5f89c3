"""Fast similarity sketches, and the classes they lead to, against comparing all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from snapgrid.llm import minhash
from snapgrid.llm.common import session

WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    def grams(text):
        words = [w for w in re.split(f"[{WS}]+", (text or "").translate(LOWER)) if w]
        return {tuple(words[i:i + 2]) for i in range(max(1, len(words) - 1))} if words else set()

    sets, chain = [grams(text) for _, text in rows], list(range(len(rows)))

    def root(x):
        while chain[x] != x:
            x = chain[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                chain[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), (True, None)), (doc is None, doc), key=lambda x: (x[0], x[1] or 0))
    return sorted(((doc, len(sets[i]), least[root(i)][1] if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def found(df, **more):
    return sorted(((r["id"], r["size"], r["class_id"]) for r in minhash.near_duplicates(df, **more).collect()), key=str)


def test_sketches_estimate_similarity_at_all_sizes():
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 40, 700, 20_000):
        whole = rng.integers(0, 2 ** 63, size + size // 4 + 1, dtype=np.uint64)
        a, b = np.sort(whole[:size]), np.sort(whole[size // 4:])
        one, other = minhash.fast_sketches([a, b])
        assert abs((one == other).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.13
    same = minhash.fast_sketches([whole, whole[::-1], whole[:0]])
    assert (same[0] == same[1]).all() and (same[2] == same[2][0]).all()
    alone = minhash.fast_sketches([whole[:7]])
    assert (minhash.fast_sketches([a, whole[:7], b])[1] == alone[0]).all()  # whatever else is in the batch


@pytest.fixture
def crowd(spark):
    """A large group of near copies around the threshold, chains, small groups, a passage that many share, copies and odd rows."""
    session(spark)
    rng = random.Random(5)
    words = [f"w{n}" for n in range(2000)]

    def text(n):
        return rng.choices(words, k=n)

    def changed(base, times):
        base = list(base)
        for _ in range(times):
            base[rng.randrange(len(base))] = rng.choice(words)
        return base

    core, passage = text(120), text(60)
    out = [" ".join(changed(core, rng.randint(0, 9))) for _ in range(220)]
    step = text(100)
    for _ in range(25):
        step = changed(step, 3)
        out.append(" ".join(step))
    for _ in range(40):
        base = text(rng.randint(3, 90))
        out += [" ".join(changed(base, rng.randint(0, 3))) for _ in range(rng.randint(2, 4))]
    out += [" ".join([*text(20), *passage, *text(20)]) for _ in range(120)]
    out += [out[0]] * 4 + [out[300].upper(), out[300].replace(" ", "\n"), "É x y z", "é x y z"]
    rng.shuffle(out)
    long = " ".join(text(60_000))
    return [*enumerate(out), (5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE "), (None, "one"), (None, "solo"),
            (None, None), (5005, long), (5006, long + " end"), (7, out[3]), (7, out[3])]


def test_classes_like_all_pairs(spark, crowd):
    assert found(spark.createDataFrame(crowd, "doc_id bigint, text string")) == plain(crowd)


def test_classes_from_many_blocks(spark, crowd, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 12)
    docs = spark.createDataFrame([(d, t, "x", 0, b"") for d, t in crowd], "doc_id bigint, text string, key string, size int, sketch binary")
    assert found(docs) == plain(crowd)


def test_nothing_and_one(spark):
    assert found(spark.createDataFrame([], "doc_id bigint, text string")) == []
    assert found(spark.createDataFrame([("a", "x y z"), ("b", "x Y z")], "doc_id string, text string")) == [("a", 2, "a"), ("b", 2, "a")]
