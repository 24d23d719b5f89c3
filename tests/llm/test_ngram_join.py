"""The chosen-path join against comparing all pairs."""

from __future__ import annotations

import random

import pytest

import __spark_entry__ as driver
from conftest import SF_DIR
from snapgrid.llm import ngram_join
from snapgrid.llm.common import session

SPACE = " \t\n\x0b\x0c\r"


def shingles(text):
    words = "".join(" " if c in SPACE else c for c in (text or "").lower()).split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)])


def plain(rows, similarity=0.8):
    sets = [shingles(text) for _, text in rows]
    links, chain = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while chain[x] != x:
            x = chain[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= similarity * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                chain[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, (True, None)), (doc is None, doc), key=lambda x: (x[0], x[1] or 0))
    return sorted(((doc, least[root(i)][1] if sets[i] else doc, links[i]) for i, (doc, _) in enumerate(rows)), key=str)


def found(df, **more):
    return sorted(((r["id"], r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(df, **more).collect()), key=str)


@pytest.fixture
def crowd(spark):
    """A large group of near copies, smaller groups, a passage that many share, copies, and odd rows."""
    session(spark)
    rng = random.Random(7)
    vocabulary = [f"w{n}" for n in range(3000)]

    def text(n):
        return rng.choices(vocabulary, k=n)

    def changed(words, times):
        words = list(words)
        for _ in range(times):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return words

    core, passage, out = text(300), text(40), []
    out += [" ".join(changed(core, rng.randint(0, 4))) for _ in range(350)]
    for _ in range(40):
        base = text(rng.randint(8, 200))
        out += [" ".join(changed(base, rng.randint(0, 2))) for _ in range(rng.randint(2, 5))]
    out += [" ".join([*text(60), *passage, *text(60)]) for _ in range(300)]
    out += [out[0]] * 5 + [out[400].upper(), out[400].replace(" ", "\n")]
    rng.shuffle(out)
    rows = list(enumerate(out)) + [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "one two"), (10_004, "one  two"),
                                   (None, "one two"), (10_005, "Solo"), (10_006, out[3]), (10_006, out[3])]
    return rows


def test_join_finds_all_links(spark, crowd):
    df = spark.createDataFrame(crowd, "doc_id bigint, text string")
    assert found(df) == plain(crowd)


def test_join_by_blocks(spark, crowd, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 20)
    monkeypatch.setattr(ngram_join, "BLOCK", 50)
    df = spark.createDataFrame(crowd, "doc_id bigint, text string")
    assert found(df) == plain(crowd)


def test_one_of_each_class_stays(spark, crowd):
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in crowd], "doc_id bigint, text string, set string, id int, first string")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    classes = {(c,) for _, c, _ in plain(crowd)}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((c for c, in classes), key=str)


def test_classes_that_share_an_id_stay_apart(spark):
    a, b, c, d = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue white black grey",
                  "north east south west up down")
    rows = [(None, a), (None, b), (None, a.upper()), (7, c), (7, d), (8, d), (None, None), (None, None), (None, " "), (9, ""), (9, "")]
    session(spark)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in ngram_join.keep_one(df).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (7, c), (7, d), (None, ""), (None, ""), (None, " "), (9, ""), (9, "")], key=str)


def test_nothing_from_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert found(df) == [] and ngram_join.keep_one(df).count() == 0
    lone = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    assert found(lone) == [(1, 1, 0)]


def test_runs_reach_the_recall():
    assert 0 < ngram_join.missed() < 0.01
    assert ngram_join.missed() ** ngram_join.runs_for(0.999) <= 0.001 and ngram_join.runs_for() == 3
    with pytest.raises(ValueError):
        ngram_join.runs_for(similarity=0.2)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["least"] for r in ngram_join.components(edges).collect()}
    assert got == {**{n: 0 for n in range(61)}, 100: 100, 101: 100}


def test_query_like_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = driver.queries()["op1_ngram_join"](spark, SF_DIR).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
