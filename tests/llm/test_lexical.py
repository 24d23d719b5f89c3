"""The length-stratified index against scoring every document."""

from __future__ import annotations

import collections
import math
import random
import re

import pytest

from snapgrid.llm import lexical
from snapgrid.llm.common import session

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(lexical.TERM, (text or "").translate(LOWER))


def plain(docs, items, most=10):
    counts = [collections.Counter(terms(text)) for _, text in docs]
    n_docs, total = sum(map(bool, counts)), sum(sum(c.values()) for c in counts)
    df = collections.Counter(term for c in counts for term in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item].update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for (doc, _), c in zip(docs, counts):
            m = 10 + 90 * sum(c.values()) * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in wanted if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:most], 1)]
    return sorted(out, key=str)


def found(docs, items, **more):
    return sorted(((r["item"], r["rank"], r["id"], r["score"]) for r in lexical.search(docs, items, **more).collect()), key=str)


@pytest.fixture
def corpus():
    rng = random.Random(2)
    words = [f"w{int(n)}" for n in (rng.paretovariate(0.6) for _ in range(4000)) if n < 5000] + ["Été", "naïve", "日本", "A1"]
    docs = [(n, " ".join(rng.choices(words, k=rng.choice([1, 3, 30, 30, 30, 200])))) for n in range(400)]
    docs += [(500 + n, docs[7][1]) for n in range(60)] + [(3, docs[8][1]), (3, docs[8][1]), (None, docs[7][1]), (None, None), (901, ""),
                                                         (902, "-- !"), (903, " ".join(rng.choices(words, k=40_000)))]
    items = [(n, " ".join(rng.choices(words, k=rng.choice([1, 5, 40])))) for n in range(30)]
    items += [(100, docs[7][1]), (101, None), (102, ""), (103, "nowhere"), (None, "w1 w2"), (None, "w3"), (5, "w9 W9,w9"), (104, "été ÉTÉ a1")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_terms": 40}, {"hits": 3}])
def test_ranks_like_scoring_every_document(spark, corpus, options):
    session(spark)
    docs, items = corpus
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, m int, item string")
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, rank int")
    assert found(df, asked, **options) == plain(docs, items, options.get("hits", 10))


def test_ranks_from_small_slices(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical, "SLICE_DOCS", 3)
    made = list(lexical._sliced(iter([])))
    assert made == []
    df, asked = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert found(df, asked) == plain(docs, items)


def test_a_slice_holds_one_normaliser_and_all_documents(spark, corpus):
    docs, _ = corpus
    index, n_docs = lexical.build_index(spark.createDataFrame(docs, "doc_id bigint, text string"))
    rows = index.collect()
    held = [(doc, r["m"]) for r in rows for doc in r["ids"]]
    total = sum(len(terms(t)) for _, t in docs)
    assert sorted(held, key=str) == sorted(((d, 10 + 90 * len(terms(t)) * n_docs // total) for d, t in docs if terms(t)), key=str)
    for r in rows:
        assert list(r["terms"]) == sorted(r["terms"], key=lambda x: x.encode()) and sum(r["holders"]) == len(r["tf"]) == len(r["pos"])


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert found(none, items) == [] and found(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string"), items.limit(0)) == []
