"""The whole pipeline against plain Python; only the toxicity scores are taken over."""

from __future__ import annotations

import collections
import random

import __spark_entry__ as driver
from snapgrid.llm import pieces, toxicity
from snapgrid.llm.common import session
from test_dedup import plain_lines, plain_targets
from test_ngram_join import shingles


def documents():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    shared = ["This very line stands in many documents", "Another line that is shared by many of them"]
    out, labels = [], []
    for doc in range(160):
        toxic = doc % 5 == 0
        text = rng.choices(words, k=rng.randint(5, 60)) + ["Zrkwort" + rng.choice("xyq")] * (2 * toxic)
        rng.shuffle(text)
        lines = [" ".join(text)] + [line for line in shared if rng.random() < 0.2]
        rng.shuffle(lines)
        out.append((doc, "\n".join(lines)))
        if doc % 4:
            labels.append((doc, 1, int(toxic)))
    base = rng.choices(words, k=80)
    for doc in range(200, 212):
        near = list(base)
        near[rng.randrange(80)] = "other"
        out.append((doc, " ".join(near)))
    out += [(300, out[1][1]), (None, " ".join(rng.choices(words, k=30))), (None, " ".join(rng.choices(words, k=31))), (301, None), (302, "")]
    return [(doc, text, "en", (None, "a", "b")[at % 3], len(text or "")) for at, (doc, text) in enumerate(out)], labels


def one_of_each_class(rows):
    """Indices of the rows that stay, by all pairs."""
    sets, chain = [shingles(text) for _, text, _ in rows], list(range(len(rows)))

    def root(x):
        while chain[x] != x:
            x = chain[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                chain[root(i)] = root(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), (True, 0, i)), (doc is None, doc or 0, i))
    return [i for *_, i in least.values()]


def test_pipeline_like_plain_python(spark, tmp_path):
    session(spark)
    rows, labels = documents()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labelled = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labelled.write.parquet(f"{tmp_path}/labels.parquet")

    scored = toxicity.score(docs, labelled).where("predicted = 0").select("row.doc_id", "row.text", "row.source").collect()
    assert len(rows) / 2 < len(scored) < len(rows)
    texts = plain_lines([(r["doc_id"], r["text"]) for r in scored])
    by_key = collections.defaultdict(list)
    for r in scored:
        by_key[r["doc_id"]].append(r)
    lined = []
    for doc, text in texts:  # NULL ids hold no shared lines here, so their texts tell them apart
        of = next(r for r in by_key[doc] if doc is not None or r["text"] == text)
        lined.append((doc, text, of["source"]))
    assert any(text != r["text"] for (_, text, _), r in zip(sorted(lined, key=str), sorted(scored, key=str)) if r["text"])
    kept = [lined[i] for i in one_of_each_class(lined)]
    assert len(kept) < len(lined) - 8 and sum(doc is None for doc, *_ in kept) == 2

    encode = pieces.ChunkTable(pieces.model_path()).pieces
    got = driver.queries()["pipeline"](spark, str(tmp_path)).collect()
    taken = collections.Counter((r["doc_id"], r["source"], tuple(r["ids"])) for r in got)
    want, sizes = {}, collections.Counter()
    for doc, text, source in kept:
        size = len(text.split())
        want[doc, source, tuple(encode.encode(text))] = size
        sizes[source] += size
    assert len(want) == len(kept) and set(taken) <= set(want)
    aims, mixed, largest = plain_targets(sizes), collections.Counter(), max(want.values())
    for key, size in want.items():
        assert 0 <= taken[key] <= 3 and abs(taken[key] - aims[key[1]] / sizes[key[1]]) < 1
        mixed[key[1]] += size * taken[key]
    assert all(abs(mixed[source] - aims[source]) <= largest / 2 for source in sizes)
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) and r["decoded"] == encode.decode(list(r["ids"])) and r["lang"] == "en"
