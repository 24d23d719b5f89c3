"""Line and exact de-duplication, sharding and mixing against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from conftest import SF_DIR
from snapgrid.llm import exact_dedup, line_dedup, mixing, sharding
from snapgrid.llm import queries as texts
from snapgrid.llm.common import session

DOCS = "doc_id bigint, text string, source string, kept string, row string, id int"
WS = " \t\n\x0b\x0c\r"


@pytest.fixture
def docs(spark):
    session(spark)
    line = "The same line, shared by many"
    rows = [
        (1, f"a\n {line} \nb", "s1"), (2, f"{line.upper()}\r\n{line}", "s1"), (3, f"{line}\nown words", None), (4, None, "s2"),
        (5, "", "s2"), (5, "", "s2"), (None, f"x\n{line}", None), (None, f"y\n{line}", ""), (7, "É" * 30, "s3"), (8, "é" * 30, "s3"),
        (9, "É" * 30 + "\nQ", "s3"), (10, "É" * 30, "s3"), (11, "short\n\n", "s2"), (12, "short", "s2"), (13, "sho rt", "s1"),
        (14, "s h o r t", "s1"), (15, "w" * 9000 + "\n" + "z\U0001f600" * 3000, "s1"), (16, "w" * 9000 + "z\U0001f600" * 3000, None),
    ]
    return spark.createDataFrame([(a, b, c, "k", "r", 0) for a, b, c in rows], DOCS)


def line_key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(WS))


def plain_lines(rows, min_chars=20, min_docs=3):
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= min_chars:
                holders[line_key(line)].add(doc)
    out = []
    for doc, text in rows:
        def lost(line):
            held = holders.get(line_key(line), ())
            return len(held) >= min_docs and doc != max((x for x in held if x is not None), default=None)
        out.append((doc, "\n".join(x for x in (text or "").split("\n") if not lost(x))))
    return sorted(out, key=str)


def kept_lines(df):
    found = line_dedup.drop_shared_lines(df).select("row.doc_id", F.array_join("kept", "\n").alias("text"))
    return sorted(((r[0], r[1]) for r in found.collect()), key=str)


def test_lines_like_plain_python(docs):
    assert kept_lines(docs) == plain_lines([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_lines_of_random_documents(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choices(["Alpha", "beta", "ÉTA", "gamma", "K", "K"], k=5)) for _ in range(40)]
    rows = [(n, "\n".join(rng.choices(pool, k=rng.randint(0, 8)))) for n in range(200)]
    assert kept_lines(spark.createDataFrame(rows, "doc_id bigint, text string")) == plain_lines(rows)


def test_text_of_many_shared_lines(spark):
    text = "\n".join(f"line {number} of many shared lines" for number in range(3000))
    rows = [(1, text), (2, "own\n" + text + "\nmore"), (3, text)]
    assert kept_lines(spark.createDataFrame(rows, "doc_id bigint, text string")) == plain_lines(rows)


def test_nothing_from_nothing(spark, docs):
    empty = docs.limit(0)
    assert line_dedup.drop_shared_lines(empty).count() == 0
    assert exact_dedup.mark_duplicates(empty).count() == 0
    assert sharding.place(empty).count() == 0
    assert mixing.mix(empty).count() == 0


def plain_exact(rows):
    groups = collections.defaultdict(list)
    for doc, text in rows:
        groups[re.sub(f"[{WS}]+", "", text or "")].append((doc, len(text or "")))
    out, taken = [], set()
    for doc, text in rows:
        bare = re.sub(f"[{WS}]+", "", text or "")
        best = min(groups[bare], key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        kept = (doc, len(text or "")) == best and bare not in taken  # one row of a group, also where rows agree in all
        taken |= {bare} if kept else set()
        out.append((doc, best[0], len(groups[bare]), kept, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


def test_one_row_of_a_group_stays_whatever_the_ids(spark):
    session(spark)
    for rows, kind in (([(1, "a b"), (1, "a b"), (2, "ab")], "bigint"), ([("x", "a b"), ("x", "a b"), ("w", "a b")], "string"),
                       ([(None, "a b"), (None, "a b"), (None, "ab")], "bigint")):
        found = exact_dedup.mark_duplicates(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()
        assert sum(r["kept"] for r in found) == 1 and {r["group_size"] for r in found} == {3}
        kept = next(r for r in found if r["kept"])
        assert kept["id"] == kept["keep_id"] == (None if rows[0][0] is None else "w" if kind == "string" else 1)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_like_plain_python(docs, weak):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    more = {"chunk_hash": lambda c: F.length(c).cast("long")} if weak else {}  # lengths clash, so ranks must tell
    found = exact_dedup.mark_duplicates(docs, **more)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_exact(rows)


def test_chunks_join_to_the_text_and_follow_content(spark):
    rng = random.Random(1)
    body = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60_000))
    df = spark.createDataFrame([(body,), ("X" * 1111 + body,)], "t string")
    first, second = (r[0] for r in df.select(exact_dedup.chunks_of(F.col("t"))).collect())
    assert "".join(first) == body and max(map(len, first + second)) <= exact_dedup.LONGEST
    assert len(first) > 20 and len(set(first) & set(second)) > 0.8 * len(first)


def test_lookup_table_is_balanced_and_stable():
    names = [f"s{n}" for n in range(10)]
    whole, fewer = sharding.lookup_table(names, 1009), sharding.lookup_table(names[:-1], 1009)
    sizes = collections.Counter(whole)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    moved = sum(names[a] != names[b] for a, b in zip(whole, fewer) if a != 9)
    assert moved < 0.2 * 1009
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_placement_like_plain_python(docs, tmp_path):
    owner = sharding.lookup_table(sharding.SHARDS)
    placed = sharding.place(docs)
    assert placed.columns == [*docs.columns, "shard"]
    for row in placed.collect():
        digest = hashlib.md5(("" if row["doc_id"] is None else str(row["doc_id"])).encode()).hexdigest()
        assert row["shard"] == sharding.SHARDS[owner[int(digest[:15], 16) % sharding.SLOTS]]
    with pytest.raises(ValueError):
        sharding.place(placed)
    sharding.write_shards(docs, f"{tmp_path}/shards")
    assert docs.sparkSession.read.parquet(f"{tmp_path}/shards").count() == docs.count()


def test_sharding_query_places_every_document(spark):
    rows = driver.queries()["op3_sharding"](spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert all(r["shard"] == r["shard_without_last"] for r in rows if r["shard"] != sharding.SHARDS[-1]) or \
        sum(r["shard"] != r["shard_without_last"] for r in rows) < 0.1 * len(rows)


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return {s: fixed.get(s, level * weight[s]) for s in order}
        fixed |= {s: most * sizes[s] for s in over}


def mixing_rows(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, source string, size bigint")
    return mixing.copy_numbers(df)


def test_mix_near_targets_and_stable(spark):
    rng = random.Random(2)
    rows = [(n, rng.choice(["a", "a", "a", "b", "ç", None, ""]), rng.choice([0, 3, 50, 51, 400, 2000])) for n in range(3000)]
    rows += [(n, "tiny", 1) for n in range(3)] + [(None, "a", 7), (5000, "b", 9), (5000, "b", 9)]
    found = mixing_rows(spark, rows).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing_rows(spark, rows).collect()), key=str)
    assert len(found) == len(rows)
    sizes = collections.Counter()
    for _, source, size in rows:
        sizes[source] += size
    aims, taken = plain_targets(sizes), collections.Counter()
    for r in found:
        assert 0 <= r["copies"] <= 3
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], aims[r["source"]], rel_tol=1e-9)
        share = r["target"] / r["source_size"]
        assert abs(r["copies"] - share) < 1
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - aims[s]) <= 1000 for s in sizes)  # half of the greatest size


def test_mix_without_words(spark):
    found = mixing_rows(spark, [(1, "a", 0), (2, None, 0)]).collect()
    assert [(r["target"], r["copies"]) for r in found] == [(0.0, 0), (0.0, 0)]


def test_mix_repeats_rows(spark, docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    names = docs.select("doc_id", "text", "source")
    assert mixed.select(names.columns).exceptAll(names.union(names).union(names)).count() == 0
    sizes = docs.select(F.col("doc_id").alias("id"), "source", mixing.size_of("text").alias("size"))
    assert mixed.count() == mixing.copy_numbers(sizes).agg(F.sum("copies")).first()[0]


def test_mix_of_the_documents(spark):
    rows = driver.queries()["op2_mixing"](spark, SF_DIR).collect()
    taken, aims = collections.Counter(), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        aims[r["source"]] = r["target"]
    assert sum(aims.values()) == pytest.approx(sum(r["size"] for r in rows))
    largest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - aims[s]) <= largest / 2 for s in aims)


@pytest.mark.parametrize("name", sorted(texts.ORACLE))
def test_queries_equal_their_sql(spark, driver_tables, name):
    found = driver.queries()[name](spark, SF_DIR)
    oracle = driver_tables.sql(driver.oracle_sql()[name])
    assert sorted(found.columns) == sorted(oracle.columns)
    assert sorted(map(tuple, found.select(oracle.columns).collect())) == sorted(oracle.fetchall())


@pytest.mark.parametrize("name", ["op2_mixing", "op3_sharding", "op5_exact_dedup"])
def test_native_operators_have_no_python(spark, name):
    plan = driver.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "MapInArrow", "MapInPandas", "FlatMapGroups", "FlatMapCoGroups", "ArrowEval", "BatchEval", "CartesianProduct"):
        assert word not in plan
