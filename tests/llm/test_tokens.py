"""Token files, pieces and fingerprints against the libraries and plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as driver
from conftest import SF_DIR, rows_of
from snapgrid.llm import common, fingerprints, pieces, token_store

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \nb", "a\n b", "a▁b ▁ c", "▁", "don't 'll 've", "1 23  4\t5", "　a b",
       "\U0001f600 \U0001f600x", "</s> <|endoftext|> [INST]", "x" * 5000, "\x00 \x1c a\x1c b", "café naïve", "a\r\nb", "﻿hi", " \n "]


@pytest.fixture(scope="module")
def word_table():
    return token_store.WordTable(token_store.model_path())


@pytest.fixture(scope="module")
def chunk_table():
    return pieces.ChunkTable(pieces.model_path())


ANY = st.text(st.sampled_from(list("ab's.1 \n\té▁　\x1f\U0001f600")), max_size=30)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(ANY, max_size=4))
def test_words_like_the_library(word_table, texts):
    texts += ODD[:6]
    assert [x.tolist() for x in word_table.encode(texts)] == word_table.whole(texts)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(ANY, max_size=4))
def test_pieces_like_the_library(chunk_table, texts):
    assert chunk_table.encode(texts) == [chunk_table.pieces.encode(text) for text in texts]


def test_odd_texts(word_table, chunk_table):
    assert [x.tolist() for x in word_table.encode(ODD)] == word_table.whole(ODD)
    assert chunk_table.encode(ODD) == [chunk_table.pieces.encode(text) for text in ODD]


def test_bounded_tables_forget(chunk_table, word_table):
    for known in (pieces.ChunkTable(pieces.model_path(), most=3), token_store.WordTable(token_store.model_path(), most=3)):
        for text in ("a b c d e f", "g h", "a b"):
            one = known.encode([text])
            assert len(one) == 1 and len(known.ids) < 9


@pytest.mark.parametrize("values", [[], [0], [255, 256, 0, 65_536, 1], list(range(0, 70_000, 7)), [2 ** 32 - 1] * 600])
def test_packed_codes(values):
    tokens = [np.array(values[:3], np.uint32), np.array([], np.uint32), np.array(values[3:], np.uint32)]
    got = token_store.Segment(token_store.packed(7, 9, [5, None, -3], tokens) + b"\n")
    assert (got.shard, got.segment, got.ids, got.n_tokens) == (7, 9, [5, None, -3], len(values))
    assert got.tokens().tolist() == values and got.first.tolist() == [0, len(values[:3]), len(values[:3]), len(values)]
    assert [got.token(i) for i in range(0, len(values), 1 + len(values) // 300)] == values[::1 + len(values) // 300]
    with pytest.raises(ValueError):
        token_store.Segment(b"x" * 64)


def documents(spark):
    common.session(spark)
    rows = [(n, text) for n, text in enumerate(ODD)] + [(None, "null id"), (100, None), (50, "same b"), (50, "same a")]
    return spark.createDataFrame([(n, t, "x", 1) for n, t in rows], "doc_id bigint, text string, shard string, id int")


@pytest.mark.parametrize("segment", [20, 1_000_000])
def test_stored_tokens(spark, word_table, tmp_path, segment):
    docs = documents(spark)
    token_store.write_tokens(docs, f"{tmp_path}/store", segment=segment)
    got = token_store.located(token_store.read_tokens(spark, f"{tmp_path}/store")).orderBy("start").collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for (doc, text), row in zip(rows, got, strict=True):
        ids = np.array([*word_table.whole([text or ""])[0], 2], "<u4")
        assert (row["id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_added_tokens_like_a_fresh_library(word_table, spark, tmp_path):
    fresh = Tokenizer.from_file(token_store.model_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\ny z", "a <|endoftext| > b", "plain words here", *ODD]
    want = [fresh.encode(text, add_special_tokens=False).ids for text in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [x.tolist() for x in word_table.encode(texts)] == want
    common.session(spark)
    token_store.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), f"{tmp_path}/store")
    start, got = 0, token_store.located(token_store.read_tokens(spark, f"{tmp_path}/store")).orderBy("start").collect()
    for doc, (found, row) in enumerate(zip(want, got, strict=True)):
        ids = np.array([*found, 2], "<u4")
        assert (row["id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_decoded_rows(spark, chunk_table):
    docs = documents(spark)
    for row in pieces.decode(pieces.encode(docs)).collect():
        ids = chunk_table.pieces.encode(row["row"]["text"] or "")
        assert row["ids"] == ids and row["decoded"] == chunk_table.pieces.decode(ids)
    assert rows_of(pieces.round_trip(docs)) == rows_of(pieces.decode(pieces.encode(docs)))
    assert pieces.encode(docs.limit(0)).count() == pieces.round_trip(docs.limit(0)).count() == 0


def test_queries_like_the_libraries(spark, word_table, chunk_table):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    stored = driver.queries()["op8_token_store"](spark, SF_DIR).orderBy("doc_id").collect()
    coded = driver.queries()["op10_sentencepiece"](spark, SF_DIR).orderBy("doc_id").collect()
    start = 0
    for (doc, text), a, b in zip(rows, stored, coded, strict=True):
        ids = np.array([*word_table.whole([text])[0], 2], "<u4")
        assert tuple(a) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        ids = chunk_table.pieces.encode(text)
        assert tuple(b) == (doc, len(ids), sha(",".join(map(str, ids))), sha(chunk_table.pieces.decode(ids)))


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    words = [f"w{n}" for n in rng.integers(0, 10_000, 6000)]
    long, part = " ".join(words), " ".join(words[1000:2000])
    a, b = fingerprints.sketches([long, part])
    assert fingerprints.containment(b, a) == 1 and abs(fingerprints.containment(a, b) - 1 / 6) < 0.06
    assert 0.1 < len(a) / (len(words) - 4) < 0.15
    assert fingerprints.read(fingerprints.written(a)).tolist() == a.tolist()
    assert fingerprints.merged(fingerprints.written(a), fingerprints.written(b)) == fingerprints.written(a)
    none = a[:0]
    assert (fingerprints.containment(none, none), fingerprints.containment(none, a), fingerprints.containment(a, none)) == (1, 0, 0)


def plain_share(part, whole):
    def grams(text):
        words = [w for w in re.split("[ \t-\r]+", text) if w]
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    a, b = grams(part), grams(whole)
    return len(a & b) / len(a) if a else float(not b)


def test_shares_of_all_lengths(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 50, size)) for size in [*range(60), 300, 513, 700, 5000, 8000]]
    texts[61:61] = [texts[40], texts[40]]
    texts += [texts[20], texts[20] + " more", texts[-1], " ".join(texts[-1].split(" ")[50:60])]
    common.session(spark)
    got = fingerprints.compare_with_next(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        text, following = texts[r["id"]], texts[(r["id"] + 1) % len(texts)]
        changed = fingerprints.edited(text, following)
        near = 0.001 if max(len(x.split(" ")) for x in (text, following, changed)) <= fingerprints.LEAST else 0.08
        assert abs(r["near_edited"] - plain_share(text, changed)) <= near
        assert abs(r["near_next"] - plain_share(text, following)) <= near
    short = [texts[n] for n in range(1, 40)]
    for a, b, text, following in zip(fingerprints.sketches(short), fingerprints.sketches(short[1:]), short, short[1:]):
        assert len(a) and fingerprints.containment(a, b) == pytest.approx(plain_share(text, following))


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_neighbours(spark, parts):
    rows = sorted(((r["doc_id"], r["text"]) for r in documents(spark).collect()),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprints.compare_with_next(documents(spark)).collect()
        assert fingerprints.compare_with_next(documents(spark).limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = []
    for (doc, text), (_, following) in zip(rows, [*rows[1:], rows[0]]):
        text, following = text or "", following or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        a, b, c = fingerprints.sketches([text, changed, following])
        want.append((doc, len(text), sha(changed), fingerprints.written(a), fingerprints.written(b),
                     fingerprints.containment(a, b), fingerprints.containment(a, c)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_fingerprint_query(spark):
    got = driver.queries()["op7_fingerprints"](spark, SF_DIR).orderBy("doc_id").collect()
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    for at, ((doc, text), row) in enumerate(zip(rows, got, strict=True)):
        following, half = rows[(at + 1) % len(rows)][1], len(text) // 2
        assert (row["doc_id"], row["n_chars"], row["edited_sha256"]) == (doc, len(text), sha(text[:len(text) - half] + following[:half]))
    sizable = [r for r in got if r["n_chars"] > 2000]
    assert sum(r["near_edited"] for r in sizable) / len(sizable) > 0.4 > 0.1 > np.median([r["near_next"] for r in sizable])
