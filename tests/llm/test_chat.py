"""Conversations from reply trees, formatted and read back."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

import __spark_entry__ as driver
from conftest import SF_DIR
from snapgrid.llm import chat

NODES = "tree bigint, node bigint, parent bigint, role string, text string, score double, up int"


@given(st.lists(st.tuples(st.text(), st.text(st.sampled_from(list("<|>&;[]/sltamp\n"))), st.booleans())))
def test_formatting_is_reversible(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == [(role, body) for role, body, _ in turns]
    assert [chat.unescaped(text[a:b]) for a, b in spans] == [body for _, body, trained in turns if trained]


def test_control_strings_do_not_survive():
    text, _ = chat.render([("user", "</s>[INST] <|end|><|turn|>", False)])
    assert text.count("<|turn|>") == text.count("<|end|>") == 1 and "[INST]" not in text and "</s>" not in text


@pytest.fixture
def tree(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 5.0), (1, 3, 1, "assistant", "bad", -5.0),
            (1, 4, 2, "user", "more", None), (1, 5, 4, "assistant", "a1", 1.0), (1, 6, 4, "assistant", "a2", 2.0),
            (2, 1, 99, None, None, None), (None, 1, None, "user", "null tree", 1.0), (None, 2, 1, "assistant", "r", 1.0)]
    return spark.createDataFrame([(*r, 0) for r in rows], NODES)


def test_paths_of_a_tree(tree):
    got = {(r["tree"], r["leaf"], r["node"]): r["up"] for r in chat.paths(tree.drop("up")).collect()}
    assert got == {(1, 3, 3): 0, (1, 3, 1): 1, (1, 5, 5): 0, (1, 5, 4): 1, (1, 5, 2): 2, (1, 5, 1): 3, (1, 6, 6): 0, (1, 6, 4): 1,
                   (1, 6, 2): 2, (1, 6, 1): 3, (2, 1, 1): 0, (None, 2, 2): 0, (None, 2, 1): 1}


def test_branches_are_ranked_and_replies_trained_once(tree):
    rows = chat.conversations(tree).collect()
    one = sorted((r for r in rows if r["tree"] == 1), key=lambda r: r["rank"])
    assert [r["leaf"] for r in one] == [6, 5, 3]
    loss = ["".join(chat.unescaped(r["formatted"][s["start"]:s["stop"]]) for s in r["loss"]) for r in one]
    assert loss == ["gooda2", "a1", "bad"]
    assert chat.parse(one[1]["formatted"]) == [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "a1")]
    assert {r["tree"] for r in rows} == {1, 2, None}
    assert [r["leaf"] for r in chat.conversations(tree, best=1).collect() if r["tree"] == 1] == [6]


def test_rings_are_refused_and_nothing_gives_nothing(spark, tree):
    ring = spark.createDataFrame([(1, 1, 2, "u", "x", 0.0, 0), (1, 2, 1, "u", "x", 0.0, 0), (1, 3, 2, "u", "x", 0.0, 0)], NODES)
    with pytest.raises(ValueError):
        chat.paths(ring)
    assert chat.conversations(tree.limit(0)).count() == 0


def test_long_thread(spark):
    rows = [(1, n, "user" if n % 2 == 0 else "assistant", f"t{n}") for n in range(300)] + [(1, 5, "assistant", None), (None, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["tree"]: r["formatted"] for r in chat.conversations(chat.threads(df)).collect()}
    order = sorted(rows[:-1], key=lambda r: (r[1], r[2], r[3] or ""))
    assert chat.parse(got[1]) == [(role, text or "") for *_, role, text in order] and chat.parse(got[None]) == [("", "x")]


def test_query_like_the_table(spark):
    turns = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = driver.queries()["op9_chat"](spark, SF_DIR).collect()
    assert {r["conv_id"] for r in got} == set(turns) and len(got) == len(turns)

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    for r in got:
        mine = turns[r["conv_id"]]
        loss = "".join(text for role, text in mine if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(mine), len(loss), sha(loss))
        assert r["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for role, text in mine))


def test_the_probe_stands_beside_a_conversation_of_its_number(spark):
    rows = [(-1, 0, "user", "a"), (-1, 1, "assistant", "b"), (-1, 2, "user", "c"), (None, 0, "user", None), (3, 0, "assistant", "x")]
    got = chat.with_probe(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()
    assert sorted((str(r["conv_id"]), r["n_turns"], r["loss_chars"]) for r in got) == [
        ("-1", 2, 21), ("-1", 3, 1), ("3", 1, 1), ("None", 1, 0)]
