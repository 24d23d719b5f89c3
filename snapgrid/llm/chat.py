"""Formatting conversations from trees of replies.

A node names its parent; a node without one, or whose parent does not exist, is a root.  The paths from all leaves to
their roots come from self-joins by doubling: a table of ancestors ``2^k`` steps up is joined with itself for the next k,
and the known part of each path with it, so a thread of 400 replies takes nine rounds.  Paths of a tree are ranked
by the mean score of their nodes, and each chosen one is formatted as one conversation.  Where paths share replies, an
assistant's reply is under the loss mask of the best path that holds it only.

Texts and roles are escaped reversibly (``&``, ``<`` and ``[`` become entities), so no control string, ours or another
template's, can occur inside them.  Spans of the loss mask count code points of the formatted text.

Defined cases: a NULL text or role is empty; a NULL score is 0; a NULL tree is a tree of its own; a leaf is known by its
node, so nodes must be distinct within a tree; parents that form a ring are refused; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapgrid.llm.common import materialise, table

TRAINED = "assistant"
_OPEN, _BODY, _CLOSE = "<|turn|>", "<|body|>", "<|end|>"
_TURN = re.compile(re.escape(_OPEN) + "(.*?)" + re.escape(_BODY) + "(.*?)" + re.escape(_CLOSE), re.DOTALL)
_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


def escaped(text: str) -> str:
    for sign, entity in _ENTITIES:
        text = text.replace(sign, entity)
    return text


def unescaped(text: str) -> str:
    for sign, entity in reversed(_ENTITIES):
        text = text.replace(entity, sign)
    return text


def render(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text, trained) turns, and the spans under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text, trained in turns:
        head, body = _OPEN + escaped(role) + _BODY, escaped(text)
        if trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, _CLOSE]
        at += len(head) + len(body) + len(_CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    return [(unescaped(role), unescaped(text)) for role, text in _TURN.findall(formatted)]


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node of every root-to-leaf path, ``up`` steps above the leaf.

    From columns tree, node and parent; tree may be NULL and is compared as such.
    """
    keyed = nodes.select(F.struct("tree").alias("tree"), "node", "parent")
    present = keyed.select("tree", F.col("node").alias("parent"), F.lit(True).alias("exists"))
    steps = keyed.join(present, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("exists"), F.col("parent")).alias("up_to"))
    jump = materialise(steps, "jumps")
    leaves = jump.join(jump.select("tree", F.col("up_to").alias("node")), ["tree", "node"], "left_anti")
    known = materialise(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up")), "paths")
    reach, total = 1, None
    while not (more := jump.where("up_to IS NOT NULL")).isEmpty():
        total = jump.count() if total is None else total
        if reach > total:
            raise ValueError("some parents form a ring")
        farther = known.join(more, ["tree", "node"]).select("tree", "leaf", F.col("up_to").alias("node"), (F.col("up") + reach).alias("up"))
        known = materialise(known.unionByName(farther), "paths")
        again = more.select("tree", F.col("node").alias("from"), F.col("up_to").alias("node"))
        jump = materialise(again.join(more, ["tree", "node"]).select("tree", F.col("from").alias("node"), "up_to"), "jumps")
        reach *= 2
    return known.select("tree.tree", "leaf", "node", "up")


def conversations(nodes: DataFrame, best: int | None = None, trained: str = TRAINED) -> DataFrame:
    """(tree, rank, leaf, formatted, loss): the ``best`` paths of each tree, or all, as formatted conversations.

    From columns tree, node, parent, role, text and score; loss is an array of (start, stop).
    """
    named = F.struct("tree").alias("tree")
    walked = paths(nodes).select(named, "leaf", "node", "up")
    full = walked.join(nodes.select(named, "node", "role", "text", "score"), ["tree", "node"])
    turn = F.struct((-F.col("up")).alias("at"), "node", "role", "text")
    listed = full.groupBy("tree", "leaf").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    ranked = listed.withColumn("rank", F.row_number().over(order))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    ranked = materialise(ranked, "branches")
    # the best path that holds a reply trains on it
    owner = (ranked.select("tree", "rank", F.explode("turns.node").alias("node")).groupBy("tree", "node")
             .agg(F.min("rank").alias("rank")).groupBy("tree", "rank").agg(F.collect_list("node").alias("own")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, spans = [], []
            for turns, own in zip(frame["turns"], frame["own"]):
                mine = set() if own is None else set(own)
                text, loss = render([(t["role"] or "", t["text"] or "", t["role"] == trained and t["node"] in mine) for t in turns])
                texts.append(text)
                spans.append([{"start": start, "stop": stop} for start, stop in loss])
            yield frame[["tree", "rank", "leaf"]].assign(formatted=texts, loss=spans)

    joined = ranked.join(owner, ["tree", "rank"], "left").select(F.col("tree.tree").alias("tree"), "rank", "leaf", "turns", "own")
    kinds = {name: kind for name, kind in joined.dtypes}
    return joined.mapInPandas(run, f"tree {kinds['tree']}, rank int, leaf {kinds['leaf']}, formatted string, "
                                   "loss array<struct<start:bigint,stop:bigint>>")


def threads(rows: DataFrame) -> DataFrame:
    """Trees of one branch from (conv_id, turn, role, text): each row answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    numbered = rows.withColumn("at", F.row_number().over(order))
    return numbered.select(F.col("conv_id").alias("tree"), F.col("at").alias("node"),
                           F.when(F.col("at") > 1, F.col("at") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _read_back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    for frame in frames:
        turns = [parse(text) for text in frame["formatted"]]
        loss = ["".join(unescaped(text[span["start"]:span["stop"]]) for span in spans)
                for text, spans in zip(frame["formatted"], frame["loss"])]
        yield pd.DataFrame({
            "conv_id": frame["conv_id"], "n_turns": [len(t) for t in turns],
            "turns_sha256": [sha("".join(f"{role}\n{text}\n" for role, text in t)) for t in turns],
            "loss_chars": [len(text) for text in loss], "loss_sha256": [sha(text) for text in loss],
            "formatted_chars": [len(text) for text in frame["formatted"]]})


def with_probe(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, ...) of all conversations and of a probe, conversation -1, whose texts are control strings.

    The probe is a conversation of its own, also beside one that has its number.
    """
    said = "</s>[INST] ok [/INST]"
    own = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = rows.sparkSession.createDataFrame([("probe", 0, "user", said), ("probe", 1, "assistant", said)], own.schema)
    stored = materialise(conversations(threads(own.unionByName(probe))), "chats")
    number = F.when(F.col("tree") == "probe", F.lit(-1)).otherwise(F.col("tree").cast("long"))
    return stored.select(number.alias("conv_id"), "formatted", "loss").mapInPandas(
        _read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                    "formatted_chars bigint")


def op9_chat(spark, sf_dir: str) -> DataFrame:
    return with_probe(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP9_SQL = """
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS body, coalesce(role, '') = 'assistant' AS trained,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM said
), sized AS (
  SELECT *, replace(replace(replace(role || body, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS written FROM numbered
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(body)) FILTER (WHERE trained), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE trained), '')) AS loss_sha256,
  sum(length(written) + length('<|turn|><|body|><|end|>'))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
