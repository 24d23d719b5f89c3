"""Near duplicates by fast similarity sketching, banding and exact verification.

A document's set are its distinct two-word shingles.  Its sketch has ``SKETCH`` coordinates and is filled in rounds: in each of the first
``SKETCH`` rounds every shingle is thrown into one coordinate by that round's hash function, and a coordinate keeps the least value of
the first round that reached it; the next ``SKETCH`` rounds throw all shingles into one coordinate each, so that none is left
empty.  Large sets are done after a round or two, and sets agree on each coordinate with the probability of their Jaccard
similarity.  Sketches that agree on all ``ROWS`` coordinates of one of ``SKETCH // ROWS`` bands are candidates; whole sets decide.

Documents with equal sets are one set from the start.  Links are wanted for what they connect, so the sets of a bucket are first
compared with its least set only.  Once those links are chained, a bucket whose sets are all connected is done, however
large.  In the others every set outside the bucket's largest chain is compared with all sets of other chains: by sketches, in
blocks of bounded size, and on whole sets where these agree on enough (``MARGIN`` to spare).  So no link between chains is
passed over, and a large group of near copies costs its size, not the square.

Defined cases: a NULL text or one without words has an empty set, and is linked with nothing; a text of one word has one shingle;
documents with equal sets are linked; NULL ids are the greatest; rows that share an id are documents of their own; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgrid.llm.common import materialise, mixed, shingle_hashes, slices, table
from snapgrid.llm.ngram_join import components

SIMILARITY = 80  # percent
SHINGLE = 2
SKETCH = 160
ROWS = 5
MARGIN = 0.15
BLOCK = 1000
BLOCK_GRAMS = 4_000_000
_EMPTY = np.uint64(2 ** 64 - 1)
_ROUNDS = mixed(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64))


def fast_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``SKETCH`` 32-bit coordinates for each set of 64-bit hashes; an empty set's are all equal."""
    out = np.full((len(sets), SKETCH), _EMPTY)
    flat, owner = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    open_rows = np.unique(owner)
    for number in range(2 * SKETCH):
        if not len(flat):
            break
        thrown = mixed(flat ^ _ROUNDS[number])
        at = (thrown >> np.uint64(40)) * np.uint64(SKETCH) >> np.uint64(24) if number < SKETCH else np.uint64(number - SKETCH)
        value = np.uint64(number) << np.uint64(40) | thrown & np.uint64(2 ** 40 - 1)
        np.minimum.at(out.reshape(-1), owner * SKETCH + np.asarray(at, dtype=np.int64), value)
        full = open_rows[(out[open_rows] != _EMPTY).all(axis=1)]
        if len(full):
            open_rows = np.setdiff1d(open_rows, full, assume_unique=True)
            live = np.zeros(len(sets), dtype=bool)
            live[open_rows] = True
            flat, owner = flat[live[owner]], owner[live[owner]]
    return (mixed(out) >> np.uint64(32)).astype(np.uint32)


def _sets(piece: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    texts = piece.column("text").cast(pa.binary()).to_pylist()
    return shingle_hashes([(text or b"").lower() for text in texts], shingle)  # of bytes, only A-Z are lowered


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def described(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, text_hash, set, size, sketch) of (id, text, text_hash); an empty set's name is NULL."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            sets = _sets(piece, shingle)
            sketches = fast_sketches(sets)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("text_hash"), pa.array([_digest(x) if len(x) else None for x in sets], pa.binary()),
                 pa.array(map(len, sets), pa.int64()), pa.array([row.tobytes() if len(x) else None for row, x in zip(sketches, sets)], pa.binary())],
                ["id", "text_hash", "set", "size", "sketch"])

    id_type = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {id_type}, text_hash bigint, set binary, size bigint, sketch binary")


def banded(sets: DataFrame) -> DataFrame:
    """(band, key, set): a key for each band of a sketch."""
    keys = [F.struct(F.lit(band).alias("band"), F.xxhash64(F.lit(band), F.substring("sketch", band * 4 * ROWS + 1, 4 * ROWS)).alias("key"))
            for band in range(SKETCH // ROWS)]
    return sets.select(F.inline(F.array(*keys)), "set")


def likely(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and sketches allow the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other = (np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint32).reshape(-1, SKETCH) for name in ("sketch_a", "sketch_b"))
                keep = (one == other).mean(axis=1) >= similarity / 100 - MARGIN
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    def side(name: str) -> DataFrame:
        return sets.select(F.col("set").alias(name), F.col("size").alias(f"size_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    met = pairs.join(side("a"), "a").join(side("b"), "b")
    near = 100 * F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b")
    return met.where(near).select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a binary, b binary")


def grams_of(pairs: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(set, grams) of the sets in the pairs, read again from one text of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            found = _sets(piece, shingle)
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(_digest, found), pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["set", "grams"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    chosen = materialise(sets.join(wanted, "set", "left_semi").select(F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("first_hash")), "mh-chosen")
    # the chosen documents grow with the input, so they are not to be broadcast at any size
    read = texts.join(chosen.hint("merge"), (F.col("text_hash") == F.col("first_hash")) & F.col("id").eqNullSafe(F.col("first_id")), "left_semi")
    return read.select("text").mapInArrow(run, "set binary, grams array<bigint>").groupBy("set").agg(F.first("grams").alias("grams"))


def verified(pairs: DataFrame, grams: DataFrame, similarity: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""
    one, other = (grams.select(F.col("set").alias(name), F.col("grams").alias(f"grams_{name}")) for name in ("a", "b"))
    met = pairs.join(one, "a").join(other, "b").withColumn("common", F.size(F.array_intersect("grams_a", "grams_b")))
    union = F.size("grams_a") + F.size("grams_b") - F.col("common")
    return met.where(100 * F.col("common") >= similarity * union).select("a", "b")


def _blocks(members: DataFrame) -> DataFrame:
    """(key, i, j, band, outside, set, label, fringe): what a task's group compares, a block of the outer sets with a block of all.

    ``members`` are (key, band, set, label, size).  A set is outer where its chain is not the bucket's largest.
    """
    chains = members.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    largest = chains.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.sum("grams").alias("grams"),
                                        F.count("*").alias("labels")).where("labels > 1")
    count = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("grams") / BLOCK_GRAMS)).cast("int")
    outer = F.ceil(count * (F.col("n") - F.col("main.n")) / F.col("n")).cast("int")
    mixed_ones = materialise(largest.select("key", F.col("main.label").alias("main"), count.alias("blocks"), outer.alias("outer_blocks")), "mh-mixed")
    met = members.join(mixed_ones, "key").select("key", "band", "set", "label", "blocks", "outer_blocks", (F.col("label") != F.col("main")).alias("fringe"))

    def own(blocks: str):
        return F.pmod(F.xxhash64(F.lit(blocks), "set"), F.col(blocks)).cast("int")

    def upto(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    kept = ["key", "band", "set", "label", "fringe"]
    inside = met.select(*kept, upto("outer_blocks").alias("i"), own("blocks").alias("j"), F.lit(False).alias("outside"))
    outside = met.where("fringe").select(*kept, own("outer_blocks").alias("i"), upto("blocks").alias("j"), F.lit(True).alias("outside"))
    return inside.unionByName(outside)


class _Group:
    """The outer sets and all sets of one group."""

    def __init__(self, rows: pa.Table, similarity: int):
        self.rows, self.similarity = rows, similarity
        self.sets, self.labels = rows["set"].to_numpy(zero_copy_only=False), rows["label"].to_numpy(zero_copy_only=False)
        self.sizes, self.band = rows["size"].to_numpy(), rows["band"][0].as_py()
        outside, self.fringe = rows["outside"].to_numpy(zero_copy_only=False), rows["fringe"].to_numpy(zero_copy_only=False)
        self.outer, self.all = np.flatnonzero(outside), np.flatnonzero(~outside)
        self.sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint32).reshape(len(self.sets), SKETCH)

    def partners(self, y: int) -> np.ndarray:
        """Sets of other chains that may be linked to this one, and meet it in no earlier band."""
        x = self.all[(self.labels[self.all] != self.labels[y]) & (~self.fringe[self.all] | (self.sets[self.all] > self.sets[y]))]
        small, large = np.minimum(self.sizes[x], self.sizes[y]), np.maximum(self.sizes[x], self.sizes[y])
        x = x[100 * small >= self.similarity * large]
        same = self.sketch[x] == self.sketch[y]
        near = same.mean(axis=1) >= self.similarity / 100 - MARGIN
        first = same.reshape(len(x), SKETCH // ROWS, ROWS).all(axis=2).argmax(axis=1)
        return x[near & (first == self.band)]


_MEMBER = "key bigint, i int, j int, band int, outside boolean, set binary, label binary, fringe boolean"


def _promising(similarity: int):
    """Members of a group with a possible partner."""
    def run(rows: pa.Table) -> pa.Table:
        group, wanted = _Group(rows, similarity), set()
        for y in group.outer:
            if len(x := group.partners(y)):
                wanted.update([y, *x.tolist()])
        return rows.select([field.split()[0] for field in _MEMBER.split(", ")]).take(pa.array(sorted(wanted), pa.int64()))
    return run


def _linked(similarity: int):
    """(a, b): links of a group's outer sets, one for each other chain that a set is linked to."""
    def run(rows: pa.Table) -> pa.Table:
        group = _Group(rows, similarity)
        names, tokens = np.unique(rows["grams"].combine_chunks().flatten().to_numpy(), return_inverse=True)
        starts, held, out = np.cumsum(group.sizes) - group.sizes, np.zeros(len(names), dtype=bool), []
        for y in group.outer:
            if not len(x := group.partners(y)):
                continue
            mine = tokens[starts[y]:starts[y] + group.sizes[y]]
            held[mine] = True
            common = np.add.reduceat(held[tokens], starts, dtype=np.int64)[x]
            held[mine] = False
            near = x[100 * common >= similarity * (group.sizes[y] + group.sizes[x] - common)]
            out += [(group.sets[y], other) for other in dict(zip(group.labels[near], group.sets[near])).values()]
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY,
                    shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, set, size, class_set, class_id): every row's component, by its least set and its least id."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    rows = materialise(described(texts, shingle), "mh-described")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first")
    sets = materialise(rows.where("set IS NOT NULL").groupBy("set").agg(
        first, F.first("size").alias("size"), F.first("sketch").alias("sketch")), "mh-sets")

    member = banded(sets)
    buckets = materialise(member.groupBy("key").agg(F.count("*").alias("n"), F.min("set").alias("head")).where("n > 1"), "mh-buckets")
    members = materialise(member.join(buckets, "key"), "mh-members")
    star = members.where("set <> head").select(F.col("head").alias("a"), F.col("set").alias("b")).distinct()
    star = materialise(likely(star, sets, similarity), "mh-star")
    links = materialise(verified(star, grams_of(star, sets, texts, shingle), similarity), "mh-links")

    label = F.coalesce("least", "set").alias("label")
    labels = components(links).withColumnRenamed("node", "set")
    named = materialise(sets.select("set", "size", "sketch").join(labels, "set", "left").select("set", "size", "sketch", label), "mh-labels")
    apart = members.where("n > 2").select("key", "band", "set").join(named.select("set", "size", "label"), "set")
    blocks = _blocks(apart).join(named.select("set", "size", "sketch"), "set")
    wanted = materialise(blocks.groupBy("key", "i", "j").applyInArrow(_promising(similarity), _MEMBER), "mh-wanted")
    pairs = wanted.select(F.col("set").alias("a"), F.col("set").alias("b"))
    full = wanted.join(named.select("set", "size", "sketch"), "set").join(grams_of(pairs, sets, texts, shingle), "set")
    more = materialise(full.groupBy("key", "i", "j").applyInArrow(_linked(similarity), "a binary, b binary"), "mh-more-links")

    classes = components(links.unionByName(more)).withColumnRenamed("node", "set")
    classed = materialise(sets.select("set", "first").join(classes, "set", "left").select("set", "first", F.coalesce("least", "set").alias("class_set")), "mh-classes")
    heads = classed.groupBy("class_set").agg(F.min("first").alias("head"))
    found = classed.join(heads, "class_set").select("set", "class_set", F.col("head.id").alias("class_id"))
    out = rows.select("id", "text_hash", "set", "size").join(found, "set", "left")
    return out.select("id", "text_hash", "set", "size", "class_set", F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("class_id").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


# The same by all pairs that share a shingle.
OP11_SQL = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest([array_to_string(words[i:i + {SHINGLE} - 1], ' ')
    FOR i IN range(1, greatest(len(words) - {SHINGLE} + 1, least(len(words), 1)) + 1)]) AS gram
  FROM worded
), sizes AS (
  SELECT doc_id, count(*) AS size FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), near AS (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * n >= {SIMILARITY} * (s.size + t.size - n)
), reached AS (
  SELECT a, b FROM near UNION SELECT r.a, n.b FROM reached r JOIN near n ON n.a = r.b
), least AS (
  SELECT d.doc_id, coalesce(any_value(z.size), 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.b)) AS component_id
  FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN reached r ON r.a = d.doc_id GROUP BY d.doc_id
)
SELECT *, doc_id = component_id AS kept FROM least
"""
