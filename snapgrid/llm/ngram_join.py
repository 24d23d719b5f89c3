"""Near-duplicate documents by a chosen-path join of their word shingles.

Texts become sets of hashes of five lower-cased words; equal sets are one class from the start.  Every set has a sketch of
``SKETCH`` tokens, its least value under as many hash functions, and two sets share a token with the probability of their
Jaccard similarity.  A node of the join is a group of sets; it is split by ``PICKS`` positions chosen by the node's hash:
one child for each token found there.  Small nodes are compared in full.  So are nodes that splitting hardly divides, being
near copies of each other: in blocks, each pair of blocks a task's group of bounded size.  Independent runs are repeated
until the chance that a pair at the threshold meets nowhere is below ``1 - recall``.

A pair that meets more than once counts at the first common leaf only, which either set's list of leaves tells, so links
are counted and chained without a list of pairs ever being made.  Sketches choose candidates (with ``MARGIN`` to spare);
whole sets decide.  Chains of links form classes, by iterated joins.

Defined cases: a NULL text or one without words has no shingles, no links and a class of its own; a text of one to four words has
one shingle; rows with equal sets link to each other; NULL ids are the greatest; a class is told from others by its least
set and only named by its least id, which classes can share where ids are NULL or repeated; an empty table gives no rows;
other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgrid.llm.common import WORD, materialise, mixed, shingle_hashes, slices, table

SIMILARITY = 0.8
SHINGLE = 5
RECALL = 0.999_999
SKETCH = 96
PICKS = 3
SMALL = 800
BLOCK = 800
MARGIN = 0.2
DEPTH = 6
_FACTORS = mixed(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def missed(similarity: float = SIMILARITY, picks: int = PICKS) -> float:
    """The chance that a pair gets lost somewhere on the way down one run, however deep: a branching process dying out."""
    lost = 0.0
    for _ in range(1000):
        lost = (1 - similarity + similarity * lost) ** picks
    return lost


def runs_for(recall: float = RECALL, similarity: float = SIMILARITY, picks: int = PICKS) -> int:
    lost = missed(similarity, picks)
    if lost >= 0.999:
        raise ValueError("at this similarity a pair needs more picks per node")
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def sketch_of(grams: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, in 32 bits."""
    out = np.empty(SKETCH, dtype=np.uint32)
    for number, factor in enumerate(_FACTORS):
        out[number] = (grams * factor).min() >> np.uint64(32)
    return out


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _described(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            sets = shingle_hashes([text or "" for text in piece.column("text").to_pylist()], shingle)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("text_hash"),
                 pa.array([_digest(x) if len(x) else None for x in sets], pa.binary()),
                 pa.array(map(len, sets), pa.int32()),
                 pa.array([sketch_of(x).tobytes() if len(x) else None for x in sets], pa.binary())],
                ["id", "text_hash", "set", "size", "sketch"])
    return run


def _hashed(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _token(sketch: Column, position: Column) -> Column:
    return F.substring(sketch, (position * 4 + 1).cast("int"), F.lit(4))


def _children(members: DataFrame) -> DataFrame:
    """(node, set) of the children of (node, set, sketch): PICKS positions of each node, a child for each token."""
    picks = F.explode(F.array(*[F.pmod(_hashed(F.lit(pick), F.col("node")), F.lit(SKETCH)) for pick in range(PICKS)]))
    picked = members.select("node", "set", "sketch", "parent_size", picks.alias("position"))
    return picked.select(_hashed("node", "position", _token(F.col("sketch"), F.col("position"))).alias("node"), "set", "parent_size")


def _sized(members: DataFrame) -> DataFrame:
    """The members of nodes with company, each once, with the node's size."""
    members = members.distinct()
    sizes = members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    return members.join(sizes, "node")


def leaves(sets: DataFrame, runs: int) -> DataFrame:
    """(node, set, n): members of all leaves, from (set, sketch).  A leaf of over SMALL sets is one that does not divide."""
    positions = [F.struct(F.lit(run).alias("run"), F.lit((run * PICKS + pick) % SKETCH).alias("position"))
                 for run in range(runs) for pick in range(PICKS)]
    first = sets.select("set", "sketch", F.explode(F.array(*positions)).alias("at"))
    first = first.select(_hashed(F.col("at.run"), F.col("at.position"), _token(F.col("sketch"), F.col("at.position"))).alias("node"),
                         "set", F.lit(None).cast("long").alias("parent_size"))
    live, done = materialise(_sized(first), "nodes"), []
    for depth in range(DEPTH):
        # a child of more than half its parent shows that its members are alike
        final = (F.col("n") <= SMALL) | F.coalesce(2 * F.col("n") > F.col("parent_size"), F.lit(False)) | F.lit(depth == DEPTH - 1)
        done.append(live.where(final).select("node", "set", "n"))
        large = live.where(~final)
        if large.isEmpty():
            break
        parents = large.select("node", "set", F.col("n").alias("parent_size")).join(sets.select("set", "sketch"), "set")
        live = materialise(_sized(_children(parents)), "nodes")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _blocks(members: DataFrame) -> DataFrame:
    """(node, bucket, side, set): what one task's group compares; sides differ where two blocks of a leaf meet."""
    count = F.when(F.col("n") <= SMALL, F.lit(1)).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), "set"), count).cast("int")
    rows = members.select("node", "set", own.alias("own"), F.explode(F.sequence(F.lit(0), count - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return rows.select("node", _hashed("node", low, high).alias("bucket"),
                       F.when(low == high, F.lit(-1)).otherwise(F.col("own")).alias("side"), "set")


class _Group:
    """The members of one bucket as arrays."""

    def __init__(self, rows: pa.Table):
        self.sets = rows["set"].to_pylist()
        self.node = rows["node"][0].as_py()
        self.sizes = rows["size"].to_numpy().astype(np.int64)
        self.side = rows["side"].to_numpy()
        self.sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), dtype=np.uint32).reshape(len(self.sets), SKETCH)
        lists = rows["leaves"].to_pylist()
        self.leaves = np.full((len(lists), max(map(len, lists))), np.iinfo(np.int64).max)
        for at, nodes in enumerate(lists):
            self.leaves[at, :len(nodes)] = sorted(nodes)

    def partners(self, i: int, similarity: float) -> np.ndarray:
        """Members after the i-th that its sketch is near to and that it meets here first."""
        j = np.arange(i + 1, len(self.sets))
        small, large = np.minimum(self.sizes[i], self.sizes[j]), np.maximum(self.sizes[i], self.sizes[j])
        j = j[((self.side[j] < 0) | (self.side[j] != self.side[i])) & (small >= similarity * large)]
        j = j[(self.sketch[j] == self.sketch[i]).mean(axis=1) >= similarity - MARGIN]
        if len(j):
            shared = np.isin(self.leaves[j], self.leaves[i][self.leaves[i] < np.iinfo(np.int64).max])
            earliest = np.where(shared, self.leaves[j], np.iinfo(np.int64).max).min(axis=1)
            j = j[earliest == self.node]
        return j


def _candidates(similarity: float):
    def run(rows: pa.Table) -> pa.Table:
        group, wanted = _Group(rows), set()
        for i in range(len(group.sets)):
            if len(j := group.partners(i, similarity)):
                wanted.add(i)
                wanted.update(j.tolist())
        return rows.select(["node", "bucket", "side", "set"]).take(pa.array(sorted(wanted), pa.int64()))
    return run


def _verified(similarity: float):
    """(set, hub, links) of each member with links: documents it links to, and the least set chained to it here."""
    def run(rows: pa.Table) -> pa.Table:
        group, copies = _Group(rows), rows["copies"].to_numpy().astype(np.int64)
        grams = [np.frombuffer(x, dtype=np.uint64) for x in rows["grams"].to_pylist()]
        names, tokens = np.unique(np.concatenate(grams), return_inverse=True)
        starts = np.cumsum([0, *map(len, grams)])
        n = len(grams)
        links, chain, held = np.zeros(n, dtype=np.int64), list(range(n)), np.zeros(len(names), dtype=bool)

        def root(x: int) -> int:
            while chain[x] != x:
                chain[x] = chain[chain[x]]
                x = chain[x]
            return x

        for i in range(n):
            if not len(j := group.partners(i, similarity)):
                continue
            mine = tokens[starts[i]:starts[i + 1]]
            held[mine] = True
            after = int(j[0])
            common = np.add.reduceat(held[tokens[starts[after]:]], starts[after:n] - starts[after], dtype=np.int64)[j - after]
            held[mine] = False
            near = j[common >= similarity * (len(mine) + group.sizes[j] - common) - 1e-9]
            links[i] += copies[near].sum()
            links[near] += copies[i]
            for other in near:
                a, b = root(i), root(int(other))
                if group.sets[a] <= group.sets[b]:
                    chain[b] = a
                else:
                    chain[a] = b
        met = [x for x in range(n) if links[x]]
        return pa.table({"set": pa.array([group.sets[x] for x in met], pa.binary()),
                         "hub": pa.array([group.sets[root(x)] for x in met], pa.binary()),
                         "links": pa.array(links[met], pa.int64())})
    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, least): the least node that each is connected to, from (a, b), by least neighbours and pointer jumps."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    marks = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                        .select("node", F.least("node", "m").alias("least")), "marks")
    while True:
        heard = (both.join(marks, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("least").alias("heard")))
        told = marks.join(heard, "node").select("node", F.col("least").alias("old"), F.least("least", "heard").alias("least"))
        jump = marks.select(F.col("node").alias("via"), F.col("least").alias("next"))
        now = materialise(told.join(jump, F.col("least") == F.col("via"), "left")
                          .select("node", "old", F.least("least", F.coalesce("next", "least")).alias("least")), "marks")
        if now.where("least <> old").isEmpty():
            return now.select("node", "least")
        marks = now.select("node", "least")


def _sets_of(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            sets = shingle_hashes([text or "" for text in piece.column("text").to_pylist()], shingle)
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(_digest, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["set", "grams"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                    recall: float = RECALL, shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, set, least, class_id, n_links): every row's class (its least set and least id) and number of near documents."""
    texts = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"),
                        F.xxhash64(text_col).alias("text_hash"))
    id_type = texts.schema["id"].dataType.simpleString()
    rows = materialise(texts.mapInArrow(
        _described(shingle), f"id {id_type}, text_hash bigint, set binary, size int, sketch binary"), "described")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first")
    sets = materialise(rows.where("set IS NOT NULL").groupBy("set").agg(
        F.count("*").alias("copies"), first, F.first("size").alias("size"), F.first("sketch").alias("sketch")), "sets")

    members = materialise(leaves(sets.select("set", "sketch"), runs_for(recall, similarity)), "leaves")
    listed = sets.select("set", "size", "sketch").join(members.groupBy("set").agg(F.collect_list("node").alias("leaves")), "set")
    listed = materialise(listed, "listed")
    grouped = _blocks(members).join(listed, "set")
    wanted = materialise(grouped.groupBy("bucket").applyInArrow(
        _candidates(similarity), "node bigint, bucket bigint, side int, set binary"), "candidates")

    chosen = materialise(sets.join(wanted.select("set").distinct(), "set", "left_semi")
                         .select(F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("first_hash")), "chosen")
    # the chosen documents grow with the input, so they are not to be broadcast at any size
    read = texts.join(chosen.hint("merge"), (F.col("text_hash") == F.col("first_hash")) & F.col("id").eqNullSafe(F.col("first_id")), "left_semi")
    grams = read.select("text").mapInArrow(_sets_of(shingle), "set binary, grams binary").groupBy("set").agg(
        F.first("grams").alias("grams"))
    full = listed.join(sets.select("set", "copies"), "set").join(grams, "set")
    found = materialise(wanted.join(full, "set").groupBy("bucket").applyInArrow(
        _verified(similarity), "set binary, hub binary, links bigint"), "links")

    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("set").alias("a"), F.col("hub").alias("b")))
    named = (sets.join(classes.withColumnRenamed("node", "set"), "set", "left").join(links, "set", "left")
             .select("set", "copies", "first", F.coalesce("least", "set").alias("least"), F.coalesce("links", F.lit(0)).alias("links")))
    heads = named.groupBy("least").agg(F.min("first").alias("head"))
    named = materialise(named.join(heads, "least").select(
        "set", "least", F.col("head.id").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links")), "classes")
    out = rows.select("id", "text_hash", "set").join(named, "set", "left")
    return out.select("id", "text_hash", "set", "least", F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of one document of each class, the least id; rows without shingles stay, all of them."""
    worded = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    found = near_duplicates(docs.where(worded), id_col, text_col, **more)
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_hash"))
    stay = found.groupBy("least").agg(F.min(first).alias("first"))
    stay = materialise(stay.select(F.col("first.id").alias("stay_id"), F.col("first.text_hash").alias("stay_hash")), "stay")
    rows = docs.where(worded).select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    kept = rows.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("text_hash") == F.col("stay_hash")), "left_semi")
    # rows equal in id and text are one document
    copy = F.row_number().over(Window.partitionBy("id", "text_hash").orderBy(F.xxhash64("row")))
    return kept.withColumn("copy", copy).where("copy = 1").select("row.*").union(docs.where(~worded))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links")


# The same by all pairs that share a shingle, for small tables.
OP1_SQL = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
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
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE n >= {SIMILARITY} * (s.size + t.size - n)
), reached AS (
  SELECT a, b FROM near UNION SELECT r.a, n.b FROM reached r JOIN near n ON n.a = r.b
)
SELECT d.doc_id, least(d.doc_id, min(r.b)) AS class_id, (SELECT count(*) FROM near WHERE near.a = d.doc_id) AS n_links
FROM documents d LEFT JOIN reached r ON r.a = d.doc_id GROUP BY d.doc_id
"""
