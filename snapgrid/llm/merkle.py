"""Merkle manifests of a dataset, with a witness for every row.

A row is a leaf, the hash of its fields; leaves ascend by id within their group.  Groups are cut into aligned blocks of
``1 << HEIGHT`` leaves.  A block is built by appending its leaves in order: every two open subtrees of one height close
into one, and then the partial witnesses of the leaves below each are extended by the root of the other.  Whatever a
block's own leaves can close, one task closes; its root is then a leaf of the next tree, built the same way, and so on
until each group has one root.  The groups' roots, in order of the groups, are appended to a last tree.  A row's witness is
its own block's, followed by that of its block's root, and so on up.

Places in a group come from ranges of (group, id): a task numbers its rows and only the counts per task and group are
summed.  No task holds more than a block, and texts never leave the task that reads them.

A witness is a list of steps upwards: a byte each, ``LEFT`` or ``RIGHT`` for where the sibling stands, ``ALONE`` for a node
without one, and the siblings' digests, 32 bytes each.  Digests are hashed as lowercase hexadecimal text.

Defined cases: a NULL field hashes as ``-``; NULL groups and NULL ids come first; rows that share an id follow each other by
their leaf; equal rows are leaves of their own; a group of one leaf is its own root, and so is a dataset of one group; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgrid.llm.common import materialise, session, table

HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEFT, RIGHT, ALONE = b"L", b"R", b"."
SIZE = 32


def encoded(column: Column) -> Column:
    """A field as the leaf hashes it: its length in bytes and its value."""
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, fields)).cast("binary"), 256))


def joined(*digests: bytes) -> bytes:
    """The node over one or two nodes."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def folded(leaf: bytes, sides: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    node, at = leaf.hex().encode(), 0
    for side in sides:
        if side == ALONE[0]:
            both = node
        else:
            sibling = siblings[at:at + SIZE].hex().encode()
            both, at = sibling + node if side == LEFT[0] else node + sibling, at + SIZE
        node = hashlib.sha256(both).hexdigest().encode()
    return bytes.fromhex(node.decode())


def append_all(leaves: list[bytes], height: int | None) -> tuple[bytes, list[bytes], list[bytes]]:
    """(root, sides, siblings) of leaves appended in order.

    ``height`` is how far the tree is to grow, a last lone node being hashed alone at each step; None is until one node is left.
    """
    most = height if height is not None else max(0, (len(leaves) - 1).bit_length())
    sides = np.full((len(leaves), most), ALONE[0], dtype=np.uint8)
    siblings = np.zeros((len(leaves), most, SIZE), dtype=np.uint8)
    subtrees: list[tuple[int, int, int, bytes]] = []  # open ones: height, first leaf, end, root

    def close(at: int, left: tuple, right: tuple) -> tuple[int, int, int, bytes]:
        sides[left[1]:left[2], at], sides[right[1]:right[2], at] = RIGHT[0], LEFT[0]
        siblings[left[1]:left[2], at] = np.frombuffer(right[3], np.uint8)
        siblings[right[1]:right[2], at] = np.frombuffer(left[3], np.uint8)
        return at + 1, left[1], right[2], joined(left[3], right[3])

    for place, leaf in enumerate(leaves):
        subtrees.append((0, place, place + 1, leaf))
        while len(subtrees) > 1 and subtrees[-1][0] == subtrees[-2][0]:
            right, left = subtrees.pop(), subtrees.pop()
            subtrees.append(close(left[0], left, right))
    while len(subtrees) > 1 or subtrees[-1][0] < most:  # the run at the end of each step has one node
        grown, first, end, root = subtrees.pop()
        if subtrees and subtrees[-1][0] == grown:
            subtrees.append(close(grown, subtrees.pop(), (grown, first, end, root)))
        else:
            subtrees.append((grown + 1, first, end, joined(root)))
    kept = sides != ALONE[0]
    return subtrees[0][3], [row.tobytes() for row in sides], [row[has].tobytes() for row, has in zip(siblings, kept)]


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """(part, place) added to (group, ...): the row's place among its group's rows in its range; ranges ascend with part."""
    spark = session(rows.sparkSession)
    keys = [F.col("group").asc_nulls_first(), *order, F.col("tie").asc()]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    names = ranged.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = np.empty(batch.num_rows, dtype=np.int64)
            for at, group in enumerate(batch.column("group").to_pylist()):
                count = count + 1 if group == last else 0
                places[at], last = count, group
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(places)], [*names, "part", "place"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    return ranged.mapInArrow(run, f"{types}, part int, place bigint").drop("tie")


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """(pos, total) added to (group, ...): the row's place in its whole group, and the group's size."""
    stored = materialise(numbered(rows, *order), "merkle-leaves")
    counts = stored.groupBy("group", "part").agg(F.count("*").alias("n"))  # a row per range and group in it
    whole = Window.partitionBy("group")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("group").alias("of"), F.col("part").alias("of_part"), F.sum("n").over(whole).alias("total"),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    met = stored.join(bases, F.col("group").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    return met.withColumn("pos", F.col("base") + F.col("place")).drop("of", "of_part", "part", "place", "base")


def witnesses(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The tree over each group's nodes: (sides, siblings, root) added to (group, pos, total, hash, ...)."""
    names = nodes.columns

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        whole = rows["total"][0].as_py() <= 1 << height
        root, sides, siblings = append_all(rows["hash"].to_pylist(), None if whole else height)
        return pa.table([*(rows[name] for name in names), pa.array(sides, pa.binary()), pa.array(siblings, pa.binary()),
                         pa.array([root] * len(rows), pa.binary())], [*names, "sides", "siblings", "root"])

    block = F.shiftright("pos", height)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    inner = nodes.groupBy("group", block).applyInArrow(run, f"{types}, sides binary, siblings binary, root binary")
    inner = materialise(inner, "merkle-blocks")
    open_blocks = inner.where((F.col("total") > 1 << height) & (F.col("pos") % (1 << height) == 0))
    if open_blocks.isEmpty():
        return inner
    above = open_blocks.select("group", block.alias("pos"), F.shiftright(F.col("total") + ((1 << height) - 1), height).alias("total"),
                               F.col("root").alias("hash"))
    upper = witnesses(above, height).select(
        F.col("group").alias("of"), F.col("pos").alias("of_block"), F.col("sides").alias("more_sides"),
        F.col("siblings").alias("more_siblings"), F.col("root").alias("last"))
    met = inner.join(upper, F.col("group").eqNullSafe(F.col("of")) & (block == F.col("of_block")), "left")
    empty = F.lit(b"")
    return met.select(*names, F.concat("sides", F.coalesce("more_sides", empty)).alias("sides"),
                      F.concat("siblings", F.coalesce("more_siblings", empty)).alias("siblings"), F.coalesce("last", "root").alias("root"))


def manifest(rows: DataFrame, group_col: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS,
             height: int = HEIGHT, carry: dict[str, Column] | None = None) -> DataFrame:
    """(group, id, leaf, subroot, root, sides, siblings) of every row, all digests binary.

    ``carry`` names further columns to compute beside the leaf and keep.
    """
    if height < 1:
        raise ValueError("a block has at least two leaves")
    more = carry or {}
    leaves = materialise(rows.select(
        F.col(group_col).alias("group"), F.col(id_col).alias("id"), leaf_of(*map(F.col, fields)).alias("hash"),
        *[column.alias(name) for name, column in more.items()]), "merkle-rows")
    inner = witnesses(placed(leaves, F.col("id").asc_nulls_first(), F.col("hash").asc()), height).withColumnRenamed("root", "subroot")

    roots = inner.where("pos = 0").select(F.lit(0).alias("group"), F.col("group").alias("key"), F.col("subroot").alias("hash"))
    top = witnesses(placed(roots, F.col("key").asc_nulls_first()), height).select(
        "key", F.col("sides").alias("top_sides"), F.col("siblings").alias("top_siblings"), "root")
    met = inner.join(top, F.col("group").eqNullSafe(F.col("key")))
    return met.select("group", "id", F.col("hash").alias("leaf"), "subroot", "root", F.concat("sides", "top_sides").alias("sides"),
                      F.concat("siblings", "top_siblings").alias("siblings"), *more)


def checked(found: DataFrame, leaf: Column) -> DataFrame:
    """The rows of ``manifest`` as hexadecimal text, with ``proof_sha256`` of the siblings, and ``folded_root`` of ``leaf``."""
    id_type = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides, siblings = batch.column("sides").to_pylist(), batch.column("siblings").to_pylist()
            roots = [folded(*x) for x in zip(batch.column("probe").to_pylist(), sides, siblings)]
            proofs = [hashlib.sha256(x.hex().encode()).hexdigest() for x in siblings]
            texts = [pa.array([x.hex() for x in batch.column(name).to_pylist()], pa.string()) for name in ("leaf", "subroot", "root")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *texts, pa.array(proofs, pa.string()), pa.array([x.hex() for x in roots], pa.string()),
                 pa.array([a == b for a, b in zip(roots, batch.column("root").to_pylist())], pa.bool_())],
                ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return found.select("id", "leaf", "subroot", "root", "sides", "siblings", leaf.alias("probe")).mapInArrow(
        run, f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """Every document's proof, checked with a seventh of the documents tampered with."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    found = manifest(docs, carry={"changed": F.when(tampered & F.col("n_chars").isNotNull(), changed)})
    return checked(found, F.coalesce("changed", "leaf")).withColumnRenamed("id", "doc_id")


# The whole tree level by level, as lists; the checksum by its table of 256 remainders.
OP13_SQL = """
WITH RECURSIVE bits AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
), remainders AS (
  SELECT list(c ORDER BY byte) AS r FROM bits WHERE step = 8
), digits AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR AS name, 0 AS done, 4294967295::BIGINT AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, name, done + 1, xor(c >> 8, r[(xor(c, ascii(name[done + 1])::BIGINT) & 255) + 1])
  FROM digits, remainders WHERE done < length(name)
), checksums AS (
  SELECT doc_id, xor(c, 4294967295) % 7 = 0 AS tampered FROM digits WHERE done = length(name)
), fields AS (
  SELECT d.*, coalesce(s.tampered, false) AND n_chars IS NOT NULL AS tampered,
    coalesce(strlen(d.doc_id::VARCHAR)::VARCHAR || ':' || d.doc_id::VARCHAR, '-')
      || coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS head,
    coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS tail
  FROM documents d LEFT JOIN checksums s ON s.doc_id = d.doc_id
), hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
    CASE WHEN tampered THEN sha256(head || strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1)::VARCHAR || tail) END AS changed
  FROM fields
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed
), trees AS (
  SELECT lang, 0 AS depth, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, depth + 1, [sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) FOR i IN range(0, (len(nodes) + 1) // 2)]
  FROM trees WHERE len(nodes) > 1
), subroots AS (
  SELECT lang, nodes[1] AS subroot, depth AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
  FROM trees WHERE len(nodes) = 1
), tops AS (
  SELECT 0 AS depth, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT depth + 1, [sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) FOR i IN range(0, (len(nodes) + 1) // 2)]
  FROM tops WHERE len(nodes) > 1
), steps AS (
  SELECT l.lang, l.pos, t.depth, l.pos >> t.depth AS own, t.nodes
  FROM leaves l JOIN trees t ON t.lang IS NOT DISTINCT FROM l.lang WHERE len(t.nodes) > 1
  UNION ALL
  SELECT l.lang, l.pos, s.height + t.depth, s.place >> t.depth, t.nodes
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN tops t ON len(t.nodes) > 1
), paths AS (
  SELECT lang, pos, list(coalesce(nodes[xor(own, 1) + 1], '') ORDER BY depth) AS siblings, list(own % 2 = 1 ORDER BY depth) AS on_right
  FROM steps GROUP BY lang, pos
), folds AS (
  SELECT l.lang, l.pos, 0 AS done, coalesce(changed, leaf) AS node, coalesce(siblings, []) AS siblings, coalesce(on_right, []) AS on_right
  FROM leaves l LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos
  UNION ALL
  SELECT lang, pos, done + 1,
    sha256(CASE WHEN on_right[done + 1] THEN siblings[done + 1] || node ELSE node || siblings[done + 1] END), siblings, on_right
  FROM folds WHERE done < len(siblings)
)
SELECT l.doc_id, l.leaf, s.subroot, t.nodes[1] AS root, sha256(array_to_string(f.siblings, '')) AS proof_sha256,
  f.node AS folded_root, f.node = t.nodes[1] AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
JOIN folds f ON f.lang IS NOT DISTINCT FROM l.lang AND f.pos = l.pos AND f.done = len(f.siblings)
JOIN tops t ON len(t.nodes) = 1
"""
