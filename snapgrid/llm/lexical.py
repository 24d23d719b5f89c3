"""Ranked lexical search over an index whose strata hold documents of one length normaliser.

A document's normaliser ``m`` follows from its number of terms and the corpus' totals, and a term's impact on a document
depends on nothing but its occurrences ``tf`` and ``m``.  The index therefore groups documents by equal ``m`` into strata, cut into
slices of bounded size, and keeps a slice's postings by term and then by ``tf``: an impact is worked out once per ``tf`` of a slice,
and a term's greatest ``tf`` bounds what any document of the slice can score.

A search takes the items in blocks of bounded size against the whole index, in three scans.  The first counts in how many
documents each term stands.  The second reads bounds only, and visits for each item the slices with the highest ones: the k-th score
found there is one that every hit has to reach.  The third visits, for each item, the slices whose bound reaches it, highest
first within a batch, and keeps raising it.  Nothing is left out: a slice is passed over only if no document in it can be a hit.

Terms are the maximal runs of ``[A-Za-z0-9]`` and of characters beyond ASCII, only A-Z lower-cased.

Defined cases: NULL and empty texts have no term and are in no slice; rows that share an id are documents of their own, and
NULL ids come last among equal scores; items that share an id are one, with the terms of all its rows, and so are items
without an id; an item without a term, or with none that a document has, has no hit; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgrid.llm.common import materialise, session, slices, table
from snapgrid.session import scratch_dir

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
HITS = 10
SLICE_DOCS = 1000
SLICE_BYTES = 2_000_000
BLOCK_TERMS = 100_000
BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values of the scoring function.
SCALE, TF_FACTOR, M_FACTOR = 1_000_000_000, 1000, 8
BASE, SLOPE = 100, 90

_INDEX = ("m bigint, slice bigint, ids array<bigint>, terms array<string>, holders array<int>, top_tf array<int>, "
          "tf array<int>, pos array<int>")


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return SCALE * tf // (TF_FACTOR * tf + M_FACTOR * m)


def weight(total: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * holders + 1)))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms in order, and the number of each text's."""
    coded = [text or b"" for text in texts.cast(pa.binary()).to_pylist()]
    data = np.frombuffer(b"\n".join(coded) + b"\n", dtype=np.uint8)
    upper = (data >= 65) & (data <= 90)
    data = data + (upper.astype(np.uint8) << 5)
    inside = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    edges = np.diff(np.concatenate(([False], inside)).view(np.int8))
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int64)
    letters = data[inside].tobytes()
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters)])
    ends = np.cumsum([len(text) + 1 for text in coded])
    return words, np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))


def indexed(m: int, number: int, ids: list, texts: pa.Array) -> tuple:
    """One row of the index: a slice of documents in order of their ids."""
    words, counts = words_of(texts)
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    term, doc = rank[coded.indices.to_numpy()], np.repeat(np.arange(len(counts)), counts)
    pairs, tf = np.unique(term * len(counts) + doc, return_counts=True)
    term, doc = np.divmod(pairs, len(counts))
    sort = np.lexsort((doc, tf, term))
    term, doc, tf = term[sort], doc[sort], tf[sort]
    holders = np.bincount(term, minlength=len(order))
    return m, number, ids, coded.dictionary.take(pa.array(order)), holders, tf[np.cumsum(holders) - 1], tf, doc


def _row(made: tuple) -> pa.RecordBatch:
    m, number, ids, terms, *arrays = made
    whole = [pa.array([m], pa.int64()), pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64()))]
    names = [field.split()[0] for field in _INDEX.split(", ")]

    def single(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return pa.RecordBatch.from_arrays(
        [*whole, single(terms.cast(pa.string())), *(single(pa.array(x.astype(np.int32))) for x in arrays)], names)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of documents that come by ascending (m, id)."""
    held, m, size, number = [], None, 0, 0

    def flushed() -> pa.RecordBatch:
        found = pa.Table.from_batches(held).combine_chunks()
        return _row(indexed(m, int(found["row"][0].as_py()), found["id"].to_pylist(), found["text"].combine_chunks()))

    for piece in slices(batches, "text"):
        ms = piece.column("m").to_numpy()
        cuts = np.flatnonzero(np.diff(ms)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(ms)]):
            part = piece.slice(start, stop - start)
            weighs = part.column("text").nbytes
            if held and (ms[start] != m or size + weighs > SLICE_BYTES or number + len(part) > SLICE_DOCS):
                yield flushed()
                held, size, number = [], 0, 0
            held.append(part)
            m, size, number = int(ms[start]), size + weighs, number + len(part)
    if held:
        yield flushed()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text"):
        counts = words_of(piece.column("text"))[1]
        found = pa.RecordBatch.from_arrays([*piece.columns, pa.array(counts, pa.int64())], [*piece.schema.names, "n"])
        yield found.filter(pa.array(counts > 0))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, row, n) of the documents that have a term, n of them, stored."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return materialise(rows.mapInArrow(_counted, "id bigint, text string, row bigint, n bigint"), "lexical-texts")


def _spread(found: DataFrame, terms: int, parts: int) -> DataFrame:
    """(n, low, high): which parts take the documents of n terms, so that each gets about as many terms, in order of n."""
    mass = found.groupBy("n").agg((F.col("n") * F.count("*")).alias("mass"))
    upto = F.sum("mass").over(Window.orderBy("n"))  # a row for each length
    low, high = (upto - F.col("mass")) * parts / terms, (upto - 1) * parts / terms
    return mass.select("n", F.floor(low).alias("low"), F.least(F.floor(high), F.lit(parts - 1)).alias("high"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(index, number of documents): the stored index of all documents, one row per slice of a stratum."""
    spark = session(docs.sparkSession)
    found = counted(docs, id_col, text_col)
    whole = found.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    m = F.lit(BASE - SLOPE) + F.expr(f"({SLOPE} * n * {whole['docs']}L) div {max(whole['terms'], 1)}L")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # k different lengths take k * k / 2 terms at least, so there are few
    lengths = F.broadcast(_spread(found, max(whole["terms"], 1), parts))
    part = F.col("low") + F.pmod(F.xxhash64("row"), F.col("high") - F.col("low") + 1)
    rows = found.join(lengths, "n").select("id", "text", m.alias("m"), "row", part.cast("int").alias("part"))
    ranged = rows.repartitionById(parts, "part").drop("part").sortWithinPartitions("m", F.col("id").asc_nulls_last(), "row")
    index, path = ranged.mapInArrow(_sliced, _INDEX), scratch_dir(spark, "lexical-index")
    # a reader holds a row group at a time, and rows are large here
    index.write.options(**{"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "4",
                           "parquet.block.size.row.check.max": "16"}).parquet(path)
    return spark.read.schema(index.schema).parquet(path), whole["docs"]


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, terms): the distinct terms of each item, ascending."""
    found = F.regexp_extract_all(F.translate(text_col, _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    return (items.select(F.col(item_col).alias("item"), F.explode(found).alias("term")).distinct()
            .groupBy("item").agg(F.array_sort(F.collect_list("term")).alias("terms")))


class _Block:
    """A block of items: each one's terms as numbers in the block's list of terms, and these terms' weights."""

    def __init__(self, terms: list[list[str]]):
        self.terms = sorted(set().union(*terms))
        number = {term: at for at, term in enumerate(self.terms)}
        self.items = [np.array([number[term] for term in item], dtype=np.int64) for item in terms]
        self.weights = np.zeros(len(self.terms), dtype=np.int64)
        self.least = np.ones(len(self.items), dtype=np.int64)  # scores that hits have to reach

    def local(self, terms: pa.Array) -> np.ndarray:
        """Where each of the block's terms is among a slice's, or -1."""
        found = pc.index_in(pa.array(self.terms, pa.string()), value_set=terms)
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _values(batch: pa.RecordBatch, name: str, at: int) -> np.ndarray:
    return batch.column(name)[at].values.to_numpy(zero_copy_only=False).astype(np.int64)


class _Slice:
    """A row of the index, seen by a block."""

    def __init__(self, block: _Block, batch: pa.RecordBatch, at: int):
        self.batch, self.at, self.m = batch, at, batch.column("m")[at].as_py()
        self.local = block.local(batch.column("terms")[at].values)
        self.held = [local[local >= 0] for local in (self.local[item] for item in block.items)]
        best = impact(_values(batch, "top_tf", at), self.m)
        self.weights = np.zeros(len(best), dtype=np.int64)
        self.weights[self.local[self.local >= 0]] = block.weights[self.local >= 0]
        best *= self.weights
        self.bounds = np.array([best[held].sum() for held in self.held], dtype=np.int64)
        self.read = False

    def scores(self, item: int) -> np.ndarray:
        """Score of each of the slice's documents."""
        if not self.read:
            holders, tf = _values(self.batch, "holders", self.at), _values(self.batch, "tf", self.at)
            self.ends, self.pos = np.cumsum(holders), _values(self.batch, "pos", self.at)
            self.starts = self.ends - holders
            seen = np.unique(tf)
            self.impacts = impact(seen, self.m)[np.searchsorted(seen, tf)] * np.repeat(self.weights, holders)
            self.read = True
        held, size = self.held[item], len(self.batch.column("ids")[self.at].values)
        out = np.zeros(size, dtype=np.int64)
        for start, stop in zip(self.starts[held], self.ends[held]):
            out[self.pos[start:stop]] += self.impacts[start:stop]  # a document is in a term's list once
        return out

    def hits(self, item: int, least: int, most: int) -> list[tuple[int, int]]:
        """(score, place) of the best documents that reach ``least``; places ascend with ids."""
        scores = self.scores(item)
        found = np.flatnonzero(scores >= max(least, 1))
        found = found[np.argsort(-scores[found], kind="stable")[:most]]
        return [(int(scores[place]), int(place)) for place in found]

    def id_at(self, place: int):
        return self.batch.column("ids")[self.at].values[place].as_py()


_HIT = "item int, score bigint, id bigint"


def _hit_batch(rows: list[tuple]) -> pa.RecordBatch:
    item, score, doc = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(doc, pa.int64())], ["item", "score", "id"])


def _holding(block: _Block):
    """(at, holders): documents of a batch that hold each of the block's terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.terms), dtype=np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                local = block.local(batch.column("terms")[at].values)
                total[local >= 0] += _values(batch, "holders", at)[local[local >= 0]]
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["at", "holders"])
    return run


def _promising(block: _Block, most: int):
    """(item, bound, m, slice): a task's slices with the highest bounds of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in block.items]
        for batch in batches:
            for at in range(batch.num_rows):
                seen = _Slice(block, batch, at)
                for item in np.flatnonzero(seen.bounds):
                    best[item].append((int(seen.bounds[item]), seen.m, batch.column("slice")[at].as_py()))
            best = [sorted(rows, reverse=True)[:most] for rows in best]
        rows = [(item, *row) for item, found in enumerate(best) for row in found]
        item, bound, m, number = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(bound, pa.int64()), pa.array(m, pa.int64()),
                                          pa.array(number, pa.int64())], ["item", "bound", "m", "slice"])
    return run


def _visited(block: _Block, most: int):
    """The best hits of a task's slices, by descending bound within a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, best = block.least.copy(), [[] for _ in block.items]
        for batch in batches:
            seen = sorted((_Slice(block, batch, at) for at in range(batch.num_rows)), key=lambda x: x.bounds.max(initial=0))
            while seen:
                one = seen.pop()
                for item in np.flatnonzero(one.bounds >= least):
                    found = [(score, one.id_at(place)) for score, place in one.hits(item, least[item], most)]
                    if found:
                        rows = best[item] + found
                        rows.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
                        best[item] = rows[:most]
                        if len(rows) >= most:
                            least[item] = max(least[item], best[item][-1][0])
        yield _hit_batch([(item, *row) for item, rows in enumerate(best) for row in rows])
    return run


def _ranked(hits: DataFrame, by: str, most: int, *ties: Column) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col(by).desc(), *ties))).where(F.col("rank") <= most)


def _search_block(index: DataFrame, terms: list[list[str]], n_docs: int, most: int) -> DataFrame:
    """(item, rank, score, id) of a block's items, by their places in it."""
    block = _Block(terms)
    counts = index.select("terms", "holders").mapInArrow(_holding(block), "at int, holders bigint").groupBy("at").agg(F.sum("holders").alias("n"))
    for row in counts.collect():  # at most a row per term of the block
        block.weights[row["at"]] = weight(n_docs, row["n"])
    bounds = index.select("m", "slice", "terms", "top_tf").mapInArrow(_promising(block, most), "item int, bound bigint, m bigint, slice bigint")
    # at most ``most`` slices per item of the block
    first = materialise(_ranked(bounds, "bound", most, F.col("m"), F.col("slice")).select("m", "slice").distinct(), "lexical-first")
    start = index.join(first, ["m", "slice"], "left_semi").select(*index.columns).mapInArrow(_visited(block, most), _HIT)
    order = [F.col("id").asc_nulls_last()]
    for row in _ranked(start, "score", most, *order).where(F.col("rank") == most).collect():  # at most a row per item
        block.least[row["item"]] = row["score"]
    return _ranked(index.mapInArrow(_visited(block, most), _HIT), "score", most, *order)


def search(docs: DataFrame, items: DataFrame, hits: int = HITS, block_terms: int = BLOCK_TERMS, item_col: str = "item_id",
           item_text: str = "text", **names: str) -> DataFrame:
    """(item, rank, id, score): each item's best documents, exactly."""
    spark = session(docs.sparkSession)
    held = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_BYTES)  # a row of the index is large; everything is stored before this ends
    try:
        index, n_docs = build_index(docs, **names)
        asked = materialise(item_terms(items, item_col, item_text), "lexical-items")
        total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
        blocks, out = max(1, math.ceil(total / block_terms)), None
        for number in range(blocks):
            rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).collect()  # about ``block_terms`` terms
            found = _search_block(index, [row["terms"] for row in rows], n_docs, hits)
            names_of = spark.createDataFrame([(at, row["item"]) for at, row in enumerate(rows)],
                                             f"item int, name {asked.schema['item'].dataType.simpleString()}")
            found = materialise(found.join(names_of, "item").select(F.col("name").alias("item"), "rank", "id", "score"), "lexical-hits")
            out = found if out is None else out.unionByName(found)
        return out
    finally:
        spark.conf.set(_BATCH, held)


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


# Every document that shares a term, scored in full.
OP12_SQL = rf"""
WITH words AS (
  SELECT row_number() OVER () AS doc, doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM documents
), tfs AS (
  SELECT doc, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY doc, term
), lengths AS (
  SELECT doc, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc
), corpus AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths
), norms AS (
  SELECT doc, {BASE - SLOPE} + ({SLOPE} * n * docs) // terms AS m FROM lengths, corpus
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, corpus GROUP BY term
), scores AS (
  SELECT item_id, doc, any_value(doc_id) AS doc_id, sum(w * (({SCALE} * tf) // ({TF_FACTOR} * tf + {M_FACTOR} * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN norms USING (doc) GROUP BY item_id, doc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {HITS}
"""
