"""Token ids in files of directly addressable codes.

Ids are cut into chunks of ``BITS`` bits.  Level 0 holds every id's lowest chunk, level 1 the next chunk of those ids that
have one, and so on; a bitmap per level says which ids go on, and a directory of ranks (ids going on before each block of
512) finds an id's place on the next level.  Any single id is read from one chunk per level, without decoding others.

Layout of a file, little-endian: magic ``DACT``, shard, segment, documents, tokens, levels (u32 each); document ids (i64,
and a byte each that is 1 for NULL); first token of each document (u64, one more than documents); per level the number of
chunks (u64), chunks (u8), bitmap, and directory (u32).  Files are written and read through Spark's own writers and readers,
so they can lie in any store.  A segment holds about ``SEGMENT`` tokens, however large a task's part.

Defined cases: NULL is the empty text, which has the end id only; the string of an added token is that token, as the library
has it by default; NULL ids come first; rows that share an id are ordered
by text; a text longer than a segment fills one of its own; an empty table makes no segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapgrid.llm.common import materialise, session, slices, table
from snapgrid.session import scratch_dir

BITS = 8
BLOCK = 512
SEGMENT = 4_000_000
END = 2
TABLE_ROWS = 400_000
_SIGNS = {" ": "Ġ", "\n": "Ċ"}  # how this vocabulary writes them
# Characters at a word's edge that may be white space to the tokenizer.
_EDGE = r"[\x00-\x20\x7f-\x{a0}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}]"
_EDGED = f"^{_EDGE}|{_EDGE}$"
_HEAD = struct.Struct("<4s5I")


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class WordTable:
    """Ids of distinct space-led words by the tokenizers library.

    The library's own pre-tokenizer never joins characters across a single blank or line feed that stands between two
    others, so such words are encoded alone.  A text with other white space at a word's edge is given to the library whole,
    and so is one with the string of an added token, which the library makes that token.
    """

    def __init__(self, path: str, most: int = TABLE_ROWS):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.words, self.ids = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        names = [name or "" for name in names]
        # pieces that begin with a blank, and with a line feed
        self.leads = {sign: np.array([name.startswith(written) for name in names]) for sign, written in _SIGNS.items()}

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def alone(self, words: pa.Array, lead: str, together: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each word has) of words after ``lead``, which they do not hold: many in one text, cut before its pieces."""
        starts = np.append(np.arange(0, len(words), together), len(words)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), words), lead)
        ids = [np.array(found, dtype="<u4") for found in self.whole([lead + text for text in joined.to_pylist()])]
        flat = np.concatenate([np.zeros(0, "<u4"), *ids])
        cuts = np.flatnonzero(self.leads[lead][flat])
        pieces = np.add.reduceat(self.leads[lead][flat], np.cumsum([0, *map(len, ids[:-1])]), dtype=np.int64) if ids else np.zeros(0, np.int64)
        if not np.array_equal(pieces, np.diff(starts)):
            raise ValueError("the tokenizer joins characters across words")
        return flat, np.diff(np.append(cuts, len(flat)))

    def learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in some order, for each word where its ids start, how many it has); one not to be encoded alone has -1."""
        feed = pc.starts_with(new, "\n")
        bare = pc.if_else(feed, pc.utf8_slice_codeunits(new, 1), new)
        edged = pc.or_(pc.equal(bare, ""), pc.match_substring_regex(bare, _EDGED))
        lone = pc.and_not(pc.invert(edged), feed)
        begins = pc.and_(pc.and_not(feed, edged), pc.invert(pc.match_substring(bare, "\n")))
        starts, lengths, parts, held = np.zeros(len(new), dtype=np.int64), np.full(len(new), -1, dtype=np.int64), [], 0
        for chosen, lead in ((lone, " "), (begins, "\n")):
            ids, counts = self.alone(bare.filter(chosen), lead)
            chosen = chosen.to_numpy(zero_copy_only=False)
            starts[chosen], lengths[chosen] = held + np.cumsum(counts) - counts, counts
            parts.append(ids)
            held += len(ids)
        return np.concatenate(parts), starts, lengths

    def known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's start, how many each has or -1) of distinct words; only those new to the table are encoded."""
        place = pc.index_in(words, value_set=self.words)
        fresh = pc.is_null(place)
        new = words.filter(fresh)
        ids, starts, lengths = self.learn(new)
        size = len(self.words)
        self.words = pa.concat_arrays([self.words, new])
        self.starts = np.concatenate([self.starts, len(self.ids) + starts])
        self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        place = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        place[fresh.to_numpy(zero_copy_only=False)] = size + np.arange(len(new))
        found = self.ids, self.starts[place], self.lengths[place]
        if len(self.words) > self.most:  # go on with what is in use
            counts = np.maximum(found[2], 0)
            self.words, self.lengths, self.starts = words, found[2], np.cumsum(counts) - counts
            self.ids = self.ids[_ranges(found[1], counts)]
        return found

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """The ids of each text; all words of all texts go through one dictionary, so Python sees no single word."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        words, first, lone = _words(texts, self.added)
        coded = words.dictionary_encode()
        ids, starts, lengths = self.known(coded.dictionary)
        codes = coded.indices.to_numpy().astype(np.int64)
        # a text's first word has nothing before it: a word of its own, behind the distinct ones
        heads = [np.array(x, dtype="<u4") for x in self.whole(words.take(pa.array(first)).to_pylist())]
        sizes = np.array([len(x) for x in heads], dtype=np.int64)
        codes[first] = len(lengths) + np.arange(len(first))
        starts = np.concatenate([starts, len(ids) + np.cumsum(sizes) - sizes])
        ids, lengths = np.concatenate([ids, *heads]), np.concatenate([lengths, sizes])
        lone &= np.minimum.reduceat(lengths[codes], first) >= 0
        counts = np.maximum(lengths, 0)[codes]
        ends = np.cumsum(counts)
        flat = ids[_ranges(starts[codes], counts)]
        cuts = np.concatenate(([0], ends[np.append(first[1:], len(codes)) - 1]))
        out = [flat[start:stop] for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        odd = np.flatnonzero(~lone)
        for at, found in zip(odd.tolist(), self.whole(texts.take(pa.array(odd)).to_pylist())):
            out[at] = np.array(found, dtype="<u4")
        return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def _words(texts: pa.Array, added: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, where each text's first one stands, whether the text can be taken word by word).

    Words come without their leading blank; where line feeds stand between other characters, a line's first has the feed.  A feed
    after a blank would look the same, so such a text goes to the library whole.
    """
    fed = pc.match_substring(texts, "\n")
    odd = pc.match_substring(texts, " \n")
    for token in added:
        odd = pc.or_(odd, pc.match_substring(texts, token))
    apart = pc.and_not(fed, pc.or_(odd, pc.or_(pc.match_substring(texts, "\n\n"), pc.match_substring(texts, "\n "))))
    if pc.any(apart).as_py():
        texts = pc.if_else(apart, pc.replace_substring(texts, "\n", " \n"), texts)
    cut = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    offsets = cut.offsets.to_numpy()
    return cut.flatten(), offsets[:-1].astype(np.int64) - offsets[0], ~odd.to_numpy(zero_copy_only=False)


_TABLES: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """The worker process's table for a tokenizer."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]


def packed(shard: int, segment: int, ids: list[int | None], tokens: list[np.ndarray]) -> bytes:
    """One file's bytes."""
    flat = np.concatenate(tokens).astype(np.uint32) if tokens else np.zeros(0, np.uint32)
    levels, rest = [], flat
    while len(rest) or not levels:
        chunk, over = (rest & ((1 << BITS) - 1)).astype(np.uint8), rest >> BITS
        goes_on = over > 0
        ranks = np.cumsum(np.concatenate(([0], np.add.reduceat(goes_on, np.arange(0, len(goes_on), BLOCK), dtype=np.int64)
                                          if len(goes_on) else [])))[:-1 if len(goes_on) else None].astype("<u4")
        levels.append(struct.pack("<Q", len(chunk)) + chunk.tobytes() + np.packbits(goes_on, bitorder="little").tobytes() + ranks.tobytes())
        rest = over[goes_on]
    first = np.concatenate(([0], np.cumsum([len(x) for x in tokens]))).astype("<u8")
    return b"".join([
        _HEAD.pack(b"DACT", shard, segment, len(ids), len(flat), len(levels)),
        np.array([i or 0 for i in ids], "<i8").tobytes(), bytes(i is None for i in ids), first.tobytes(), *levels])


class Segment:
    """Reads one file: ``token(i)`` alone, or all tokens."""

    def __init__(self, data: bytes):
        magic, self.shard, self.segment, n, self.n_tokens, n_levels = _HEAD.unpack_from(data)
        if magic != b"DACT":
            raise ValueError("not a token file")
        at = _HEAD.size
        numbers = np.frombuffer(data, "<i8", n, at)
        nulls = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.ids = [None if null else int(number) for number, null in zip(numbers, nulls)]
        self.first = np.frombuffer(data, "<u8", n + 1, at + 9 * n).astype(np.int64)
        at += 9 * n + 8 * (n + 1)
        self.levels = []
        for _ in range(n_levels):
            (count,) = struct.unpack_from("<Q", data, at)
            bits, blocks = -(-count // 8), max(1, -(-count // BLOCK))
            chunks = np.frombuffer(data, np.uint8, count, at + 8)
            bitmap = np.frombuffer(data, np.uint8, bits, at + 8 + count)
            ranks = np.frombuffer(data, "<u4", blocks, at + 8 + count + bits)
            self.levels.append((chunks, bitmap, ranks))
            at += 8 + count + bits + 4 * blocks

    def token(self, i: int) -> int:
        value = 0
        for level, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (BITS * level)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            start = i // BLOCK * BLOCK
            i = int(ranks[i // BLOCK]) + int(np.unpackbits(bitmap[start // 8:i // 8 + 1], bitorder="little")[:i - start].sum())
        return value

    def tokens(self) -> np.ndarray:
        above = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            goes_on = np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)
            value = chunks.astype(np.uint32)
            value[goes_on] |= above << BITS
            above = value
        return above


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str | None = None, segment: int = SEGMENT) -> None:
    """Encode every whole text and store the ids below ``path``, in ascending order of id over shards and segments."""
    spark, tokenizer = session(docs.sparkSession), tokenizer or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard, number = word_table(tokenizer), TaskContext.get().partitionId(), 0
        ids, tokens, held = [], [], 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([packed(shard, number, ids, tokens)], pa.binary())], ["file"])

        for piece in slices(batches, "text", 4_000_000):
            coded = known.encode(piece.column("text"))
            for doc, found in zip(piece.column("id").to_pylist(), coded):
                if held and held + len(found) >= segment:
                    yield flushed()
                    ids, tokens, held, number = [], [], 0, number + 1
                ids.append(doc)
                tokens.append(np.append(found, np.uint32(END)))
                held += len(found) + 1
        if ids:
            yield flushed()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    files = ranged.mapInArrow(run, "file binary").select(F.col("file").cast("string"))
    files.write.option("maxRecordsPerFile", 1).text(path)  # the bytes as they are, one file each, then a line feed


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(shard, segment, position, id, n_tokens, ids_crc32): one row per stored document, from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                if not (data := content.as_py()):
                    continue
                found = Segment(data)
                flat, first = found.tokens().astype("<u4"), found.first
                crcs = [zlib.crc32(flat[start:stop].tobytes()) for start, stop in zip(first[:-1], first[1:])]
                n = len(found.ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([found.shard] * n, pa.int64()), pa.array([found.segment] * n, pa.int64()),
                     pa.array(first[:-1], pa.int64()), pa.array(found.ids, pa.int64()),
                     pa.array(np.diff(first), pa.int64()), pa.array(crcs, pa.int64())],
                    ["shard", "segment", "position", "id", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "shard bigint, segment bigint, position bigint, id bigint, n_tokens bigint, ids_crc32 bigint")


def located(stored: DataFrame) -> DataFrame:
    """The rows of ``read_tokens`` with ``start``, the number of ids of all documents before."""
    stored = materialise(stored, "token-rows")
    files = stored.groupBy("shard", "segment").agg(F.sum("n_tokens").alias("in_file"))
    order = Window.orderBy("shard", "segment").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    base = files.select("shard", "segment", F.coalesce(F.sum("in_file").over(order), F.lit(0)).alias("base"))
    return stored.join(base, ["shard", "segment"]).withColumn("start", F.col("base") + F.col("position"))


def op8_token_store(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch_dir(spark, "tokens")
    write_tokens(docs, path)
    return located(read_tokens(spark, path)).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
