"""SentencePiece encoding and decoding over a table of distinct marked words.

No piece of the model has a marker after another character, so a text falls into chunks (markers and what follows up to
the next marker) that the library segments independently.  Each task keeps a bounded table from chunk to ids, asks the
library only for chunks that are new to it, and joins the ids back in the order of the text.  The table stays with
the task: joining chunks across the cluster would move each text several times over, and needs no less work.

Defined cases: NULL is the empty text, without ids; a text of spaces is one chunk; a single-marker chunk at the end is the
marker's own piece; texts of any length are encoded whole; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgrid.llm.common import slices, table

MARK = "▁"
TABLE_ROWS = 250_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Ids of distinct chunks, as bytes; the chunk is given without its first marker, which the library adds itself."""

    def __init__(self, path: str, most: int = TABLE_ROWS):
        import sentencepiece
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        strays = (piece for piece in map(self.pieces.id_to_piece, range(self.pieces.get_piece_size()))
                  if MARK in piece.lstrip(MARK))
        if (stray := next(strays, None)) is not None:
            raise ValueError(f"piece {stray!r} crosses a marker, so words cannot be segmented alone")
        self.most, self.ids = most, {}

    def chunks(self, text: str) -> list[str]:
        text = text.replace(MARK, " ")
        words = text.split(" ")
        if "" not in words or not text:
            return words if text else []
        return [chunk[1:].replace(MARK, " ") for chunk in _CHUNK.findall(MARK + text.replace(" ", MARK))]

    def learn(self, chunks: set[str]) -> None:
        if len(self.ids) > self.most:
            self.ids.clear()
        new = [chunk for chunk in chunks if chunk not in self.ids]
        self.ids.update((chunk, array("i", ids).tobytes()) for chunk, ids in zip(new, self.pieces.encode(new, num_threads=1)))
        self.ids[""] = array("i", [self.pieces.piece_to_id(MARK)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.chunks(text or "") for text in texts]
        self.learn(set().union(*cut))
        return [array("i", b"".join(map(self.ids.__getitem__, chunks))).tolist() for chunks in cut]


_TABLES: dict[str, ChunkTable] = {}


def chunk_table(path: str) -> ChunkTable:
    """The worker process's table for a model; it outlives the task where Spark keeps the worker."""
    if path not in _TABLES:
        _TABLES[path] = ChunkTable(path)
    return _TABLES[path]


def _mapped(docs: DataFrame, text_col: str, added: T.StructType, path: str,
            rows: Callable[[ChunkTable, list[str | None]], list[pa.Array]]) -> DataFrame:
    """The rows as struct ``row``, with the columns that ``rows`` makes of their texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunk_table(path)
        for piece in slices(batches, "text"):
            made = rows(known, piece.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column("row"), *made], ["row", *added.names])

    kept = docs.select(F.struct(*[docs[name] for name in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([kept.schema["row"], *added.fields])
    return kept.mapInArrow(run, schema)


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(row, ids): the ids of every whole text."""
    return _mapped(docs, text_col, T.StructType().add("ids", T.ArrayType(T.IntegerType())), path or model_path(),
                   lambda known, texts: [pa.array(known.encode(texts), pa.list_(pa.int32()))])


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(row, ids, decoded) from (row, ids)."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = chunk_table(path).pieces
        for batch in batches:
            texts = [pieces.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(row, ids, decoded): both in one pass, so that a task needs one worker with one table."""
    def rows(known: ChunkTable, texts: list[str | None]) -> list[pa.Array]:
        ids = known.encode(texts)
        return [pa.array(ids, pa.list_(pa.int32())), pa.array(map(known.pieces.decode, ids), pa.string())]

    added = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return _mapped(docs, text_col, added, path or model_path(), rows)


def digests(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(row, n_tokens, ids_sha256, decoded_sha256): encoded and decoded in one pass, only digests leave it."""
    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def rows(known: ChunkTable, texts: list[str | None]) -> list[pa.Array]:
        ids = known.encode(texts)
        return [pa.array(map(len, ids), pa.int64()), pa.array([sha(",".join(map(str, x))) for x in ids]),
                pa.array([sha(known.pieces.decode(x)) for x in ids])]

    added = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return _mapped(docs, text_col, added, path or model_path(), rows)


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    found = digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
