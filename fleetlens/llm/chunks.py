"""Texts as numbers of distinct words, so that what depends on a word alone is worked out once for the whole corpus.

A chunk is a run of texts of one task. Its texts become arrays of numbers into the chunk's own list of distinct words; both
are written as flat rows. The words of all chunks meet once, grouped by word, and what was found for each goes back to the
chunks that hold it, where whole texts are put together. A word leaves a chunk once however often it occurs there, so the
most frequent one has a row per chunk at most, and a chunk's size is bounded, or that of its single text.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fleetlens.llm.common import stored

_ZSTD = pa.Codec("zstd")


def pack(codes: np.ndarray) -> bytes:
    """Numbers from 0 as planes of bytes, low to high, compressed."""
    if not len(codes):
        return b""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return len(codes).to_bytes(4, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    """The numbers ``pack`` was given."""
    if not raw:
        return np.empty(0, np.int32)
    size = 4 * int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(_ZSTD.decompress(raw[4:], size, asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int32)


#: Characters of a chunk, beside ``ROW_CHARS`` for each of its texts; a chunk ends earlier once it has so many distinct words.
CHUNK_CHARS, ROW_CHARS, CHUNK_WORDS = 40_000_000, 64, 1_000_000
#: Rows that go back to Spark at once.
SENT_TEXTS, SENT_WORDS = 1_000, 20_000

Split = Callable[[str], "Sequence[str] | None"]


class _Chunk:
    """A run of texts: the words known so far, all texts' numbers end to end, and each text's length (None if left out)."""

    def __init__(self, name: int) -> None:
        self.name, self.size = name, 0
        self.known: dict[str, int] = {}
        self.flat, self.lengths, self.ids = array("i"), [], []

    def add(self, words: Sequence[str] | None) -> None:
        known = self.known
        self.lengths.append(None if words is None else len(words))
        self.flat.fromlist([known.setdefault(w, len(known)) for w in words or ()])

    def batches(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        flat, none = np.frombuffer(self.flat, np.int32), pa.nulls
        counts = np.bincount(flat, minlength=len(self.known))
        # frequent words get small numbers, which pack well
        order = np.argsort(-counts, kind="stable")
        number_of = np.empty(len(order), np.int32)
        number_of[order] = np.arange(len(order))
        ids, start = pa.concat_arrays(self.ids), 0
        for low in range(0, len(ids), SENT_TEXTS):
            codes = []
            for length in self.lengths[low : low + SENT_TEXTS]:
                codes.append(None if length is None else pack(number_of[flat[start : start + length]]))
                start += length or 0
            rows = len(codes)
            texts_of = [
                pa.array([False] * rows), pa.array([self.name] * rows), none(rows, pa.int32()), none(rows, pa.string()),
                none(rows, pa.int64()), pa.array(codes, pa.binary()), ids.slice(low, rows),
            ]
            yield pa.RecordBatch.from_arrays(texts_of, names)
        words = list(self.known)
        self.known.clear()
        for low in range(0, len(words), SENT_WORDS):
            part = order[low : low + SENT_WORDS]
            rows = len(part)
            words_of = [
                pa.array([True] * rows), pa.array([self.name] * rows), pa.array(np.arange(low, low + rows, dtype=np.int32)),
                pa.array([words[i] for i in part.tolist()], pa.string()), pa.array(counts[part], pa.int64()), none(rows, pa.binary()),
                none(rows, ids.type),
            ]
            yield pa.RecordBatch.from_arrays(words_of, names)


def code_texts(docs: DataFrame, split: Callable[[], Split], id_col: str, text_col: str, chars: int = CHUNK_CHARS) -> tuple[DataFrame, DataFrame]:
    """Words (chunk, place, word, n) and texts (chunk, doc_id, codes), both written tables.

    ``split`` is called in the worker and gives the function that cuts a text into words, or None for a text to leave out,
    whose ``codes`` are then null. Null texts count as empty, which have no words; ``doc_id`` keeps its type and nulls. ``n`` is
    how often the word occurs in the chunk. A chunk goes on over the batches of its task, whose texts are not kept.
    """
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType
    head = "is_word boolean, chunk long, place int, word string, n long, codes binary"
    schema = StructType([*StructType.fromDDL(head).fields, StructField("doc_id", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        cut, first = split(), TaskContext.get().partitionId() << 32
        chunk = _Chunk(first)
        for batch in batches:
            ids, start = batch.column("doc_id"), 0
            for row, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                if chunk.lengths and (chunk.size + len(text) > chars or len(chunk.known) >= CHUNK_WORDS):
                    # taken, not sliced, as a slice would keep its whole batch
                    chunk.ids.append(ids.take(pa.array(np.arange(start, row))))
                    yield from chunk.batches(names)
                    chunk, start = _Chunk(chunk.name + 1), row
                chunk.size += len(text) + ROW_CHARS
                chunk.add(cut(text) if text else ())
            chunk.ids.append(ids.take(pa.array(np.arange(start, len(ids)))))
        if chunk.lengths:
            yield from chunk.batches(names)

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    coded = stored(narrow.mapInArrow(run, schema), "coded")
    words = coded.where("is_word").select("chunk", "place", "word", "n")
    return words, coded.where("not is_word").select("chunk", "doc_id", "codes")


def join_back(texts: DataFrame, words: DataFrame, found: DataFrame, build: Callable, schema: str | StructType) -> DataFrame:
    """Puts texts together from what was ``found`` by ``word``.

    ``build(columns, codes)`` gets a chunk's found columns, by name, and one text after the other as an array of rows in them
    (None for a text left out); it gives the columns of ``schema`` beside doc_id, row for row.
    """
    extra = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = StructType([texts.schema["doc_id"], *extra.fields])
    # as many tasks as chunks, which are of bounded size
    tasks = max(1, texts.select("chunk").distinct().count())
    answers = words.select(F.col("chunk").alias("of_chunk"), "place", "word").join(found, "word").drop("word")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = {n: right.column(n).combine_chunks() for n in right.column_names if n not in ("of_chunk", "place")}
        row_of = np.empty(len(right), np.int32)
        row_of[right.column("place").to_numpy()] = np.arange(len(right), dtype=np.int32)
        codes = (row_of[unpack(c.as_py())] if c.is_valid else None for c in left.column("codes"))
        made = build(columns, codes)
        return pa.table([left.column("doc_id"), *[made[f.name] for f in extra.fields]], [f.name for f in whole.fields])

    left, right = texts.repartition(tasks, "chunk"), answers.repartition(tasks, "of_chunk")
    return left.groupBy("chunk").cogroup(right.groupBy("of_chunk")).applyInArrow(run, whole)
