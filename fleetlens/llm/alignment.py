"""Alignment of two tokenizers' tokens by their ends in bytes.

Texts are cut into words at places where tokens of both always end, so a word's alignment does not depend on its text and is
found once for the corpus. In a word the ends of either side's tokens are running sums of byte lengths, kept in a dictionary
from end to index; the ends both dictionaries hold, sorted, slice both id lists into groups, and each group's links (tokens
whose bytes overlap) are listed by going through its slices. The corpus-wide count of a linked pair of ids is summed over
distinct words by how often they occur, and what a word adds to its texts goes back to them by chunk.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.chunks import code_texts, join_back
from fleetlens.llm.common import parts_for, stored
from fleetlens.llm.token_counts import byte_names
from fleetlens.llm.words import BYTE_LEVEL, LETTERS, word_splitter

SPACE = "▁"


class Pair:
    """One worker's two tokenizers, A from a tokenizers file of a byte-level BPE and B from a sentencepiece model."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"] or {}
        known = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        byte_of = {c: b for b, c in enumerate(byte_names())}
        self.bytes_a = {i: bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode() for token, i in self.a.get_vocab().items()}
        self.bytes_b = [self._bytes_b(i) for i in range(self.b.get_piece_size())]
        self.size_a = {i: len(raw) for i, raw in self.bytes_a.items()}
        self.size_b = [len(raw) for raw in self.bytes_b]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # B never joins over a place that no piece reaches over
        apart = known and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        lines = not any("\n" in p for p in pieces if len(p) > 1)
        # links are kept as pairs of the smallest numbers that hold all ids
        self.link_type = np.uint16 if max(max(self.bytes_a, default=0), len(self.bytes_b)) < 1 << 16 else np.int32
        self.shield = len(self.b.encode("\n"))
        joined = {m for p in pieces for m in re.findall(f"(?<=[{LETTERS}])[{re.escape(string.punctuation)}]", p)}
        self.words = word_splitter(BYTE_LEVEL if apart else "", lines, "".join(sorted(set(string.punctuation) - joined)))

    def _bytes_b(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace(SPACE, " ").encode()

    def split(self, text: str) -> list[str] | None:
        """The words of space+text; None where B's pieces do not spell it."""
        if SPACE in text or self.b.normalize(text) != SPACE + text.replace(" ", SPACE):
            return None
        return self.words(" " + text)

    def _ids_b(self, word: str) -> list[int]:
        # B puts a space in front of a text that is not empty. Words without one stand behind a line feed, and no piece
        # reaches from a line feed into such a word, nor into a space
        if word.startswith(" ") and len(word) > 1:
            return self.b.encode(word[1:])
        return self.b.encode("\n" + word)[self.shield :]

    def align(self, words: list[str]) -> Iterator[tuple[list[int], list[int], list[tuple[list[int], list[int]]], list[tuple[int, int]]]]:
        """For each word its ids of A and B, the groups, and the links."""
        of_a = [e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)]
        for word, a, b in zip(words, of_a, map(self._ids_b, words)):
            raw = word.encode()
            if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
                raise ValueError(f"tokens do not spell {word!r}")
            index_a = dict(zip(accumulate(map(self.size_a.__getitem__, a)), range(1, len(a) + 1)))
            index_b = dict(zip(accumulate(map(self.size_b.__getitem__, b)), range(1, len(b) + 1)))
            groups, links, i, j = [], [], 0, 0
            for end in sorted(index_a.keys() & index_b.keys()):
                group = a[i : index_a[end]], b[j : index_b[end]]
                groups.append(group)
                links += self._links(*group)
                i, j = index_a[end], index_b[end]
            yield a, b, groups, links

    def _links(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        """Pairs whose bytes overlap, of a group whose ends meet nowhere but at its own end."""
        if len(a) == 1 or len(b) == 1:
            return [(x, y) for x in a for y in b]
        links, i, j, to_a, to_b = [], 0, 0, self.size_a[a[0]], self.size_b[b[0]]
        while True:
            links.append((a[i], b[j]))
            if to_a == to_b:
                return links
            if to_a < to_b:
                i += 1
                to_a += self.size_a[a[i]]
            else:
                j += 1
                to_b += self.size_b[b[j]]


@lru_cache(maxsize=2)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


#: Words of chunks that one task groups and aligns.
TASK_WORDS = 400_000


def align_words(words: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Distinct words and linked pairs of ids, both by the task (``part``) that found them.

    Words: part, word, n_a, n_b, n_groups, n_links, groups as text, links as an array of (a, b) in one binary. Pairs: part, a, b,
    n, how often the part's words link them in the corpus.
    """
    schema = "is_pair boolean, part int, word string, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, a int, b int, n long"
    kinds = pa.schema([("is_pair", pa.bool_()), ("part", pa.int32()), ("word", pa.string()), *[(c, pa.int64()) for c in COUNTS], ("groups", pa.string()), ("links", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def made(rows: int, **columns) -> pa.RecordBatch:
        part = [TaskContext.get().partitionId()] * rows
        columns = {"is_pair": ["a" in columns] * rows, "part": part} | columns
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in kinds], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[tuple[int, int], int] = defaultdict(int)
        for batch in batches:
            names, rows, linked = batch.column("word").to_pylist(), [], []
            for (a, b, groups, links), n in zip(_pair(path_a, path_b).align(names), batch.column("n").to_pylist()):
                text = ";".join([",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups])
                rows.append((len(a), len(b), len(groups), len(links), text))
                linked.append(np.array(links, _pair(path_a, path_b).link_type).tobytes())
                for link in links:
                    pairs[link] += n
            if rows:
                *numbers, texts = zip(*rows)
                yield made(len(rows), word=names, groups=texts, links=linked, **dict(zip(COUNTS, numbers)))
        found = list(pairs.items())
        for low in range(0, len(found), 100_000):
            some = found[low : low + 100_000]
            yield made(len(some), a=[a for (a, _), _ in some], b=[b for (_, b), _ in some], n=[n for _, n in some])

    tasks = parts_for(words.count(), TASK_WORDS)
    total = words.select("word", "n").repartition(tasks, "word").groupBy("word").agg(F.sum("n").alias("n"))
    found = stored(total.mapInArrow(run, schema), "aligned")
    return found.where("not is_pair").drop("is_pair", "a", "b", "n"), found.where("is_pair").select("part", "a", "b", "n")


def count_links(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """The words with n_best and count_sum: their links whose pair's corpus-wide count is its b's highest, and the counts' sum.

    A part's words ask for each of its pairs once.
    """
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    judged = counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    asked = pairs.select(F.col("part").alias("of_part"), "a", "b").join(judged, ["a", "b"])
    shown = ["word", *COUNTS, "n_best", "count_sum", "groups"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("a").to_numpy().astype(np.int64) << 32 | right.column("b").to_numpy()
        order = np.argsort(keys)
        keys, count, best = (x[order] for x in (keys, right.column("count").to_numpy(), right.column("best").to_numpy().astype(np.int64)))
        sizes = left.column("n_links").to_numpy()
        raw = b"".join(left.column("links").to_pylist())
        links = np.frombuffer(raw, f"u{len(raw) // (2 * sizes.sum())}").reshape(-1, 2).astype(np.int64)
        at = np.searchsorted(keys, links[:, 0] << 32 | links[:, 1])
        sums = [pa.array(np.add.reduceat(x[at], np.cumsum(sizes) - sizes)) for x in (best, count)]
        return pa.table([*[left.column(c) for c in ["word", *COUNTS]], *sums, left.column("groups")], shown)

    schema = "word string, " + ", ".join(f"{c} long" for c in shown[1:-1]) + ", groups string"
    return aligned.groupBy("part").cogroup(asked.groupBy("of_part")).applyInArrow(run, schema)


#: Words of a text whose groups are joined at once.
JOINED_WORDS = 1_000_000


def _joined(groups: pa.Array, code: np.ndarray) -> Iterator[bytes]:
    """The groups at these rows, joined by semicolons, in parts."""
    for low in range(0, len(code), JOINED_WORDS):
        some = groups.take(pa.array(code[low : low + JOINED_WORDS]))
        if low:
            yield b";"
        yield pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), ";")[0].as_buffer().to_pybytes()


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
SUMS = [*COUNTS, "n_best", "count_sum"]


def align_tokens(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` is text such as ``a1,a2|b1;a3|b2,b3``, or its SHA-256 with ``digest``. A link is best if its pair's count is its
    B id's highest, ties included; ``count_sum`` adds up the counts of a text's links. Both paths are the same on every executor.
    A is encoded on space+text, B puts that space in front itself; special tokens' strings are plain text. Texts that are null
    or empty, or that B's pieces do not spell byte for byte, have no tokens: zeros and '' and no part in the counts. Very long
    texts are taken whole. Repeated rows and ids stay and count each time; null ids stay null; an empty table gives an empty one;
    other columns, whatever their names, are ignored.
    """
    words, texts = code_texts(docs, lambda: _pair(path_a, path_b).split, id_col, text_col)
    found = count_links(*align_words(words, path_a, path_b))

    def build(columns: dict[str, pa.Array], codes: Iterator) -> dict[str, pa.Array]:
        table = [columns[name].to_numpy() for name in SUMS]
        totals, shown = [], []
        for code in codes:
            if code is None or not len(code):
                totals.append([0] * len(SUMS))
                shown.append("")
                continue
            totals.append([int(column[code].sum()) for column in table])
            parts = _joined(columns["groups"], code)
            if digest:
                sha = hashlib.sha256()
                for part in parts:
                    sha.update(part)
                shown.append(sha.hexdigest())
            else:
                shown.append(b"".join(parts).decode())
        sums = zip(*totals) if totals else [[]] * len(SUMS)
        return {name: pa.array(column, pa.int64()) for name, column in zip(SUMS, sums)} | {"groups": pa.array(shown, pa.string())}

    schema = ", ".join([*[f"{name} long" for name in SUMS], "groups string"])
    return join_back(texts, words, found, build, schema)
