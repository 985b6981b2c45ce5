"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

Words that a worker has not met lately are laid end to end as one array of symbols. In every step each sequence's pair of
least rank is merged wherever it occurs, in all sequences at once; sequences without a pair to merge leave the array, and
their symbols are counted. A text's count is the sum over its words. Nothing is shuffled.

A merge makes pairs of higher rank only (checked when the file is read), so merging all occurrences of a sequence's least
pair at once gives what merging them one by one does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import text_of
from fleetlens.llm.words import BYTE_LEVEL, Remembered, joinable, parts_of, piece_splitter, word_splitter

#: Words whose count a worker remembers, bytes of new words merged at once, characters of texts taken at once.
KNOWN, MERGE_BYTES, TEXT_CHARS = 500_000, 1_000_000, 8_000_000
NO_PAIR = np.iinfo(np.int32).max


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible, else from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    shown = set(seen)
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Counter:
    """One worker's merge table of a tokenizer file, and the counts it has met lately."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        added = spec["added_tokens"]
        if not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError(f"{path} is no plain byte-level BPE")
        vocab = model["vocab"]
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        names = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.words, self.ascii_pieces = word_splitter(BYTE_LEVEL), piece_splitter(BYTE_LEVEL)

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[m] for m in side], np.int64) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.made, self.size = made, max(vocab.values()) + 1
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys, self.ranks = (left * self.size + right)[order], order.astype(np.int32)
        born = np.full(self.size, -1, np.int64)
        born[made] = np.arange(len(made))
        if (born[left] >= np.arange(len(made))).any() or (born[right] >= np.arange(len(made))).any():
            raise ValueError(f"{path} merges symbols before they are made")
        alphabet = byte_names()
        self.byte_ids = np.array([vocab[c] for c in alphabet], np.int64)
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.joinable = joinable(bytes(map(self.byte_of.__getitem__, a + b)) for a, b in pairs)
        self.known = Remembered(KNOWN)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_PAIR)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How many symbols are left of each sequence; the sequences lie end to end and none is empty."""
        left = np.zeros(len(sizes), np.int64)
        name, seq = np.arange(len(sizes)), np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(symbols), NO_PAIR, np.int32)
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inside] = self._rank(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            if (done := least == NO_PAIR).any():
                left[name[seq[starts[done]]]] = lengths[done]
                keep = np.repeat(~done, lengths)
                symbols, rank, seq = symbols[keep], rank[keep], seq[keep]
                least, lengths = least[~done], lengths[~done]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            # of pairs that overlap, every second one of the run is merged, from the left
            first = np.r_[True, np.diff(hit) != 1]
            places = np.arange(len(hit))
            hit = hit[(places - np.maximum.accumulate(np.where(first, places, 0))) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[hit] = True
            changed[hit[hit > 0] - 1] = True  # the symbol before, or one that goes and whose own predecessor is marked as merged
            symbols, seq, rank, changed = symbols[keep], seq[keep], rank[keep], changed[keep]
            at = np.flatnonzero(changed)
            follows = at[(at + 1 < len(seq)) & (seq[np.minimum(at + 1, len(seq) - 1)] == seq[at])]
            rank[at] = NO_PAIR
            rank[follows] = self._rank(symbols[follows], symbols[follows + 1])
        return left

    def _pieces(self, word: str) -> list[bytes]:
        if word.isascii():
            return [p.encode() for p in self.ascii_pieces(word)]
        return [bytes(map(self.byte_of.__getitem__, shown)) for shown, _ in self.pre.pre_tokenize_str(word)]

    def _learn(self, new: list[str]) -> dict[str, int]:
        found: dict[str, int] = {}
        start = 0
        while start < len(new):
            raws, owners, size, end = [], [], 0, start
            while end < len(new) and (end == start or size < MERGE_BYTES):
                pieces = self._pieces(new[end])
                raws += pieces
                owners += [end - start] * len(pieces)
                size += sum(map(len, pieces))
                end += 1
            flat = np.frombuffer(b"".join(raws), np.uint8)
            owner, part, _ = parts_of(flat, np.fromiter(map(len, raws), np.int64, len(raws)), self.joinable)
            counts = self.merge(self.byte_ids[flat], np.bincount(part))
            totals = np.bincount(np.array(owners)[owner], counts, end - start).astype(np.int64)
            found.update(zip(new[start:end], totals.tolist()))
            start = end
        return found

    def batch(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        split, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            split.append([w for part in parts for w in self.words(part)] if len(parts) > 1 else self.words(text))
        here, new = self.known.split(set().union(*split))
        here.update(self._learn(new))
        self.known.keep(here, new)
        return [sum(map(here.__getitem__, words)) + more for words, more in zip(split, extra)]


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` is a tokenizers file of a byte-level BPE, the same on every executor. Strings of its special tokens inside a text
    count as one token each, as the library takes them by default. Null and empty texts have no bytes and no tokens; very long
    texts are taken whole, and steps follow the number of different ranks in a word, not its length. Repeated rows and ids stay;
    null ids stay null; an empty table gives an empty one; other columns, whatever their names, are ignored.
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts, counts, start = texts.tolist(), [], 0
            while start < len(texts):
                end, size = start + 1, len(texts[start])
                while end < len(texts) and size + len(texts[end]) <= TEXT_CHARS:
                    size += len(texts[end])
                    end += 1
                counts += _counter(path).batch(texts[start:end])
                start = end
            yield pd.Series(counts, dtype="int64")

    text = text_of(text_col)
    counted = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
