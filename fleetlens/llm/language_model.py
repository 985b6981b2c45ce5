"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of the bigram, the unigram and the uniform distribution. The mixture weights
depend on how often the context was seen, by powers of two, and are learned by expectation-maximisation: part of the
training documents is held out, and their tokens are explained by counts of the others. For scoring, counts are taken over
all training documents.

Documents are packed into chunks (local word numbers and word hashes), written once. Every chunk asks for each distinct
word and word pair of its own once, so counting is combined before the shuffle and a hot word costs one entry per chunk.
Counts are summed by range of the hash and sent back to the chunks in the order in which they were asked for.
``CHUNK_TOKENS`` and ``BUCKET_KEYS`` bound what one task holds; raise both with executor memory on very large inputs, as the
number of messages is the product of chunks and buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import LOWER, UPPER, parts_for, stored

FOLDS, TEST_FOLD, TUNING_FOLD = 7, 2, 4
CHUNK_TOKENS = 2_000_000
BUCKET_KEYS = 2_000_000
CONTEXT_BUCKETS = 40
ROUNDS = 60
_END = xxhash.xxh3_64_intdigest(b"")
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
_STEPS = 4


def _pack(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    width = values.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def _unpack(blob: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.uint64), dtype=np.uint64)


def fold_of(doc_id) -> int:
    """The fold of a document; a null id counts as the text "null"."""
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % FOLDS


class _Chunk:
    """Documents being packed: local word numbers in order, one end after each text."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.tokens: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, doc_id, text: str | None) -> None:
        words = text.encode().translate(_LOWERED).split() if text else []
        number = self.number
        own = [number.setdefault(w, len(number)) for w in words]
        own.append(0)
        self.tokens.append(np.array(own, np.uint32))
        self.ids.append(doc_id)
        self.lengths.append(len(own))
        self.size += len(own)

    def row(self, chunk: int, tuning: bool) -> dict:
        known = [i is not None for i in self.ids]
        return {
            "chunk": chunk,
            "tuning": tuning,
            "size": self.size,
            "ids": np.array([i if i is not None else 0 for i in self.ids], np.int64).tobytes(),
            "known": np.array(known, bool).tobytes(),
            "lengths": np.array(self.lengths, np.int32).tobytes(),
            "words": _pack(np.fromiter(map(xxhash.xxh3_64_intdigest, self.number), np.uint64, len(self.number))),
            "tokens": _pack(np.concatenate(self.tokens)),
        }


_CHUNK = "chunk long, tuning boolean, size long, ids binary, known binary, lengths binary, words binary, tokens binary"


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    first, made = TaskContext.get().partitionId() << 32, 0
    open_ = {False: _Chunk(), True: _Chunk()}
    for batch in batches:
        ids = [None if i is None else int(i) for i in batch["doc_id"]]
        for doc_id, text in zip(ids, batch["text"]):
            tuning = fold_of(doc_id) == TUNING_FOLD
            chunk = open_[tuning]
            chunk.add(doc_id, text)
            if chunk.size >= CHUNK_TOKENS:
                yield pd.DataFrame([chunk.row(first + made, tuning)])
                made += 1
                open_[tuning] = _Chunk()
    for tuning, chunk in open_.items():
        if chunk.size:
            yield pd.DataFrame([chunk.row(first + made, tuning)])
            made += 1


class _Read:
    """A packed chunk as arrays: per token the word and the pair with the word before, distinct keys in order."""

    def __init__(self, row) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        self.lengths = np.frombuffer(row["lengths"], np.int32)
        self.tuning = bool(row["tuning"])
        words, tokens = _unpack(row["words"], np.uint64), _unpack(row["tokens"], np.uint32)
        order = np.argsort(words)
        self.words = words[order]
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.word = place[tokens]
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[:1] = place[0]  # the end of the text before is the context of a first word
        with np.errstate(over="ignore"):
            pair = self.words[self.before] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.word]
            pair ^= pair >> np.uint64(31)
            pair *= np.uint64(0xD6E8FEB86659FD93)
            pair ^= pair >> np.uint64(32)
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        folds = [fold_of(int(i) if k else None) for i, k in zip(self.ids, self.known)]
        self.held = np.array([f == TEST_FOLD for f in folds], bool)
        self.learned = np.repeat(~self.held, self.lengths)

    def counted(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(level, distinct keys, training counts)."""
        weight = self.learned.astype(np.float64)
        return [
            (1, self.words, np.bincount(self.word, weight, len(self.words)).astype(np.uint32)),
            (2, self.pairs, np.bincount(self.pair, weight, len(self.pairs)).astype(np.uint32)),
        ]


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _asker(buckets: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                chunk, rows = _Read(row), []
                for level, keys, counts in chunk.counted():
                    cuts = _bounds(keys, buckets)
                    for bucket in range(buckets):
                        part = slice(cuts[bucket], cuts[bucket + 1])
                        if cuts[bucket] < cuts[bucket + 1]:
                            rows.append((level, bucket, row["chunk"], chunk.tuning, _pack_sorted(keys[part]), _pack(counts[part])))
                yield pd.DataFrame(rows, columns=["level", "bucket", "chunk", "tuning", "keys", "counts"])

    return ask


def _sums(group: pd.DataFrame) -> pd.DataFrame:
    """Adds up one bucket; answers each chunk, and tells the totals in a row without a chunk."""
    keys = [_unpack_sorted(k) for k in group["keys"]]
    counts = [_unpack(c, np.uint32).astype(np.float64) for c in group["counts"]]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    size = np.array([len(k) for k in keys])
    tuning = np.repeat(group["tuning"].to_numpy(bool), size)
    flat = np.concatenate(counts)
    total = np.bincount(place, flat, len(every))
    fitted = total - np.bincount(place, np.where(tuning, flat, 0.0), len(every))
    level, bucket = int(group["level"].iloc[0]), int(group["bucket"].iloc[0])
    rows, start = [(level, bucket, -1, None, None, int(total.sum()), int((total > 0).sum()), int(fitted.sum()), int((fitted > 0).sum()))], 0
    for chunk, n, tunes in zip(group["chunk"], size, group["tuning"]):
        own = place[start : start + n]
        start += n
        fit = _pack(fitted[own].astype(np.uint64)) if tunes else None
        rows.append((level, bucket, chunk, _pack(total[own].astype(np.uint64)), fit, 0, 0, 0, 0))
    return pd.DataFrame(rows, columns=["level", "bucket", "chunk", "total", "fitted", "n", "v", "fitted_n", "fitted_v"])


_ANSWER = "level int, bucket int, chunk long, total binary, fitted binary, n long, v long, fitted_n long, fitted_v long"


def _answers(replies: pd.DataFrame, column: str, level: int) -> np.ndarray:
    own = replies[replies["level"] == level].sort_values("bucket")
    return np.concatenate([_unpack(b, np.uint64) for b in own[column]]).astype(np.float64)


def _estimates(chunk: _Read, words: np.ndarray, pairs: np.ndarray, n: int, v: int):
    """Per token: context bucket and the three estimates."""
    context = words[chunk.before]
    bucket = np.minimum(np.log2(context + 1).astype(np.int64), CONTEXT_BUCKETS - 1)
    bigram = np.where(context > 0, pairs[chunk.pair] / np.maximum(context, 1), 0.0)
    unigram = words[chunk.word] / max(n, 1)
    return bucket, np.minimum(bigram, 1.0), unigram, np.full(len(bucket), 1.0 / (v + 1))


def _cell(estimate: np.ndarray) -> np.ndarray:
    """Steps of a quarter of a power of two; -1 for zero. At most 4 * 64 values."""
    with np.errstate(divide="ignore"):
        steps = np.floor(-np.log2(estimate) * _STEPS)
    return np.where(estimate > 0, np.minimum(steps, 64 * _STEPS), -1).astype(np.int64)


def _tuner(n: int, v: int):
    def events(_, packed: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """Held-out tokens counted by context bucket and steps of the two estimates, with the sums of both."""
        parts = []
        for _, row in packed.iterrows():
            chunk = _Read(row)
            words, pairs = (_answers(replies, "fitted", level) for level in (1, 2))
            bucket, bigram, unigram, _ = _estimates(chunk, words, pairs, n, v)
            frame = pd.DataFrame({"bucket": bucket, "s2": _cell(bigram), "s1": _cell(unigram), "f2": bigram, "f1": unigram})
            parts.append(frame.groupby(["bucket", "s2", "s1"], as_index=False).agg(n=("f2", "size"), f2=("f2", "sum"), f1=("f1", "sum")))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["bucket", "s2", "s1", "n", "f2", "f1"])

    return events


def learn_weights(cells: pd.DataFrame, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) by context bucket from counted held-out tokens.

    Each bucket starts from equal weights and leans on one token of prior for each estimate, so buckets without tokens are
    defined and no weight is ever zero.
    """
    weights = np.full((CONTEXT_BUCKETS, 3), 1 / 3)
    if not len(cells):
        return weights
    n = cells["n"].to_numpy(float)
    f = np.stack([cells["f2"] / n, cells["f1"] / n, np.full(len(n), 1.0 / (v + 1))], axis=1).astype(float)
    bucket = cells["bucket"].to_numpy(int)
    for _ in range(rounds):
        mixed = weights[bucket] * f
        share = mixed / mixed.sum(axis=1, keepdims=True) * n[:, None]
        sums = np.stack([np.bincount(bucket, share[:, k], CONTEXT_BUCKETS) for k in range(3)], axis=1) + 1
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def _scorer(weights: np.ndarray, n: int, v: int):
    def score(_, packed: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in packed.iterrows():
            chunk = _Read(row)
            words, pairs = (_answers(replies, "total", level) for level in (1, 2))
            bucket, *estimates = _estimates(chunk, words, pairs, n, v)
            mixed = (weights[bucket] * np.stack(estimates, axis=1)).sum(axis=1)
            count = words[chunk.word]
            starts = np.concatenate([[0], np.cumsum(chunk.lengths)[:-1]])
            by_doc = lambda x: np.add.reduceat(x, starts)
            frame = pd.DataFrame(
                {
                    "doc_id": pd.array(np.where(chunk.known, chunk.ids, 0), "Int64"),
                    "held_out": chunk.held,
                    "n_tokens": chunk.lengths.astype(np.int64),
                    "n_known": by_doc((count > 0).astype(np.int64)),
                    "train_tokens": n,
                    "base_score": by_doc(np.log10((count + 1) / (n + v + 1))),
                    "score": by_doc(np.log10(mixed)),
                }
            )
            frame.loc[~chunk.known, "doc_id"] = pd.NA
            out.append(frame)
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id"])

    return score


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Tokens are the words between ASCII white space, A-Z lowered, and one end for each text. Documents of fold ``TEST_FOLD``
    teach nothing. Null and empty texts are one end; a null id has the fold of the text "null"; repeated rows stay and count
    each time. Words never seen in training keep a probability through the uniform part. An empty table gives an empty
    table; other columns are ignored.
    """
    # as text, since a null would turn a batch's whole numbers into floats
    docs = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = stored(docs.mapInPandas(_chunks, _CHUNK), "chunks")
    buckets = parts_for(2 * (chunks.agg(F.sum("size")).first()[0] or 0), BUCKET_KEYS)
    asked = chunks.mapInPandas(_asker(buckets), "level int, bucket int, chunk long, tuning boolean, keys binary, counts binary")
    replies = stored(asked.groupBy("level", "bucket").applyInPandas(_sums, _ANSWER), "counts")
    totals = replies.where("chunk = -1 AND level = 1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "fitted_n", "fitted_v"))).first()
    n, v, fitted_n, fitted_v = map(int, totals)
    own = replies.select("level", "bucket", "chunk", "total", "fitted").where("chunk >= 0")
    tuning = chunks.where("tuning")
    events = tuning.groupBy("chunk").cogroup(own.where("fitted IS NOT NULL").drop("total").groupBy("chunk"))
    events = events.applyInPandas(_tuner(fitted_n, fitted_v), "bucket long, s2 long, s1 long, n long, f2 double, f1 double")
    # at most CONTEXT_BUCKETS * 257 * 257 cells, whatever the input
    cells = events.groupBy("bucket", "s2", "s1").agg(*(F.sum(c).alias(c) for c in ("n", "f2", "f1"))).toPandas()
    weights = learn_weights(cells.sort_values(["bucket", "s2", "s1"]), fitted_v)
    scored = chunks.groupBy("chunk").cogroup(own.drop("fitted").groupBy("chunk"))
    return scored.applyInPandas(
        _scorer(weights, n, v),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
