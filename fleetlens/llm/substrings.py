"""Substring dedup by difference-cover anchors.

``COVER`` is a difference cover modulo ``PERIOD``: for any two positions there is a shift below the period that brings both
onto cover positions. So of all windows of ``ANCHOR`` words only those at cover positions are hashed, and yet any two equal
passages of ``WINDOW`` words share an anchor at the same place inside them. Where an anchor occurs in two documents the
match is extended: the whole windows around it are hashed (128 bits) and compared; a window is a repeat if a document with
a smaller id starts one with the same words.

Documents with the same words are first brought together: all but the first repeat it wholly, and only the first takes part
in the search, so a group of copies costs one row per copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

WINDOW = 50
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _word_hashes(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    hashes = np.empty(len(words), np.uint64)
    one = xxhash.xxh3_64_intdigest
    for i, word in enumerate(words):
        h = seen.get(word)
        if h is None:
            h = seen[word] = one(word)
        hashes[i] = h
    return hashes


def _windows(hashes: np.ndarray, starts: np.ndarray, length: int, base: int) -> np.ndarray:
    """64-bit hash of the ``length`` words from each start: prefix sums with powers of an odd base, modulo 2**64."""
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(base, -1, 1 << 64))
        powers = np.full(len(hashes), np.uint64(base))
        powers[:1] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers, dtype=np.uint64)])
        back = np.full(len(hashes), inverse)
        back[:1] = 1
        back = np.cumprod(back, dtype=np.uint64)
        x = (sums[starts + length] - sums[starts]) * back[starts]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _anchor_starts(n_words: int) -> np.ndarray:
    starts = (np.arange(0, n_words, PERIOD)[:, None] + np.array(COVER)).ravel()
    return starts[starts + ANCHOR <= n_words]


def _key(words: list[bytes]) -> tuple[int, int]:
    """128-bit hash of the words as two signed longs."""
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _described(docs: DataFrame) -> DataFrame:
    """doc, n_words and the key of the words."""

    @F.pandas_udf("n_words long, words_a long, words_b long")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [(len(words), *_key(words)) for words in map(_words, texts)]
            yield pd.DataFrame(rows, columns=["n_words", "words_a", "words_b"])

    return docs.select("doc", describe("text").alias("d")).select("doc", "d.*")


def _tables(parts: Iterator[dict], rows: int = 200_000) -> Iterator[pd.DataFrame]:
    """The parts put together to tables of about ``rows`` rows, so that what a worker holds does not follow the batch size."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(next(iter(part.values())))
        if size >= rows:
            yield pd.DataFrame({name: np.concatenate([p[name] for p in held]) for name in held[0]})
            held, size = [], 0
    if held:
        yield pd.DataFrame({name: np.concatenate([p[name] for p in held]) for name in held[0]})


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of the anchors of each text of at least one window, with the key of the text."""

    def parts() -> Iterator[dict]:
        for batch in batches:
            for text in batch["text"]:
                words = _words(text)
                if len(words) >= WINDOW:
                    found = np.unique(_windows(_word_hashes(words), _anchor_starts(len(words)), ANCHOR, _BASES[0]))
                    yield {"anchor": _signed(found), "key": np.full(len(found), _key(words)[0])}

    return _tables(parts())


def _extended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole windows that hold a shared anchor, from (doc, text, shared)."""

    def parts() -> Iterator[dict]:
        for batch in batches:
            for doc, text, shared in zip(batch["doc"], batch["text"], batch["shared"]):
                hashes = _word_hashes(_words(text))
                starts = _anchor_starts(len(hashes))
                known = np.sort(np.asarray(shared, np.int64))
                anchors = _signed(_windows(hashes, starts, ANCHOR, _BASES[0]))
                at = np.minimum(np.searchsorted(known, anchors), len(known) - 1)
                starts = starts[known[at] == anchors]
                around = np.unique((starts[:, None] - np.arange(PERIOD)).ravel())
                around = around[(around >= 0) & (around <= len(hashes) - WINDOW)]
                a, b = (_signed(_windows(hashes, around, WINDOW, base)) for base in _BASES)
                yield {"a": a, "b": b, "doc": np.full(len(a), doc), "start": around.astype(np.int32)}

    return _tables(parts())


def repeated_windows(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(doc, starts): where windows begin that also begin in a smaller doc.

    ``docs`` has doc and text, ``firsts`` the smallest doc of every text: words_a, words_b, doc.
    """
    anchors = docs.select("text").mapInPandas(_anchors, "anchor long, key long")
    shared = anchors.groupBy("anchor").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    # the anchors that a text shares are bounded by its own length
    of_text = anchors.join(shared.select("anchor"), "anchor").groupBy("key").agg(F.collect_set("anchor").alias("shared"))
    of_doc = firsts.join(of_text, firsts["words_a"] == of_text["key"]).select("doc", "shared")
    windows = docs.join(of_doc, "doc").select("doc", "text", "shared").mapInPandas(_extended, "a long, b long, doc long, start int")
    windows = stored(windows, "windows")
    lowest = windows.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    repeats = windows.join(lowest.select("a", "b", "first"), ["a", "b"]).where("first < doc")
    return repeats.groupBy("doc").agg(F.collect_list("start").alias("starts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    Words are what stands between ASCII white space. Every word covered by a repeated window goes; windows are judged on the
    input. Null and empty texts have no words and lose none. Rows with a null id neither lose words nor serve as the earlier
    document. Repeated rows stay, each with the same result; if rows of one id differ in text, a place repeated in one of
    them is cut from all. An empty table gives an empty table; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    named = docs.where("doc IS NOT NULL")
    told = stored(_described(named).where(F.col("n_words") >= WINDOW).drop("n_words"), "texts")
    firsts = told.groupBy("words_a", "words_b").agg(F.min("doc").alias("doc"))
    copies = told.join(firsts.withColumnRenamed("doc", "first"), ["words_a", "words_b"]).where("doc > first")
    whole = copies.select("doc").distinct().select("doc", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("whole"))
    marks = repeated_windows(named, firsts).withColumn("whole", F.lit(False)).unionByName(whole)
    marks = marks.groupBy("doc").agg(F.max("whole").alias("whole"), F.first("starts", ignorenulls=True).alias("starts"))

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, wholes, starts in batches:
            rows = []
            for text, whole, begins in zip(texts, wholes, starts):
                words = _words(text)
                kept = words
                if whole is True or whole is np.True_:
                    kept = []
                elif begins is not None and len(begins):
                    edge = np.zeros(len(words) + 1, np.int64)
                    begins = np.asarray(begins)
                    begins = begins[begins + WINDOW <= len(words)]
                    np.add.at(edge, begins, 1)
                    np.add.at(edge, begins + WINDOW, -1)
                    kept = [w for w, gone in zip(words, np.cumsum(edge)[:-1] > 0) if not gone]
                rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    joined = docs.join(marks, "doc", "left")
    return joined.select(F.col("doc").alias("doc_id"), cut("text", "whole", "starts").alias("c")).select("doc_id", "c.*")
