"""Byte-level BPE encoding and decoding with recursive SQL in DuckDB, run on each partition.

A piece's sequence of tokens is a string with one character a token; its pairs join the merge table, and a recursive query
contracts the pairs of least rank until no pair is left; ordered aggregation gives ids and decoded bytes. Every piece, of
whatever length, takes this way, once while a worker remembers it. Documents are put together from their pieces.

Two bytes that stand side by side in no token are never merged, so a piece is cut between such bytes and each part is a
sequence of its own. In one step all places of a pair are contracted, from the left, which is what contracting them one after
the other gives. Where pairs that differ give the same token and may share one, only the leftmost is contracted. So steps
follow the number of different pairs in a part, not its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.words import Remembered, joinable, parts_of, piece_splitter, word_splitter

#: Bytes that one recursive query takes (or one piece of more), and pieces and words a worker remembers.
QUERY_BYTES, KNOWN = 200_000, 250_000

#: What is remembered of a word: its ids as text, which decode to the word's own bytes, or else the ids and what they decode to.
Known = str | tuple[str, bytes]

# A token is the character FIRST + id. A pair's rule is its rank and, in the lower 16 bits, where it cuts the token: the least
# rule of a part is contracted, or, of tangled ones, the pair at the least spot.
FIRST = 0x10000
_CONTRACT = """
WITH RECURSIVE t(part, tokens) AS (
    SELECT part, tokens FROM parts
    UNION ALL
    (
        WITH pair AS (
            SELECT part, unnest(chars[:-2]) || unnest(chars[2:]) AS duo, unnest(range(len(chars) - 1)) AS spot
            FROM (SELECT part, string_split(tokens, '') AS chars FROM t WHERE length(tokens) > 1)
        ),
        best AS (
            SELECT part, min(rule) AS least, max(rule - (rule >> 16 << 17)) AS most, min((rule >> 16 << 32) | spot) & 4294967295 AS spot
            FROM pair JOIN merges USING (duo) GROUP BY part
        )
        SELECT part, CASE
            WHEN tangled AND least & 65535 <> most + (least >> 16 << 16) THEN tokens[:spot] || token || tokens[spot + 3:]
            ELSE replace(tokens, duo, token)
        END
        FROM t JOIN best USING (part) JOIN merges ON rule = least
    )
)
SELECT l.piece, count(*) AS n, array_to_string(list(text ORDER BY g), ' ') AS ids,
    array_to_string(list(hex ORDER BY g), '') AS hex
FROM (
    SELECT part, unnest(chars) AS token, (part << 32) | unnest(range(len(chars))) AS g
    FROM (SELECT part::BIGINT AS part, string_split(arg_min(tokens, length(tokens)), '') AS chars FROM t GROUP BY part)
)
JOIN pieces l USING (part)
JOIN vocabulary v USING (token)
GROUP BY l.piece
"""

_MERGES = """
CREATE TABLE merges AS
SELECT chr((first + a)::INT) || chr((first + b)::INT) AS duo, chr((first + rank)::INT) AS token, (rank << 16) | cut AS rule,
    EXISTS (SELECT 1 FROM splits o WHERE o.rank = s.rank AND o.cut <> s.cut AND (o.a = s.b OR o.b = s.a)) AS tangled
FROM (SELECT *, $first::BIGINT AS first FROM splits) s
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, one token a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """One worker's encoder: the merge table in DuckDB, and what it has met lately."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb

        ranks = read_ranks(path)
        self.words, self.pieces = word_splitter(pattern), piece_splitter(pattern)
        self.joinable = joinable(ranks)
        self.byte_tokens = [chr(FIRST + ranks[bytes([b])]) for b in range(256)]
        self.con = duckdb.connect(config={"threads": "1", "memory_limit": "300MB"})
        pairs = [
            (ranks[token[:cut]], ranks[token[cut:]], rank, cut)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        self.con.register("splits", pd.DataFrame(pairs, columns=["a", "b", "rank", "cut"], dtype="int64"))
        self.con.execute(_MERGES, {"first": FIRST})
        self.con.unregister("splits")
        vocabulary = pd.DataFrame({"id": ranks.values(), "text": map(str, ranks.values()), "hex": map(bytes.hex, ranks)})  # noqa: F841
        self.con.execute("CREATE TABLE vocabulary AS SELECT *, chr($first::INT + id::INT) AS token FROM vocabulary", {"first": FIRST})
        self.known_words, self.known_pieces = Remembered(KNOWN), Remembered(KNOWN)

    def _contract(self, raws: list[bytes]) -> list[tuple[int, str, bytes]]:
        """Number of ids, ids as text, and decoded bytes of each piece."""
        flat = np.frombuffer(b"".join(raws), np.uint8)
        owner, _, place = parts_of(flat, np.fromiter(map(len, raws), np.int64, len(raws)), self.joinable)
        tokens = "".join(map(self.byte_tokens.__getitem__, flat.tolist()))
        ends = [*np.flatnonzero(place == 0).tolist(), len(flat)]
        self.con.register("parts", pd.DataFrame({"part": np.arange(len(owner)), "tokens": [tokens[i:j] for i, j in zip(ends, ends[1:])]}))
        self.con.register("pieces", pd.DataFrame({"part": np.arange(len(owner)), "piece": owner}))
        found = self.con.execute(_CONTRACT).fetchnumpy()
        self.con.unregister("parts")
        self.con.unregister("pieces")
        out: list = [None] * len(raws)
        for piece, n, ids, text in zip(found["piece"].tolist(), found["n"].tolist(), found["ids"], found["hex"]):
            out[piece] = (n, ids, bytes.fromhex(text))
        return out

    def _learn_pieces(self, wanted: set[str]) -> dict[str, Known]:
        here, new = self.known_pieces.split(wanted)
        new.sort(key=len)
        raws = [piece.encode() for piece in new]
        start = 0
        while start < len(new):
            end, size = start + 1, len(raws[start])
            while end < len(new) and size + len(raws[end]) <= QUERY_BYTES:
                size += len(raws[end])
                end += 1
            for piece, raw, (_, ids, decoded) in zip(new[start:end], raws[start:end], self._contract(raws[start:end])):
                here[piece] = ids if decoded == raw else (ids, decoded)
            start = end
        self.known_pieces.keep(here, new)
        return here

    def _learn(self, texts) -> tuple[list[list[str]], dict[str, str], dict[str, bytes]]:
        """Each text's words, each word's ids as text, and of words whose ids decode to other bytes than their own, those."""
        split = [self.words(text) if text else [] for text in texts]
        here, new = self.known_words.split(set().union(*split))
        pieces = {word: self.pieces(word) for word in new}
        of_piece = self._learn_pieces(set().union(*pieces.values()))
        for word, held in pieces.items():
            found = [of_piece[p] for p in held]
            if len(found) == 1:
                here[word] = found[0]
            elif tuple not in map(type, found):
                here[word] = " ".join(found)
            else:
                both = [(f, p.encode()) if isinstance(f, str) else f for f, p in zip(found, held)]
                here[word] = (" ".join([f[0] for f in both]), b"".join([f[1] for f in both]))
        self.known_words.keep(here, new)
        other = {word: found[1] for word, found in here.items() if type(found) is tuple}
        return split, here | {word: here[word][0] for word in other} if other else here, other

    def batch(self, texts) -> Iterator[list[tuple[int, str, bytes]]]:
        """For each text its words' number of ids, ids as text, and decoded bytes."""
        split, ids, other = self._learn(texts)
        for words in split:
            yield [(ids[w].count(" ") + 1, ids[w], other[w] if w in other else w.encode()) for w in words]

    def joined(self, texts) -> Iterator[tuple[int, str, bytes]]:
        """For each text the number of its ids, the ids as text, and the bytes they decode to."""
        split, ids, other = self._learn(texts)
        for words in split:
            raw = b"".join([other[w] if w in other else w.encode() for w in words]) if other else "".join(words).encode()
            text = " ".join(map(ids.__getitem__, words))
            yield text.count(" ") + 1 if words else 0, text, raw


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _small(texts: pd.Series, most: int = 4_000_000) -> Iterator[pd.Series]:
    """Runs of texts of about ``most`` characters, so that what a worker holds does not follow the batch size."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield texts.iloc[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts.iloc[start:]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids. ``path`` is the rank file, the same on every executor.

    Null and empty texts have no ids; very long texts are taken whole; repeated rows and ids stay, an empty table gives an
    empty one, and other columns, whatever their names, are ignored. Nothing is shuffled.
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = [np.array(" ".join(p[1] for p in pieces).split(), np.int32) for t in _small(texts) for pieces in _coder(path, pattern).batch(t)]
            yield pd.Series(rows, dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), ids(F.col(text_col).cast("string")).alias("ids"))


_DECODE = """
SELECT doc, string_agg(hex, '' ORDER BY pos) AS hex, count(*) = count(hex) AS whole
FROM coded LEFT JOIN vocabulary USING (id) GROUP BY doc
"""


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: doc_id, bytes. Null or empty ids give no bytes; a row with an id that is null or outside the
    vocabulary gives null. Repeated rows, empty tables and other columns are as in ``encode``."""

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            con = _coder(path, pattern).con
            rows = [np.array([-1 if x is None or x != x else x for x in (() if i is None else i)], np.int64) for i in ids]
            flat = np.concatenate([np.empty(0, np.int64), *rows])
            doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            con.register("coded", pd.DataFrame({"doc": doc, "pos": np.arange(len(flat)), "id": flat}))
            found = con.execute(_DECODE).fetchall()
            con.unregister("coded")
            out: list[bytes | None] = [b""] * len(ids)
            for doc, text, good in found:
                out[doc] = bytes.fromhex(text) if good else None
            yield pd.Series(out, dtype=object)

    return coded.select(F.col(id_col).alias("doc_id"), raw(ids_col).alias("bytes"))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, with ``encode``'s rules, in one pass.

    The ids are written in decimal with one space between; what they decode to is put together from the words' decoded ids.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for part in _small(texts):
                for n, ids, raw in _coder(path, pattern).joined(part):
                    rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col).cast("string")).alias("d")).select("doc_id", "d.*")
