"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document: some for junk, some for toxic, each may abstain. Where a text has no
word at all, only the labeller of empty texts has seen anything; the silence of the others is no evidence. Expectation-
maximisation over the counted vote patterns of all documents learns how often each labeller fires in each class (its
accuracy) and how common the classes are. The posteriors label a bounded sample on which a hashed linear scorer is
trained; the scorer judges every document. Cue words of the toxic labellers are mined from a bounded sample of labelled
rows. All bounds are parameters.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import SPACE_CLASS, text_of

CLASSES = ("clean", "junk", "toxic")
LABELLERS = ("empty", "symbols", "capitals", "stutter", "variety", "lines", "lengths", "cue_words", "cue_starts")
_FOR = np.array([1, 1, 1, 1, 1, 1, 1, 2, 2])
#: Most labelled rows of each kind that cues are mined from, and most documents the scorer is trained on.
LABELLED_SAMPLE, TRAINING_SAMPLE = 4_000, 6_000
HASH_BITS = 16
#: Least share of toxic rows a cue occurs in, and least share of its rows that are toxic.
CUE_SHARE, CUE_PRECISION = 0.01, 0.99
#: Least surprise of a cue: log chance of so many toxic rows if it were as common there as in the other rows.
CUE_SURPRISE = 14.0
#: A labeller fires on clean documents this often at most; without a bound two classes may swap their meaning.
MOST_FALSE = 0.01
STARTS = (4, 5, 6, 7)
#: Below so many words only cues and symbols are looked at.
FEW = 5
#: Runs of symbols, and symbols that stand alone; either pattern begins with a plain class, which is searched for fastest.
_RUNS, _LONE = re.compile(r"[^\w\s][^\w\s]+"), re.compile(r"[|~^<>=*#](?<=\s.)(?=\s)")
_EDGES = r"^\p{Punct}+|\p{Punct}+$"
_TRIM = ".,;:!?\"'()[]"


class Cues:
    """The two labellers that look for cues: words, and starts of words."""

    def __init__(self, words: frozenset[str], starts: frozenset[str]) -> None:
        self.words, self.starts = words, starts
        self.heads = {start[: STARTS[0]] for start in starts}

    def votes(self, text: str) -> int:
        """Starts are cut to every length only from words that begin like one; the cost does not follow the number of cues."""
        bare = {t.strip(_TRIM) for t in text.lower().split()}
        fired = 0 if self.words.isdisjoint(bare) else 128
        if not self.heads.isdisjoint([b[: STARTS[0]] for b in bare]):
            begun = [b for b in bare if b[: STARTS[0]] in self.heads]
            if not self.starts.isdisjoint([b[:k] for b in begun for k in STARTS if len(b) >= k]):
                fired |= 256
        return fired


def votes_of(text: str | None, cues: Cues) -> int:
    """The labellers that fire, as bits in the order of ``LABELLERS``."""
    tokens = text.split() if text else []
    n = len(tokens)
    if not n:
        return 1
    distinct = set(tokens)
    fired = cues.votes(text)
    if len(_RUNS.findall(text)) + len(_LONE.findall(text)) > max(1 if n < FEW else 0, 0.1 * n):
        fired |= 2
    if n < FEW:  # too little for shares of words and lines
        return fired
    if sum(map(str.isupper, tokens)) > 0.2 * n:
        fired |= 4
    if sum(map(operator.eq, tokens, tokens[1:])) > max(2, 0.08 * n):
        fired |= 8
    if len(distinct) < 0.12 * n and n >= 30:
        fired |= 16
    lines = [line for line in text.split("\n") if line.strip()]
    if len(lines) >= 4 and len(set(lines)) < 0.5 * len(lines):
        fired |= 32
    if not 2 <= len(text) / n - 1 <= 25:
        fired |= 64
    return fired


def learn_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Class shares and each labeller's chance to fire in each class, by expectation-maximisation over counted patterns.

    Labellers start as rather right; one token of prior on each chance keeps rare ones defined.
    """
    fired = (patterns[:, None] >> np.arange(len(LABELLERS))) & 1
    seen = _seen(fired)
    share = np.array([0.8, 0.12, 0.08])
    chance = np.full((3, len(LABELLERS)), 0.02)
    for k, kind in enumerate(_FOR):
        chance[kind, k] = 0.5
    for _ in range(rounds):
        weight = posteriors(fired, share, chance) * counts[:, None]
        total = weight.sum(axis=0)
        share = (total + 1) / (total.sum() + 3)
        chance = (weight.T @ fired + 0.02) / (weight.T @ seen + 1)
        chance[0] = np.minimum(chance[0], MOST_FALSE)
    return share, chance


def _seen(fired: np.ndarray) -> np.ndarray:
    """Which labellers had anything to look at: of an empty text, which draws the first vote alone, only that one."""
    seen = np.ones_like(fired)
    seen[(fired[:, 0] == 1) & (fired.sum(axis=1) == 1), 1:] = 0
    return seen


def posteriors(fired: np.ndarray, share: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Chance of each class, given which labellers fired."""
    chance = np.clip(chance, 1e-6, 1 - 1e-6)
    seen = _seen(fired)
    logs = np.log(share) + (fired * seen) @ np.log(chance).T + ((1 - fired) * seen) @ np.log1p(-chance).T
    likely = np.exp(logs - logs.max(axis=1, keepdims=True))
    return likely / likely.sum(axis=1, keepdims=True)


def features_of(text: str | None, votes: int) -> np.ndarray:
    """Hashed features: lower-case words, their starts, and the votes."""
    words = {t.strip(_TRIM) for t in text.lower().split()} if text else set()
    words |= {w[:k] + "*" for w in words if len(w) > STARTS[0] for k in STARTS if len(w) > k}
    mask = (1 << HASH_BITS) - 1
    hashed = {zlib.crc32(w.encode()) & mask for w in words}
    hashed = np.fromiter(hashed, np.int64, len(hashed))
    fired = [mask + 1 + k for k in range(len(LABELLERS)) if votes >> k & 1] or [mask + 1 + len(LABELLERS)]
    return np.concatenate([hashed, np.array(fired, np.int64)])


_WIDTH = (1 << HASH_BITS) + len(LABELLERS) + 1


def _summed(row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What the features of a row speak for; hashed words share one unit of length, votes count whole."""
    votes = row >= 1 << HASH_BITS
    words = row[~votes]
    return weights[row[votes]].sum(axis=0) + weights[words].sum(axis=0) / np.sqrt(max(len(words), 1))


def _chances(sums: np.ndarray) -> np.ndarray:
    out = np.exp(sums - sums.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def train_scorer(rows: list[np.ndarray], targets: np.ndarray, rounds: int = 50, rate: float = 0.3) -> np.ndarray:
    """Weights of a linear scorer with the posteriors as soft targets, by adaptive gradient steps."""
    weights, seen = np.zeros((_WIDTH, 3)), np.full((_WIDTH, 3), 1e-6)
    if not rows:
        return weights
    sizes = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    vote = flat >= 1 << HASH_BITS
    words = np.maximum(np.bincount(owner, ~vote, len(rows)), 1)
    value = np.where(vote, 1.0, 1 / np.sqrt(words)[owner])
    for _ in range(rounds):
        z = np.stack([np.bincount(owner, value * weights[flat, k], len(rows)) for k in range(3)], axis=1)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = (z / z.sum(axis=1, keepdims=True) - targets) / len(rows)
        slope = np.stack([np.bincount(flat, value * error[owner, k], _WIDTH) for k in range(3)], axis=1)
        seen += slope**2
        weights -= rate * slope / np.sqrt(seen)
    return weights


def _starts(length: int) -> Column:
    return F.transform("bare", lambda w: F.concat(F.lit("^"), F.substring(w, 1, length)))


def mine_cues(docs: DataFrame, labels: DataFrame, sample: int = LABELLED_SAMPLE) -> tuple[frozenset[str], frozenset[str]]:
    """Words, and starts of words, that tell toxic rows from others among at most ``2 * sample`` labelled rows."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    some = [known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for kind in (True, False)]
    chosen = some[0].union(some[1]).distinct()  # at most 2 * sample short rows
    words = F.array_distinct(F.split(F.lower(text_of("text")), SPACE_CLASS))
    bare = F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, _EDGES, "")))
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", bare.alias("bare"))
    rows = joined.select("toxic", F.explode(F.array_distinct(F.concat("bare", *map(_starts, STARTS)))).alias("c"))
    counted = rows.groupBy("c").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good"))
    sizes = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    if not bad:
        return frozenset(), frozenset()
    rate_bad, rate_good = F.col("bad") / bad, (F.col("good") + 0.5) / (good + 1)
    expected = (F.col("good") + 1) / (good + 1) * bad
    surprise = F.col("bad") * F.log(F.col("bad") / expected) - (F.col("bad") - expected)
    telling = (rate_bad >= CUE_SHARE) & (rate_bad / (rate_bad + rate_good) >= CUE_PRECISION) & (surprise >= CUE_SURPRISE)
    kept = counted.where(telling & (F.char_length("c") >= 4))
    found = [r.c for r in kept.select("c").collect()]  # at most 1 / CUE_SHARE of the distinct words of a row
    return frozenset(c for c in found if c[0] != "^"), frozenset(c[1:] for c in found if c[0] == "^")


class Model:
    """What was learned: cues, class shares, labeller accuracies and scorer weights."""

    def __init__(self, words: frozenset[str], starts: frozenset[str], share: np.ndarray, chance: np.ndarray, weights: np.ndarray) -> None:
        self.words, self.starts, self.share, self.chance, self.weights = words, starts, share, chance, weights


def _vote(cues: Cues):
    @F.pandas_udf("int")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([votes_of(t, cues) for t in texts], dtype="int32")

    return vote


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = TRAINING_SAMPLE) -> Model:
    """Learns from votes on all documents; ``labels`` (doc_id, toxic) only gives cues and may be missing or empty."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    words, starts = mine_cues(docs, labels) if labels is not None else (frozenset(), frozenset())
    cues = Cues(words, starts)
    counted = docs.select(_vote(cues)("text").alias("votes")).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).toPandas()
    share, chance = learn_accuracies(counted["votes"].to_numpy(np.int64), counted["n"].to_numpy(float))
    total = int(counted["n"].sum()) if len(counted) else 0
    steps = 1 << 30
    few = docs.where(F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 100)), F.lit(steps)) < int(steps * min(1.0, sample / max(total, 1))))

    @F.pandas_udf("votes int, features binary")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            votes = [votes_of(t, cues) for t in texts]
            rows = [features_of(t, v).astype(np.int32).tobytes() for t, v in zip(texts, votes)]
            yield pd.DataFrame({"votes": votes, "features": rows})

    drawn = few.select(described("text").alias("d")).select("d.*").limit(2 * sample).toPandas()
    rows = [np.frombuffer(f, np.int32).astype(np.int64) for f in drawn["features"]]
    fired = (drawn["votes"].to_numpy(np.int64)[:, None] >> np.arange(len(LABELLERS))) & 1
    targets = posteriors(fired, share, chance) if rows else np.empty((0, 3))
    return Model(words, starts, share, chance, train_scorer(rows, targets))


def judged(model: Model, text: Column) -> Column:
    """Struct of votes, the three class chances by the scorer, and keep (clean is likelier than not)."""
    cues, weights = Cues(model.words, model.starts), model.weights.astype(np.float32)

    @F.pandas_udf("votes int, clean double, junk double, toxic double, keep boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            votes, sums = np.empty(len(texts), np.int32), np.empty((len(texts), 3))
            for i, text in enumerate(texts):  # a text's features are gone before the next one is read
                votes[i] = votes_of(text, cues)
                sums[i] = _summed(features_of(text, int(votes[i])), weights)
            scores = _chances(sums)
            yield pd.DataFrame({"votes": votes, "clean": scores[:, 0], "junk": scores[:, 1], "toxic": scores[:, 2], "keep": scores[:, 0] >= 0.5})

    return judge(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, votes, clean, junk, toxic, keep.

    Null texts and texts without a word draw the vote "empty", which speaks for junk, and are not kept. A few words are no
    fault: of texts below ``FEW`` words only cues and symbols are looked at. Long texts are read whole. Ties keep the document.
    Repeated rows stay and weigh each time; other columns are ignored; an empty table gives an empty table.
    """
    model = fit(docs, labels)
    return docs.select("doc_id", judged(model, F.col("text")).alias("j")).select("doc_id", "j.*")


def keep_good(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    model = fit(docs, labels)
    told = docs.select(F.struct("*").alias("_doc"), judged(model, F.col("text")).alias("_judged"))
    return told.where("_judged.keep").select("_doc.*")
