"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints of 64 bits within ``BITS`` bits of each other must, for any split of the bits into partitions with thresholds
t1..tm where the sum of (ti + 1) is BITS + 1, agree up to ti in some partition i. Correlated bits are grouped into one
partition, and the thresholds are dealt by dynamic programming over candidate counts estimated on a bounded sample, so a
partition whose values crowd together gets -1 (not probed) and an even one more. Inside a probed partition the bits that are
left are cut again by the plain principle, so keys stay selective at any size. Candidates are verified bit by bit.

Equal fingerprints are brought together first. A key's group is never listed as pairs: it yields the links of a spanning
forest. Groups above ``GROUP_ROWS`` are cut into parts and each pair of parts is a task's group of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import LOWER, UPPER, stored
from fleetlens.llm.components import components

SHINGLE = 3
BITS = 3
PARTITIONS = 4
#: How many fingerprints the plan is estimated on; the plan decides cost, never results.
SAMPLE = 20_000
#: Rows of one key that one task compares.
GROUP_ROWS = 20_000
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def simhash(text: str | None) -> int:
    """A bit is set if it is set in over half the XXH64 hashes of the word shingles; no words give zero."""
    words = text.encode().translate(_LOWERED).split() if text else []
    if not words:
        return 0
    one = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return one(b" ".join(words), 42)
    hashes = np.fromiter((one(b" ".join(s), 42) for s in zip(*(words[k:] for k in range(SHINGLE)))), np.uint64, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[start : start + 65_536]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(text: Column) -> Column:
    """The fingerprint of each text as a signed long."""

    @F.pandas_udf("long")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.fromiter(map(simhash, texts), np.uint64, len(texts)).view(np.int64))

    return sign(text)


def bit_groups(sample: np.ndarray, groups: int = PARTITIONS) -> list[list[int]]:
    """The 64 bits in ``groups`` of equal size, each grown from a free bit by the bits most correlated with it."""
    ones = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    if len(ones) < 2:
        return [list(range(k, 64, groups)) for k in range(groups)]
    ones -= ones.mean(axis=0)
    scale = np.sqrt((ones**2).mean(axis=0)) + 1e-9
    tied = np.abs((ones / scale).T @ (ones / scale)) / len(ones)
    free, out = set(range(64)), []
    while len(out) < groups:
        group = [min(free)]
        free.remove(group[0])
        while len(group) < 64 // groups:
            best = max(sorted(free), key=lambda b: tied[b, group].sum())
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def taken(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each value, packed."""
    out = np.zeros(len(values), np.uint64)
    for place, bit in enumerate(bits):
        out |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out


def flips(bits: int, distance: int) -> np.ndarray:
    """All masks of up to ``distance`` of ``bits`` bits."""
    masks = [sum(1 << b for b in c) for d in range(distance + 1) for c in itertools.combinations(range(bits), d)]
    return np.array(masks, np.uint64)


def thresholds(sample: np.ndarray, groups: list[list[int]], bits: int = BITS, most: int = 1) -> list[int]:
    """The threshold of each group, -1 to most, with sum of (t + 1) = bits + 1 and the least estimated work."""
    cost = []
    for group in groups:
        values, counts = np.unique(taken(sample, group), return_counts=True)
        work = [0.0]
        for t in range(most + 1):
            probes = values[:, None] ^ flips(len(group), t)[None, :]
            at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
            met = np.where(values[at] == probes, counts[at], 0).sum(axis=1)
            work.append(float((counts * met).sum()) + len(sample) * probes.shape[1])
        cost.append(work)
    best = {0: (0.0, [])}
    for work in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for extra, more in enumerate(work):
                new = (total + more, [*chosen, extra - 1])
                if used + extra <= bits + 1 and new < step.get(used + extra, (float("inf"), [])):
                    step[used + extra] = new
        best = step
    return best[bits + 1][1]


def keyed(fingerprint: np.ndarray, groups: list[list[int]], limits: list[int], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row numbers, keys, probing) of every table: a probed group's value with one of the pieces of the other bits.

    Two values that agree up to t in the group differ in at most ``bits`` of the other bits, so of bits + 1 pieces of
    those they share one. With t above 0 one side probes all values near its own.
    """
    rows = np.arange(len(fingerprint))
    for g, (group, limit) in enumerate(zip(groups, limits)):
        if limit < 0:
            continue
        rest = [b for b in range(64) if b not in group]
        own = taken(fingerprint, group)
        for p in range(bits + 1):
            piece = taken(fingerprint, rest[p :: bits + 1])
            table = np.uint64(g * (bits + 1) + p) << np.uint64(56)
            low = piece << np.uint64(len(group))
            yield rows, table | low | own, False
            for mask in flips(len(group), limit)[1:]:
                yield rows, table | low | (own ^ mask), True


def _linked(values: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among the values.

    Values outside the largest tree are compared with all, those inside never with each other: once every value outside
    has had its turn no link between two trees can be left.
    """
    label = np.arange(len(values))
    waiting = np.ones(len(values), bool)
    while True:
        large = np.bincount(label).argmax()
        outside = np.flatnonzero(waiting & (label != large))
        if not len(outside):
            return
        for at in outside:
            if label[at] == large:
                continue
            waiting[at] = False
            near = np.flatnonzero((np.bitwise_count(values ^ values[at]) <= bits) & (label != label[at]))
            if not len(near):
                continue
            trees, firsts = np.unique(label[near], return_index=True)
            for first in firsts:
                yield at, near[first]
            joined = np.append(trees, label[at])
            label[np.isin(label, joined)] = large if large in joined else label[at]


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list[pd.DataFrame]]]:
    """Runs of equal (key, part) in batches that come sorted by them."""
    key, held = None, []
    for batch in batches:
        names = list(zip(batch["key"], batch["low"], batch["high"]))
        starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1])]
        for start, end in zip(starts, [*starts[1:], len(names)]):
            if names[start] != key:
                if held:
                    yield key, held
                key, held = names[start], []
            held.append(batch.iloc[start:end])
    if held:
        yield key, held


def _probed(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = [], []
        for _, held in _groups(batches):
            print_ = np.concatenate([h["print"].to_numpy() for h in held])
            if len(print_) < 2:
                continue
            values = np.unique(print_).view(np.uint64)
            for a, b in _linked(values, bits):
                left.append(values[a])
                right.append(values[b])
            if len(left) >= 50_000:
                yield pd.DataFrame({"a": np.array(left).view(np.int64), "b": np.array(right).view(np.int64)})
                left, right = [], []
        if left:
            yield pd.DataFrame({"a": np.array(left).view(np.int64), "b": np.array(right).view(np.int64)})

    return run


def link(prints: DataFrame, bits: int = BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``bits`` bits; ``prints`` has distinct longs in print."""
    sample = prints.orderBy(F.xxhash64("print")).limit(SAMPLE).toPandas()["print"].to_numpy(np.int64).view(np.uint64)
    groups = bit_groups(sample)
    limits = thresholds(sample, groups, bits)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["print"].to_numpy(np.int64).view(np.uint64)
            for rows, keys, _ in keyed(own, groups, limits, bits):
                yield pd.DataFrame({"key": keys.view(np.int64), "print": own[rows].view(np.int64)})

    rows = stored(prints.select("print").mapInPandas(spread, "key long, print long"), "keys")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    parts = F.ceil(F.col("rows") / group_rows).cast("int")
    crowded = rows.join(sizes.withColumn("parts", parts), "key")
    own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = crowded.select("key", "print", own.alias("own"), other.alias("other"))
    placed = placed.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "print")
    dealt = placed.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInPandas(_probed(bits), "a long, b long")


def near_groups(docs: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, print (signed long), component_id (smallest doc_id reachable, itself included).

    Fingerprints link at ``bits`` or fewer differing bits. Null and empty texts have the fingerprint zero and link like any
    other. A null id never names a component unless the whole component has none. Repeated rows stay. An empty table gives an
    empty table; other columns are ignored.
    """
    signed = docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text_col).cast("string")).alias("print"))
    signed = stored(signed, "prints")
    lowest = signed.groupBy("print").agg(F.min("doc_id").alias("first"))
    found = components(link(signed.select("print").distinct(), bits))
    named = lowest.join(found.withColumnRenamed("node", "print"), "print", "left")
    named = named.withColumn("component", F.coalesce("component", "print"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = named.join(ids, "component").select("print", "component_id")
    return signed.join(of_print, "print").select("doc_id", "print", "component_id")
