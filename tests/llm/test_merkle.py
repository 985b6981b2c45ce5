"""The Merkle manifest against a plain tree."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import merkle, queries
from fleetlens.llm.merkle import fold, manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, n int, level string, path string"


def proved(spark, monkeypatch, rows):
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA).repartition(4)
    monkeypatch.setattr(queries, "_table", lambda *_: docs)
    return sorted(map(tuple, queries.op13_manifest(spark, "").collect()), key=str)


def made_rows(n, langs, seed=1):
    rng = random.Random(seed)
    return [(i * 3 % 1009, f"s{i % 4}", rng.choice(langs), rng.randrange(99), f"text {i}") for i in range(n)]


EDGES = [
    (None, None, None, None, None), (None, "", "", 0, ""), (None, "a", "en", 5, "tie"), (None, "a", "en", 5, "tie"), (7, "a", "é", None, "x" * 100_000),
    (7, "b", "é", 2**63 - 1, "1:x-"), (7, "b", "é", 3, None), (8, "b", "z", -1, "\u0000 \n"), (9, "\U0001f600", "\ue000", 1, "t"), (9, "-", "\U0001f600", 1, "t"),
]


@pytest.mark.parametrize("n", [3, 64, 65])
def test_one_tree(spark, monkeypatch, n):
    rows = made_rows(n, ["en"])
    assert proved(spark, monkeypatch, rows) == sorted(brute.merkle(rows), key=str)


@pytest.mark.parametrize("levels", [1, 6])
def test_trees_of_all_sizes(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = EDGES + made_rows(40, ["en", "de", None]) + made_rows(60, ["en"], 2) + [(i, "s", f"l{i}", 1, "t") for i in range(21)]
    got = proved(spark, monkeypatch, rows)
    assert got == sorted(brute.merkle(rows), key=str)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_nothing_and_one_row(spark, monkeypatch):
    assert proved(spark, monkeypatch, []) == []
    (row,) = proved(spark, monkeypatch, [(5, None, None, None, None)])
    assert row[1] == row[2] == row[3] == row[5] and row[4] == brute.sha("") and row[6]


def test_nodes_cover_their_leaves(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    leaves = merkle.place(docs.select(F.lit("t").alias("tree"), "doc_id", merkle.leaf_digest().alias("digest")), ["doc_id"])
    nodes = merkle.grow(leaves).collect()
    n = docs.count()
    for level in {r.level for r in nodes}:
        here = sorted((r.lo, r.hi) for r in nodes if r.level == level)
        assert here[0][0] == 0 and here[-1][1] == n - 1 and all(a[1] + 1 == b[0] for a, b in zip(here, here[1:]))


def test_a_tree_is_never_in_one_task(spark):
    docs = spark.range(0, 6000, 1, 6).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 50 == 0, "de").otherwise("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    proven = manifest(docs)
    assert proven.where(fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0 and proven.select("root").distinct().count() == 1
    plan = proven._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
