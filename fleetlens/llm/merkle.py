"""A Merkle manifest of a table: a tree of digests per key, and one tree over their roots.

A node is a row labelled with the interval of leaf ranks it covers. Ancestors are attached by joins in which a node's interval
contains another's; both sides carry the level and the bucket of the interval, so the joins are on equal keys. Siblings are
what is left of a parent's interval without the child's.

Trees grow ``LEVELS`` levels at a time from buckets of at most 2 ** LEVELS nodes, and proofs are put together along the same
buckets from the top down: a node joins its own few levels, and takes over the rest from the bucket's top. So no key or tree, however large,
is ever in one task, and rows moved follow the leaves, not leaves times height.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

#: Levels of a tree that one step builds or proves.
LEVELS = 6

#: Columns of a leaf, in this order. Fixed values.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row within it below
NODE = ["tree", "n", "level", "lo", "hi", "digest"]


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values' concatenation."""
    return F.sha2(F.concat(*values), 256)


def leaf_digest(changes: Mapping[str, Column] | None = None) -> Column:
    """A row's digest: each column as its length in bytes, a colon and its value, or ``-`` where it is null."""
    values = [(changes or {}).get(name, F.col(name)).cast("string") for name in LEAF_COLUMNS]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def place(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank``, the 0-based place within ``tree``, and ``n``, the tree's rows.

    Rows are sorted by range and kept; a rank is the row's number in its partition, from the tree's first row there, plus the
    tree's rows in the partitions before. What is windowed has a row per partition and tree.
    """
    kept = stored(df.orderBy("tree", *order).withColumn("_mark", F.monotonically_increasing_id()), "placed")
    kept = kept.withColumn("_part", F.shiftrightunsigned("_mark", _ROW_BITS)).withColumn("_row", F.col("_mark").bitwiseAND((1 << _ROW_BITS) - 1))
    runs = kept.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_rows").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "_part", "_first", before.alias("_before"), F.sum("_rows").over(tree).alias("n"))
    ranked = kept.join(runs, ["tree", "_part"]).withColumn("rank", F.col("_row") - F.col("_first") + F.col("_before"))
    return stored(ranked.drop("_mark", "_part", "_row", "_first", "_before"), "ranked")


def _top() -> Column:
    """The level of a tree's root, from its number of leaves."""
    return F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)


def _paired(row: Column) -> Column:
    """The digests of every two consecutive nodes, of the last alone if there is no other."""
    starts = F.sequence(F.lit(0), F.floor((F.size(row) - 1) / 2).cast("int"))
    return F.transform(starts, lambda i: digest(F.get(row, i * 2), F.coalesce(F.get(row, i * 2 + 1), F.lit(""))))


def grow(leaves: DataFrame) -> DataFrame:
    """All nodes (tree, n, level, lo, hi, digest) over leaves (tree, n, rank, digest); level 0 are the leaves."""
    base = leaves.select("tree", "n", F.lit(0).alias("level"), F.col("rank").alias("lo"), F.col("rank").alias("hi"), "digest")
    most = leaves.agg(F.max("n")).first()[0] or 0
    grown, level = [base], 0
    while max(most - 1, 0) >> level:
        bucket = F.shiftright("lo", level + LEVELS).alias("bucket")
        rows = base.groupBy("tree", "n", bucket).agg(F.sort_array(F.collect_list(F.struct("lo", "digest"))).alias("nodes"))
        steps = F.sequence(F.lit(1), F.least(F.lit(LEVELS), _top() - level))
        first = F.array(F.col("nodes.digest"))
        levels = F.aggregate(steps, first, lambda done, _: F.concat(done, F.array(_paired(F.element_at(done, -1)))))
        each = rows.select("tree", "n", "bucket", F.posexplode(levels).alias("k", "row")).where("k > 0")
        each = each.select("tree", "n", "bucket", (F.col("k") + level).alias("level"), "k", F.posexplode("row").alias("i", "digest"))
        lo = F.expr(f"shiftleft(shiftleft(bucket, {LEVELS} - k) + i, level)")
        each = each.withColumn("lo", lo).withColumn("hi", F.least("n", F.expr("lo + shiftleft(1L, level)")) - 1)
        built = stored(each.select(*NODE), "nodes")
        grown.append(built)
        level += LEVELS
        base = built.where((F.col("level") == level) & (_top() > level))
    return reduce(DataFrame.unionByName, grown)


def siblings(nodes: DataFrame) -> DataFrame:
    """For every node but roots (tree, level, bucket, lo, hi): the digests of its run's others, ``before`` and ``after`` it.

    A parent is the node of the next level whose interval contains the child's; the others cover what the child's interval
    leaves of the parent's.
    """
    parents = nodes.where("level > 0").select(
        "tree", (F.col("level") - 1).alias("level"), F.expr("shiftright(lo, level)").alias("above"), F.col("lo").alias("from"), F.col("hi").alias("to")
    )
    children = nodes.where(F.col("level") < _top()).withColumn("above", F.expr("shiftright(lo, level + 1)"))
    held = children.join(parents, ["tree", "level", "above"]).where("from <= lo AND hi <= to")
    runs = held.groupBy("tree", "level", "above", "from", "to").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("run"))
    each = runs.select("tree", "level", "run", "from", "to", F.explode("run").alias("me"))

    def rest(low: Column, high: Column) -> Column:
        found = F.filter("run", lambda x: (x["lo"] >= low) & (x["hi"] <= high))
        return F.array_join(F.transform(found, lambda x: x["digest"]), "")

    return each.select(
        "tree",
        "level",
        F.expr("shiftright(me.lo, level)").alias("bucket"),
        F.col("me.lo").alias("lo"),
        F.col("me.hi").alias("hi"),
        rest(F.col("from"), F.col("me.lo") - 1).alias("before"),
        rest(F.col("me.hi") + 1, F.col("to")).alias("after"),
    )


def prove(leaves: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Leaves (tree, n, rank and others) with ``path``, their siblings level by level, and the other columns of ``roots``.

    ``roots`` has a row per tree: tree, n, path (what follows above the tree's root) and others.
    """
    beside = stored(siblings(nodes), "siblings")
    others = [c for c in roots.columns if c not in ("tree", "n", "path")]
    most = roots.agg(F.max("n")).first()[0] or 0
    # a tree's root stands for itself at its own level
    anchors = roots.select("tree", _top().alias("level"), F.lit(0).cast("long").alias("bucket"), "path", *others)
    proven = anchors
    levels = [k for k in range(0, 64, LEVELS) if max(most - 1, 0) >> k] or [0]
    for level in reversed(levels):
        last = level == 0
        high = F.least(F.lit(level + LEVELS), _top())
        if last:
            subjects = leaves.withColumn("lo", F.col("rank")).withColumn("hi", F.col("rank"))
        else:
            subjects = nodes.where((F.col("level") == level) & (_top() > level)).select("tree", "n", "lo", "hi")
        subjects = subjects.withColumn("_high", high).withColumn("_anchor", F.expr("shiftright(lo, _high)"))
        steps = F.when(F.col("_high") > level, F.sequence(F.lit(level), F.col("_high") - 1))
        asked = subjects.select("tree", "lo", F.col("hi").alias("_hi"), F.explode(steps).alias("level")).withColumn("bucket", F.expr("shiftright(lo, level)"))
        around = beside.withColumnsRenamed({"lo": "_from", "hi": "_to"})
        found = asked.join(around, ["tree", "level", "bucket"]).where("_from <= lo AND _hi <= _to")
        own = found.groupBy("tree", "lo").agg(F.sort_array(F.collect_list(F.struct("level", "before", "after"))).alias("_own"))
        whole = subjects.join(own, ["tree", "lo"], "left")
        above = proven.select("tree", F.col("level").alias("_high"), F.col("bucket").alias("_anchor"), F.col("path").alias("_rest"), *others)
        whole = whole.join(above, ["tree", "_high", "_anchor"])
        path = F.concat(F.coalesce(F.transform("_own", lambda x: F.struct(x["before"].alias("before"), x["after"].alias("after"))), F.array()), "_rest")
        whole = whole.withColumn("path", path).drop("_own", "_rest", "_high", "_anchor")
        if last:
            return whole.drop("lo", "hi")
        here = whole.select("tree", F.lit(level).alias("level"), F.expr(f"shiftright(lo, {level})").alias("bucket"), "path", *others)
        proven = stored(here, "paths").unionByName(anchors)
    raise AssertionError("level 0 is always proven")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def proof_text(path: Column) -> Column:
    """The siblings' digests from the leaf up, one after the other."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def manifest(docs: DataFrame, changes: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, claimed, subroot, root, path.

    There is a tree per ``lang``, its leaves by ascending doc_id, and a tree over their roots by ``lang``, null first.
    ``claimed`` is the leaf with the columns of ``changes`` in place of the stored ones; ``path`` lists, level by level up to
    the root, the digests ``before`` and ``after`` the node in its run, empty where there is none.

    Null columns have a mark of their own in a leaf, empty and very long texts are digested whole. Rows of one doc_id (null
    first) are ordered by their leaf; repeated rows are leaves of their own. An empty table gives an empty one. Other columns,
    whatever their names, are ignored.
    """
    rows = docs.select(*LEAF_COLUMNS)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree")
    leaves = stored(rows.select("doc_id", tree, leaf_digest().alias("leaf"), leaf_digest(changes).alias("claimed")), "leaves")
    leaves = place(leaves, ["doc_id", "leaf", "claimed"])
    nodes = grow(leaves.withColumn("digest", F.col("leaf")))

    subroots = nodes.where(F.col("level") == _top()).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("size"), F.col("digest"))
    subroots = place(subroots, ["name"])
    above = grow(subroots)
    root = above.where(F.col("level") == _top()).select("tree", "n", F.col("digest").alias("root"))
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    tops = prove(subroots, above, root.withColumn("path", nothing))
    roots = stored(tops.select(F.col("name").alias("tree"), F.col("size").alias("n"), "path", F.col("digest").alias("subroot"), "root"), "roots")
    return prove(leaves, nodes, roots).select("doc_id", "leaf", "claimed", "subroot", "root", "path")
