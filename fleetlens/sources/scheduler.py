"""Unrolling scheduler snapshots into one row per queue.

A snapshot is one JSON document holding a tree of any depth. The tree is walked inside
its own row by one fold over its levels, so unrolling needs one pass over the data, no shuffle,
no self-join and no state: every snapshot is independent and an executor lost on the way costs only its own tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NODE_LIST = "array<variant>"
NODES = "array<struct<node: variant, parent: string, depth: int, path: string, name: string>>"


def _text(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "string")


def _children(node: Column) -> Column:
    return F.coalesce(
        F.try_variant_get(node, "$.childQueues.queue", NODE_LIST),
        F.try_variant_get(node, "$.queues.queue", NODE_LIST),
        F.array().cast(NODE_LIST),
    )


def _next_level(level: Column) -> Column:
    def below(item: Column) -> Column:
        return F.transform(
            _children(item["node"]),
            lambda child: F.struct(
                child.alias("node"),
                item["name"].alias("parent"),
                (item["depth"] + 1).alias("depth"),
                F.concat(item["path"], F.lit("."), F.coalesce(_text(child, "$.queueName"), F.lit(""))).alias("path"),
                F.coalesce(_text(child, "$.queueName"), F.lit("")).alias("name"),
            ),
        )

    return F.flatten(F.transform(level, below))


def _walked(roots: Column, levels: Column, fault: Column) -> Column:
    """The nodes of all levels, by a fold that holds the level it stands on and the nodes above it.

    ``levels`` bounds the steps; once a level is empty the rest of them do nothing. What lies deeper is an error.
    """

    def step(acc: Column, _: Column) -> Column:
        deeper = F.struct(_next_level(acc["level"]).alias("level"), F.concat(acc["nodes"], acc["level"]).alias("nodes"))
        return F.when(F.size(acc["level"]) == 0, acc).otherwise(deeper)

    start = F.struct(roots.alias("level"), F.array().cast(NODES).alias("nodes"))
    return F.aggregate(
        F.sequence(F.lit(1), levels), start, step,
        lambda acc: F.when(F.size(acc["level"]) > 0, F.raise_error(fault)).otherwise(acc["nodes"]),
    )


def _rooted(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The root queue, the kind of scheduler and a bound on the levels of every snapshot.

    Each level below the root stands in a list of its own, so a tree has no more of them than its text has brackets.
    """
    doc = F.try_variant_get(F.try_parse_json(text), "$.scheduler.schedulerInfo", "variant")
    brackets = F.length(text) - F.length(F.replace(F.col(text), F.lit("["), F.lit("")))
    rows = df.select(*keep, doc.alias("info"), (brackets + 1).alias("levels"))
    kind = F.lower(F.coalesce(_text(F.col("info"), "$.type"), F.lit("")))
    fair_root = F.try_variant_get("info", "$.rootQueue", "variant")
    is_fair = F.contains(kind, F.lit("fair"))
    has_fair_root = fair_root.isNotNull() & ~F.coalesce(F.is_variant_null(fair_root), F.lit(True))
    scheduler = F.when(is_fair, "fair").when(F.contains(kind, F.lit("capacity")), "capacity").otherwise("unknown")
    return rows.select(
        *keep,
        "levels",
        scheduler.alias("scheduler"),
        F.when(is_fair & has_fair_root, fair_root).otherwise(F.col("info")).alias("root"),
    )


def unroll_queues(
    df: DataFrame,
    text: str = "value",
    keep: list[str] | None = None,
    depth: int | None = None,
    named_root: bool = True,
) -> DataFrame:
    """One row per queue with its parent, depth and path, beside the raw ``node``.

    Trees may have any depth, each its own; a document is parsed once. Given ``depth``, a tree of more levels is an error,
    never a shorter answer. A tree whose root has no name is left out unless ``named_root`` is off.
    """
    keep = keep or []
    name = _text(F.col("root"), "$.queueName")
    top = F.struct(
        F.col("root").alias("node"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(0).alias("depth"),
        name.alias("path"),
        name.alias("name"),
    )
    # an empty list instead of a filter: Spark would push a filter below the parsing and parse twice
    shown = F.coalesce(name, F.lit("")) != "" if named_root else F.col("root").isNotNull()
    roots = F.when(shown, F.array(top)).otherwise(F.array().cast(NODES))
    levels = F.col("levels") if depth is None else F.lit(depth)
    fault = F.concat(F.lit("a queue tree is deeper than "), levels.cast("string"), F.lit(" levels"))
    nodes = _walked(roots, levels, fault)
    rows = _rooted(df, text, keep).select(*keep, "scheduler", F.inline(nodes))
    return rows.withColumnRenamed("name", "queueName")


def leaf_names(
    df: DataFrame, text: str = "value", keep: list[str] | None = None, depth: int | None = None
) -> DataFrame:
    """Names of the queues without children of every snapshot, in language order.

    Each node knows its own children, so no join is needed; only the order is a shuffle.
    """
    keep = keep or []
    rows = unroll_queues(df, text, keep, depth, named_root=False)
    leaves = rows.filter((F.size(_children(F.col("node"))) == 0) & (F.coalesce("queueName", F.lit("")) != ""))
    return leaves.select(*keep, "queueName").orderBy(*keep, F.collate("queueName", "UNICODE"), "queueName")


def normalise_queue(df: DataFrame) -> DataFrame:
    """Flat queue columns out of ``node``, whichever spelling the scheduler uses.

    Plain numbers default to 0; the fair share and the application counts stay null.
    """

    def number(kind: str, *paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get("node", p, kind) for p in paths])

    def resources(first: str, second: str, field: str) -> Column:
        """The first of two resource records that is there at all, then its field."""
        got = F.coalesce(F.try_variant_get("node", f"$.{first}", "variant"), F.try_variant_get("node", f"$.{second}", "variant"))
        return F.try_variant_get(got, f"$.{field}", "bigint")

    def or_zero(c: Column, kind: str) -> Column:
        return F.coalesce(c, F.lit(0).cast(kind))

    columns = {
        "capacity": or_zero(number("double", "$.capacity"), "double"),
        "usedCapacity": or_zero(number("double", "$.usedCapacity"), "double"),
        "absoluteCapacity": or_zero(number("double", "$.absoluteCapacity"), "double"),
        "weight": or_zero(number("double", "$.weight"), "double"),
        "memory": or_zero(resources("usedResources", "resourcesUsed", "memory"), "bigint"),
        "vCores": or_zero(resources("usedResources", "resourcesUsed", "vCores"), "bigint"),
        "quotaMemory": or_zero(number("bigint", "$.maxResources.memory"), "bigint"),
        "quotaVCores": or_zero(number("bigint", "$.maxResources.vCores"), "bigint"),
        "fairMemory": resources("fairResources", "fairShare", "memory"),
        "fairVCores": resources("fairResources", "fairShare", "vCores"),
        "numActiveApps": number("bigint", "$.numActiveApps", "$.numActiveApplications"),
        "numPendingApps": number("bigint", "$.numPendingApps", "$.numPendingApplications"),
    }
    others = [c for c in df.columns if c != "node"]
    return df.select(*others, *[c.alias(name) for name, c in columns.items()])


def read_scheduler(spark: SparkSession, path: str, depth: int | None = None) -> DataFrame:
    """Queues of every scheduler snapshot in files of one JSON document per line."""
    return normalise_queue(unroll_queues(spark.read.text(path), "value", depth=depth))
