"""Queues: leaves, quota and use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions import queue_quota, severity, utilisation


def leaf_queues(queues: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Names of the queues without children, in language order, per ``keys`` (a snapshot).

    For flat queue tables, which know parents only; straight from the snapshots,
    ``sources.scheduler.leaf_names`` needs no join.
    """
    below = queues.filter(F.col("parent").isNotNull())
    if "path" in queues.columns:  # the same name may stand at several places of a tree
        up = F.expr("left(path, char_length(path) - char_length(queueName) - 1)")
        by, parents = "path", below.select(*keys, up.alias("path")).distinct()
    else:
        by, parents = "queueName", below.select(*keys, F.col("parent").alias("queueName")).distinct()
    leaves = queues.filter(F.col("queueName") != "").join(parents, [*keys, by], "left_anti")
    names = leaves.select(*keys, "queueName")
    return names.orderBy(*keys, F.collate("queueName", "UNICODE"), "queueName")


def with_totals(queues: DataFrame, totals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every queue beside the cluster's totals, of its own snapshot if ``keys`` name one.

    Without keys the totals are folded to a single row here, which is what makes their
    broadcast safe; totals of several snapshots are an error, as no cluster has the largest
    figure of each. With keys both sides are joined on them, queues kept.
    """
    names = ("totalMB", "totalVirtualCores")
    figures = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names]
    if keys:
        return queues.join(totals.groupBy(*keys).agg(*figures), list(keys), "left")
    several = F.raise_error(F.lit("totals of several snapshots: name their key"))
    figures = [F.when(F.count(F.lit(1)) > 1, several).otherwise(F.coalesce(F.max(c), F.lit(0))).alias(c) for c in names]
    return queues.crossJoin(F.broadcast(totals.agg(*figures)))


def queue_usage(queues: DataFrame, totals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Quota, utilisation and severity of memory and cores of every queue."""
    rows = with_totals(queues, totals, keys)
    kind, share = F.col("scheduler"), F.col("absoluteCapacity")
    memory_total, core_total = (F.coalesce(F.col(c), F.lit(0)) for c in ("totalMB", "totalVirtualCores"))
    memory = queue_quota(kind, F.col("quotaMemory"), F.col("fairMemory"), share, memory_total)
    cores = queue_quota(kind, F.col("quotaVCores"), F.col("fairVCores"), share, core_total)
    rows = rows.withColumns({"memQuota": memory, "vcoreQuota": cores})
    rows = rows.withColumns(
        {
            "memPct": utilisation(F.col("memory"), F.col("memQuota")),
            "vcorePct": utilisation(F.col("vCores"), F.col("vcoreQuota")),
        }
    )
    return rows.withColumn("memSeverity", severity(F.col("memPct"))).drop("totalMB", "totalVirtualCores")
