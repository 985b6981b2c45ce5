"""Cluster overview: what every queue may use and does use."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens.operators.apps import filter_apps
from fleetlens.operators.queues import queue_usage


def queue_overview(apps: DataFrame, queues: DataFrame, metrics: DataFrame) -> DataFrame:
    """Queues with the running applications' memory and cores against their quota.

    Applications are filtered at the scan and summed per queue before the shuffle, so what
    meets the queues is one row per queue, however long the history is.
    """
    used = (
        filter_apps(apps, states=["RUNNING"])
        .groupBy("queue")
        .agg(
            F.sum("allocatedMB").alias("memory"),
            F.sum("allocatedVCores").alias("vCores"),
            F.count("*").alias("runningApps"),
        )
    )
    joined = queues.join(used, queues["queueName"] == used["queue"], "left").drop("queue")
    filled = joined.fillna(0, ["memory", "vCores", "runningApps"])
    return queue_usage(filled, metrics)
