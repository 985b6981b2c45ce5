"""Storage clusters and their nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import format_bytes, node_state, node_state_class, severity, severity_colour, utilisation


def node_usage(nodes: DataFrame) -> DataFrame:
    """Use, severity and state of every node."""
    return (
        nodes.withColumn("usedPct", utilisation(F.col("usedSpace"), F.col("capacity")))
        .withColumn("severity", severity(F.col("usedPct")))
        .withColumn("colour", severity_colour(F.col("usedPct")))
        .withColumn("usedText", format_bytes(F.col("usedSpace")))
        .withColumn("capacityText", format_bytes(F.col("capacity")))
        .withColumn("state", node_state(F.col("adminState")))
        .withColumn("stateClass", node_state_class(F.col("adminState")))
    )


def fullest_first(tie: str = "host") -> list[Column]:
    return [F.col("usedSpace").desc(), F.col(tie).asc()]


def cluster_usage(cluster: DataFrame) -> DataFrame:
    """Used, free and foreign share of every storage cluster snapshot."""
    used = utilisation(F.col("CapacityUsed"), F.col("CapacityTotal"))
    return cluster.withColumns(
        {
            "usedPct": used,
            "remainingPct": F.lit(100) - used,
            "nonDfsPct": utilisation(F.col("CapacityUsedNonDFS"), F.col("CapacityTotal")),
            "usedText": format_bytes(F.col("CapacityUsed")),
            "totalText": format_bytes(F.col("CapacityTotal")),
            "remainingText": format_bytes(F.col("CapacityRemaining")),
        }
    )
