"""Use against a total."""

from pyspark.sql import Column, functions as F

from fleetlens import fixed
from fleetlens.functions.numbers import round_half_up


def utilisation(used: Column, total: Column) -> Column:
    """Whole percent, 100 at most; nothing to use means 0."""
    used, total = used.cast("double"), total.cast("double")
    percent = F.least(F.lit(100).cast("long"), round_half_up((used / total) * 100))
    return F.when(total > 0, percent).otherwise(F.lit(0).cast("long"))


def severity(percent: Column) -> Column:
    return (
        F.when(percent >= fixed.HIGH_USE, "high")
        .when(percent >= fixed.MEDIUM_USE, "medium")
        .otherwise("normal")
    )


def severity_colour(percent: Column) -> Column:
    return (
        F.when(percent >= fixed.HIGH_USE, fixed.USE_COLOURS["high"])
        .when(percent >= fixed.MEDIUM_USE, fixed.USE_COLOURS["medium"])
        .otherwise(fixed.USE_COLOURS["normal"])
    )


def queue_quota(scheduler: Column, hard_limit: Column, fair_share: Column, percent: Column, total: Column) -> Column:
    """What a queue may use, for memory and for cores alike.

    Fair queues: the hard limit, else the fair share, else the whole cluster.
    Other queues: their part of the cluster, else the whole cluster.
    """
    total = total.cast("double")
    fair = (
        F.when(hard_limit > 0, hard_limit.cast("double"))
        .when(fair_share != 0, fair_share.cast("double"))
        .otherwise(total)
    )
    by_capacity = F.when(percent > 0, (total * percent) / 100).otherwise(total)
    return F.when(scheduler == "fair", fair).otherwise(by_capacity)
