"""Running totals that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 4096


def running_total(df: DataFrame, keys: list[str], order: str, amount: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the running sum of ``amount`` along the whole number ``order`` within ``keys``.

    A plain window would sort a whole key in one task. Here a key is cut into blocks of
    ``block`` consecutive numbers: totals per block are combined before the shuffle, summed
    along the far fewer blocks, and added to the running sum inside each block.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_amount", amount)
    totals = rows.groupBy(*keys, "_block").agg(F.sum("_amount").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_inside", F.sum("_amount").over(inside))
    return (
        summed.join(base, [*keys, "_block"])
        .withColumn(name, F.col("_base") + F.col("_inside"))
        .drop("_block", "_amount", "_base", "_inside")
    )
