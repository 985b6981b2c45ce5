"""Pages, totals and row caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from fleetlens import fixed
from fleetlens.session import checkpoint

# Rows up to which a page is cut from a top-k heap; deeper pages are found by position. Each
# task sends that many rows to the merge, so it stays in the low thousands.
SHALLOW_ROWS = 2_000

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row within it below


class RowLimitExceeded(ValueError):
    """A stated row cap is above the highest permitted one."""

    code = 400


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """All rows with their 0-based place in a total order.

    A window over everything would put all rows in one task. Here the rows are sorted by
    range and kept once in the shared folder; a place is the row's number within its
    partition plus the rows of the partitions before, of which there are only as many as
    partitions.
    """
    mark = F.monotonically_increasing_id()
    kept = checkpoint(df.orderBy(*order).withColumn("_mark", mark))
    part = F.shiftrightunsigned("_mark", _ROW_BITS)
    row = F.col("_mark").bitwiseAND((1 << _ROW_BITS) - 1)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    placed = kept.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_start") + row).drop("_part", "_mark", "_start")


def page(
    df: DataFrame, order: Sequence[Column], number: int, size: int, rank: str | None = None
) -> DataFrame:
    """Rows ``number * size`` up to but without ``(number + 1) * size`` of a total order.

    Usual pages become one top-k per task and a merge. A page too deep for that is cut by
    position, so no task has to hold the rows before it. ``rank`` adds the 1-based place.
    """
    first = number * size
    if first + size > SHALLOW_ROWS:
        at = F.col("_position")
        rows = with_position(df, order, "_position").filter((at >= first) & (at < first + size))
        if rank:
            rows = rows.withColumn(rank, at + 1)
        return rows.orderBy(at).drop("_position")
    rows = df.orderBy(*order).offset(first).limit(size)
    if rank:
        # a page has at most ``size`` rows, so an unpartitioned window is fine here
        rows = rows.withColumn(rank, F.row_number().over(Window.orderBy(*order)) + F.lit(first))
    return rows


def page_with_total(
    df: DataFrame, order: Sequence[Column], number: int, size: int, rank: str | None = None
) -> DataFrame:
    """A page beside the number of all rows. The total is one row, whatever the data."""
    total = df.agg(F.count("*").alias("total"))
    rows = page(df, order, number, size, rank)
    # at most ``size`` rows; past the last page the total stays, beside nulls
    return total.join(F.broadcast(rows), F.lit(True), "left").select(*rows.columns, "total")


def permitted_cap(stated: int | None, default: int = fixed.DEFAULT_ROW_LIMIT, most: int = fixed.MAX_ROW_LIMIT) -> int:
    """The row cap that applies, given the stated one."""
    cap = default if stated is None else stated
    if cap > most:
        raise RowLimitExceeded(f"row limit {cap} exceeds {most}")
    return cap


def first_rows(df: DataFrame, cap: int) -> tuple[list[Row], bool]:
    """At most ``cap`` rows on the driver, and whether there are more.

    ``take`` reads as few partitions as it needs, where a written-out limit would run every
    one of them.
    """
    rows = df.take(cap + 1)
    return rows[:cap], len(rows) > cap


def cap_rows(
    df: DataFrame,
    limit: int | None = None,
    default: int = fixed.DEFAULT_ROW_LIMIT,
    most: int = fixed.MAX_ROW_LIMIT,
) -> tuple[DataFrame, bool]:
    """The first rows of a result and whether there were more; the cap bounds what moves."""
    rows, more = first_rows(df, permitted_cap(limit, default, most))
    return df.sparkSession.createDataFrame(rows, df.schema), more
