"""Filtering, searching, projecting, sorting and summing applications."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from fleetlens import fixed


def filter_apps(
    df: DataFrame,
    states: Sequence[str] = tuple(fixed.DEFAULT_APP_STATES),
    user: str = "",
    types: Sequence[str] = (),
    queue: str = "",
) -> DataFrame:
    """Applications that meet every given condition; an empty one restricts nothing.

    Plain comparisons with literals, so they reach the scan.
    """
    wanted = [
        F.col("state").isin(list(states)) if states else None,
        F.col("user") == user if user else None,
        F.col("applicationType").isin(list(types)) if types else None,
        F.col("queue") == queue if queue else None,
    ]
    given = [c for c in wanted if c is not None]
    return df.filter(reduce(Column.__and__, given)) if given else df


def search_name(df: DataFrame, needle: str, column: str = "name") -> DataFrame:
    """Rows whose name contains the needle, in any case; no wildcards."""
    return df.filter(F.contains(F.lower(column), F.lower(F.lit(needle)))) if needle else df


def project_visible(
    df: DataFrame, visible: Sequence[str] | None = None, toggled: Sequence[str] = ()
) -> DataFrame:
    """The shown columns in display order; only these are read.

    ``visible`` names an exact set instead of the usual one; ``toggled`` flips single columns.
    """
    shown = {c for c, on in fixed.APP_COLUMNS if on} if visible is None else set(visible)
    shown ^= set(toggled)
    return df.select(*[c for c, _ in fixed.APP_COLUMNS if c in shown and c in df.columns])


def sort_keys(df: DataFrame, column: str | None, desc: bool = False, tie: Sequence[str] = ("id",)) -> list[Column]:
    """Sort columns for one header: numbers by value, all else by language order of its text.

    ``tie`` columns follow so that equal rows always come out alike.
    """
    ties = [F.asc(c) for c in tie]
    if column is None:
        return ties
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        key = F.col(column)
    else:
        key = F.collate(F.coalesce(F.col(column).cast("string"), F.lit("null")), "UNICODE")
    return [key.desc() if desc else key.asc(), *ties]


def sort_apps(df: DataFrame, column: str | None = None, desc: bool = False, tie: Sequence[str] = ("id",)) -> DataFrame:
    """All rows, sorted; without a column they stay as they come."""
    return df if column is None else df.orderBy(*sort_keys(df, column, desc, tie))


def rollup_apps(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and held resources per group, combined before the shuffle."""
    running = F.col("state") == "RUNNING"
    return df.groupBy(*by).agg(
        F.count("*").alias("apps"),
        F.count_if(running).alias("running"),
        F.count_if(F.col("state") == "ACCEPTED").alias("pending"),
        F.coalesce(F.sum(F.when(running, F.col("allocatedMB"))), F.lit(0)).cast("long").alias("usedMB"),
        F.coalesce(F.sum(F.when(running, F.col("allocatedVCores"))), F.lit(0)).cast("long").alias("usedVCores"),
    )


def facet_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column as ``(facet, value)``, in one pass over the rows."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([], list(columns), "facet", "value").filter(F.col("value").isNotNull()).distinct()


def facets(df: DataFrame, columns: Sequence[str], previous: DataFrame | None = None) -> DataFrame:
    """Filter choices: the values seen now and before, sorted within each facet."""
    values = facet_values(df, columns)
    if previous is not None:
        values = values.unionByName(previous.select("facet", "value")).distinct()
    return values.orderBy("facet", "value")
