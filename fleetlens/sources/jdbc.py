"""JDBC reader options."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, functions as F

from fleetlens import fixed

if TYPE_CHECKING:
    from fleetlens.sources.registry import Source

FETCH_ROWS = 10_000


@dataclass(frozen=True)
class Partitioning:
    """How a table is read by many tasks at once: equal strides of a number or date column.

    The bounds only place the strides; rows outside them are still read.
    """

    column: str
    lower: str
    upper: str
    tasks: int


def jdbc_url(source: Source, connect_timeout: int) -> str:
    if source.type == "mysql":
        return f"jdbc:mysql://{source.host}:{source.port}/{source.service}?connectTimeout={connect_timeout * 1000}"
    return f"jdbc:oracle:thin:@//{source.host}:{source.port}/{source.service}"


def jdbc_options(
    source: Source,
    table: str,
    query_timeout: int = fixed.QUERY_TIMEOUT_SECONDS,
    connect_timeout: int = fixed.CONNECT_TIMEOUT_SECONDS,
    partitioning: Partitioning | None = None,
) -> dict[str, str]:
    """Options for ``spark.read.format("jdbc")``.

    Without ``partitioning`` the table comes through one connection, so name a column for
    anything large.
    """
    options = {
        "url": jdbc_url(source, connect_timeout),
        "dbtable": table,
        "user": source.user,
        "password": source.password,
        "queryTimeout": str(query_timeout),
        "fetchsize": str(FETCH_ROWS),
    }
    if source.type == "oracle":
        options["oracle.net.CONNECT_TIMEOUT"] = str(connect_timeout * 1000)
    if partitioning is not None:
        options.update(
            partitionColumn=partitioning.column,
            lowerBound=partitioning.lower,
            upperBound=partitioning.upper,
            numPartitions=str(partitioning.tasks),
        )
    return options


def key_bounds(keys: DataFrame, column: str, tasks: int, accuracy: int = 10_000) -> list:
    """Where ``tasks`` ranges of about as many rows begin, by approximate percentiles of known keys.

    ``keys`` is any table that holds them: an earlier copy, an index, a history. At most ``tasks - 1`` values reach the driver.
    """
    shares = [i / tasks for i in range(1, tasks)]
    found = keys.agg(F.percentile_approx(column, shares, accuracy).alias("b")).first() if shares else None
    return sorted(set(found["b"] or [])) if found else []


def _literal(value: object) -> str:
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def jdbc_ranges(column: str, bounds: Iterable) -> list[str]:
    """Conditions, one per task, that share out a table whose keys are dealt unevenly; nulls go to the first.

    Each row meets exactly one of them, whatever the bounds. For the ``predicates`` of a JDBC read.
    """
    starts = [_literal(b) for b in sorted(set(bounds))]
    if not starts:
        return ["1 = 1"]
    first, last = f"{column} < {starts[0]} OR {column} IS NULL", f"{column} >= {starts[-1]}"
    return [first, *(f"{column} >= {a} AND {column} < {b}" for a, b in zip(starts, starts[1:])), last]
