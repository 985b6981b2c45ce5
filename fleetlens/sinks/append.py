"""Appending to permitted tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.types import StructType

from fleetlens.governance.policy import Policy

# two plain names: with dots or slashes inside, a name could lead out of its folder
_TARGET = re.compile(r"[A-Za-z0-9_$]+\.[A-Za-z0-9_$]+")


class NotWritable(PermissionError):
    """The target is on no list of writable tables."""

    code = 403


def is_target_writable(target: str, policy: Policy) -> bool:
    """Whether ``source.table`` is such a name and listed, itself or by its whole source."""
    return _TARGET.fullmatch(target) is not None and any(target.startswith(w[:-1]) if w.endswith(".*") else target == w for w in policy.writable_tables)


def guarded_append(df: DataFrame, target: str, folder: str, policy: Policy) -> DataFrame:
    """Appends ``df`` to ``folder/source/table`` and tells how many rows that were.

    Rows are counted while they are written, so the data is read once.
    """
    if not is_target_writable(target, policy):
        raise NotWritable(f"{target} is not writable")
    source, _, table = target.partition(".")
    return append_counted(df, f"{folder.rstrip('/')}/{source}/{table}")


def append_counted(df: DataFrame, path: str) -> DataFrame:
    """Appends ``df`` to the table at ``path``; one row with the number of rows, counted while they are written."""
    written = Observation()
    counted = df.observe(written, F.count(F.lit(1)).alias("affected_rows"))
    counted.write.mode("append").parquet(path)
    return df.sparkSession.createDataFrame([(written.get["affected_rows"],)], "affected_rows bigint")


def fitted(df: DataFrame, schema: StructType, columns: Sequence[str] = ()) -> DataFrame:
    """A query's columns, taken by place, as the columns of a table.

    ``columns`` are the table's columns they are meant for, all in order if none are named; the table's others are null. A value
    that does not fit its column's type is an error when the rows are written.
    """
    names = {f.name.lower(): f.name for f in schema.fields}
    wanted = [names.get(c.lower()) for c in columns] if columns else schema.names
    if None in wanted or len(set(wanted)) < len(wanted) or len(wanted) != len(df.columns):
        raise AnalysisException(f"{len(df.columns)} values do not fit the columns ({', '.join(columns or schema.names)})")
    given = df.toDF(*[f"_{i}" for i in range(len(wanted))])
    place = {name: f"_{i}" for i, name in enumerate(wanted)}
    return given.select(*[(F.col(place[f.name]) if f.name in place else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
