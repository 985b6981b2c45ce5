"""Readers of landed snapshot files.

Each reader has two faces: one over files of JSON lines and one over a column of JSON
text (landed through a queue or a table). Both only project and explode, so a snapshot
never leaves the task that read it, and unused fields are not parsed. The file face also
reads a stream of landing files, and with ``stamped`` keeps when each file landed. Applications,
metrics and listings take the ``fields`` asked for; the schema they are parsed by holds no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens import schemas


def _landed(spark: SparkSession, path: str, schema: str, stream: bool, stamped: bool) -> tuple[DataFrame, list[str]]:
    """Landed documents, as a table or as a stream, and the columns to keep beside their rows."""
    docs = (spark.readStream if stream else spark.read).schema(schema).json(path)
    if not stamped:
        return docs, []
    return docs.withColumn("landed", F.col("_metadata.file_modification_time")), ["landed"]


def _parsed(df: DataFrame, text: str, schema, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.from_json(text, schema).alias("doc"))


def _apps(df: DataFrame, envelope: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.inline(f"{envelope}.app"))


def read_apps(
    spark: SparkSession, path: str, stream: bool = False, stamped: bool = False, fields: Sequence[str] | None = None
) -> DataFrame:
    """One row per application of every envelope; an envelope without applications adds none."""
    docs, keep = _landed(spark, path, schemas.application_envelope(fields), stream, stamped)
    return _apps(docs, "apps", keep)


def apps_from_text(
    df: DataFrame, text: str = "value", keep: list[str] | None = None, fields: Sequence[str] | None = None
) -> DataFrame:
    keep = keep or []
    return _apps(_parsed(df, text, schemas.application_envelope(fields), keep), "doc.apps", keep)


def _metrics(df: DataFrame, envelope: str, keep: list[str], fields: Sequence[str] | None) -> DataFrame:
    names = schemas.METRIC_NAMES if fields is None else fields
    zeros = [F.coalesce(F.col(f"{envelope}.{name}"), F.lit(0)).cast("long").alias(name) for name in names]
    return df.select(*keep, *zeros)


def read_metrics(
    spark: SparkSession, path: str, stream: bool = False, stamped: bool = False, fields: Sequence[str] | None = None
) -> DataFrame:
    """One row of cluster metrics per snapshot; what is missing is 0."""
    docs, keep = _landed(spark, path, schemas.metrics_envelope(fields), stream, stamped)
    return _metrics(docs, "clusterMetrics", keep, fields)


def metrics_from_text(
    df: DataFrame, text: str = "value", keep: list[str] | None = None, fields: Sequence[str] | None = None
) -> DataFrame:
    keep = keep or []
    return _metrics(_parsed(df, text, schemas.metrics_envelope(fields), keep), "doc.clusterMetrics", keep, fields)


def _listing(df: DataFrame, folder: str, envelope: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.col(folder).alias("dir"), F.inline(f"{envelope}.FileStatus"))


def read_listing(
    spark: SparkSession, path: str, stream: bool = False, stamped: bool = False, fields: Sequence[str] | None = None
) -> DataFrame:
    """One row per entry of every listed folder; an absent listing adds none."""
    docs, keep = _landed(spark, path, schemas.listing_envelope(fields), stream, stamped)
    return _listing(docs, "dir", "FileStatuses", keep)


def listing_from_text(
    df: DataFrame, text: str = "value", keep: list[str] | None = None, fields: Sequence[str] | None = None
) -> DataFrame:
    keep = keep or []
    return _listing(_parsed(df, text, schemas.listing_envelope(fields), keep), "doc.dir", "doc.FileStatuses", keep)


def _bean(beans: str, suffix: str) -> Column:
    """The first bean whose name ends with ``suffix``; null when there is none."""
    return F.get(F.filter(beans, lambda b: F.endswith(b["name"], F.lit(suffix))), F.lit(0))


def _cluster(df: DataFrame, beans: str, keep: list[str]) -> DataFrame:
    """One row per snapshot; a snapshot without the bean reads as zeros."""
    found = df.select(*keep, _bean(beans, "FSNamesystem").alias("bean"))
    zeros = [F.coalesce(F.col(f"bean.{n}"), F.lit(0)).cast("long").alias(n) for n in schemas.STORAGE_NUMBERS]
    return found.select(*keep, *zeros)


def _nodes(df: DataFrame, beans: str, keep: list[str]) -> DataFrame:
    """One row per live node that has room at all.

    The map of nodes comes as a JSON string or as an object; read as a string column both
    arrive as the same text. Text that does not parse holds no nodes.
    """
    info = df.select(*keep, _bean(beans, "NameNodeInfo").alias("bean"))
    nodes = info.select(*keep, F.explode(F.from_json("bean.LiveNodes", schemas.LIVE_NODES)).alias("host", "node"))
    zeros = [F.coalesce(F.col(f"node.{n}"), F.lit(0)).cast("long").alias(n) for n in schemas.NODE_NUMBERS]
    rows = nodes.select(*keep, "host", *zeros, F.col("node.adminState").alias("adminState"))
    return rows.filter(F.col("capacity") > 0)


def read_storage(
    spark: SparkSession, path: str, stream: bool = False, stamped: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Cluster figures and live nodes of every storage snapshot."""
    docs, keep = _landed(spark, path, schemas.STORAGE_ENVELOPE, stream, stamped)
    return _cluster(docs, "beans", keep), _nodes(docs, "beans", keep)


def storage_from_text(
    df: DataFrame, text: str = "value", keep: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    keep = keep or []
    docs = _parsed(df, text, schemas.STORAGE_ENVELOPE, keep)
    return _cluster(docs, "doc.beans", keep), _nodes(docs, "doc.beans", keep)
