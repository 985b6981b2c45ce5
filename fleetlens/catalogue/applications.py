"""Queries over applications, with their plain SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens import functions as L
from fleetlens.catalogue.views import VIEWS, Views, sql
from fleetlens.operators.apps import (
    facets,
    filter_apps,
    project_visible,
    rollup_apps,
    search_name,
    sort_keys,
)
from fleetlens.operators.latest import latest_by
from fleetlens.operators.paging import page, page_with_total, with_position
from fleetlens.session import work_dir
from fleetlens.sources.snapshots import apps_from_text
from fleetlens.streaming.latest import read_latest, stream_latest

AS_OF = datetime(2024, 2, 1, tzinfo=timezone.utc)
AS_OF_MS = 1706745600000


def apps_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    fields = ["id", "name", "state", "user", "queue", "applicationType", "startedTime", "finishedTime", "allocatedMB"]
    return apps_from_text(Views(spark, folder).app_documents, fields=fields)


def apps_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return filter_apps(Views(spark, folder).apps, ["RUNNING", "FINISHED"], "user7", ["SPARK", "FLINK"], "NATION_7")


def apps_running(spark: SparkSession, folder: str) -> DataFrame:
    return filter_apps(Views(spark, folder).apps).select("id", "user", "queue")


def apps_search(spark: SparkSession, folder: str) -> DataFrame:
    return search_name(Views(spark, folder).apps, "CK-Job-1").select("id", "name")


def apps_visible(spark: SparkSession, folder: str) -> DataFrame:
    return project_visible(Views(spark, folder).apps, toggled=["finishedTime"])


def app_facets(spark: SparkSession, folder: str) -> DataFrame:
    return facets(Views(spark, folder).apps, ["user", "applicationType"])


def facet_union(spark: SparkSession, folder: str) -> DataFrame:
    views = Views(spark, folder)
    earlier = views.table("customer").select(F.lit("user").alias("facet"), F.col("c_name").alias("value"))
    return facets(views.apps, ["user"], earlier)


def page_totals(spark: SparkSession, folder: str) -> DataFrame:
    running = filter_apps(Views(spark, folder).apps)
    return page_with_total(running, sort_keys(running, "allocatedMB", desc=True), 1, 16, "place").select(
        "place", "id", "allocatedMB", "total"
    )


def apps_page(spark: SparkSession, folder: str) -> DataFrame:
    apps = Views(spark, folder).apps
    return page(apps, sort_keys(apps, "elapsedTime"), 3, 64, "place").select("place", "id", "elapsedTime")


def apps_sorted_page(spark: SparkSession, folder: str) -> DataFrame:
    apps = Views(spark, folder).apps
    return page(apps, sort_keys(apps, "name"), 0, 1000, "place").select("place", "id", "name")


def app_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Every application with its place when sorted by name, without a single-task window."""
    apps = Views(spark, folder).apps.select("id", "name")
    return with_position(apps, sort_keys(apps, "name"))


def apps_by_state(spark: SparkSession, folder: str) -> DataFrame:
    return rollup_apps(Views(spark, folder).apps, ["state"])


def apps_by_queue(spark: SparkSession, folder: str) -> DataFrame:
    return rollup_apps(Views(spark, folder).apps, ["queue"])


def latest_app_state(spark: SparkSession, folder: str) -> DataFrame:
    rows = Views(spark, folder).apps.select("user", "seq", "id", "state", "allocatedMB")
    return latest_by(rows, ["user"], "seq")


def stream_latest_apps(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a file stream, folded trigger by trigger; equals the batch answer."""
    views = Views(spark, folder)
    schema = views.table(VIEWS["apps"][0]).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(views.folder)
    rows = views.project(events, "apps").select("user", "seq", "id", "state", "allocatedMB")
    sink, progress = work_dir(spark, "latest"), work_dir(spark, "progress")
    stream_latest(rows, ["user"], "seq", sink, progress, every_seconds=None).awaitTermination()
    return read_latest(spark, sink, ["user"], "seq")


def fmt_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    return Views(spark, folder).apps.select(
        "id",
        L.format_timestamp(F.col("startedTime"), AS_OF).alias("started"),
        L.format_timestamp(F.col("finishedTime"), AS_OF).alias("finished"),
        L.format_timestamp(F.col("finishedTime"), AS_OF, humanize=False).alias("finished_raw"),
    )


def fmt_elapsed(spark: SparkSession, folder: str) -> DataFrame:
    elapsed = F.col("elapsedTime")
    return Views(spark, folder).apps.select(
        "id",
        L.format_elapsed(elapsed).alias("short"),
        L.format_elapsed(elapsed * 997).alias("long"),
        L.format_elapsed(elapsed, humanize=False).alias("raw"),
    )


def fmt_mem(spark: SparkSession, folder: str) -> DataFrame:
    memory = F.col("allocatedMB")
    return Views(spark, folder).apps.select(
        "id",
        L.format_mem(memory).alias("held"),
        L.format_mem(memory * 2048).alias("held_much"),
        L.format_mem(memory, humanize=False).alias("held_raw"),
    )


def state_class(spark: SparkSession, folder: str) -> DataFrame:
    kind = L.app_state_class(F.col("state"))
    return Views(spark, folder).apps.select("id", "state", kind.alias("class"), L.badge_type(kind).alias("badge"))


QUERIES = {
    f.__name__: f
    for f in [
        apps_snapshot, apps_filtered, apps_running, apps_search, apps_visible, app_facets, facet_union, page_totals,
        apps_page, apps_sorted_page, app_positions, apps_by_state, apps_by_queue, latest_app_state, stream_latest_apps,
        fmt_timestamp, fmt_elapsed, fmt_mem, state_class,
    ]
}


def _instant(ms: str) -> str:
    age = f"({AS_OF_MS} - {ms})"
    return (
        f"CASE WHEN {ms} = 0 THEN 'n/a' ELSE strftime(make_timestamp(({ms} // 1000) * 1000000), '%Y-%m-%d %H:%M:%S') || ' (' ||"
        f" CASE WHEN {age} < 60000 THEN '刚刚' WHEN {age} < 3600000 THEN CAST({age} // 60000 AS VARCHAR) || ' 分钟前'"
        f" WHEN {age} < 86400000 THEN CAST({age} // 3600000 AS VARCHAR) || ' 小时前'"
        f" ELSE CAST({age} // 86400000 AS VARCHAR) || ' 天前' END || ')' END"
    )


def _elapsed(ms: str) -> str:
    s = f"(({ms}) // 1000)"
    return (
        f"CASE WHEN {ms} = 0 THEN 'n/a' WHEN {s} = 0 THEN '0秒' ELSE concat("
        f"CASE WHEN {s} // 86400 > 0 THEN concat({s} // 86400, '天') END,"
        f"CASE WHEN {s} % 86400 // 3600 > 0 THEN concat({s} % 86400 // 3600, '小时') END,"
        f"CASE WHEN {s} % 3600 // 60 > 0 THEN concat({s} % 3600 // 60, '分') END,"
        f"CASE WHEN {s} % 60 > 0 THEN concat({s} % 60, '秒') END) END"
    )


def tenths(v: str, unit: int) -> str:
    """One decimal of a whole number over a power of two, half rounded up, in whole numbers only."""
    t = f"((CAST({v} AS HUGEINT) * 20 + {unit}) // {unit * 2})"
    return f"concat({t} // 10, '.', {t} % 10)"


def _mem(v: str) -> str:
    return (
        f"CASE WHEN {v} < 1024 THEN concat({v}, ' MB') WHEN {v} < 1048576 THEN concat({tenths(v, 1024)}, ' GB')"
        f" WHEN {v} < 1073741824 THEN concat({tenths(v, 1048576)}, ' TB') ELSE concat({tenths(v, 1073741824)}, ' PB') END"
    )


_ROLLUP = """count(*) AS apps, count(*) FILTER (state = 'RUNNING') AS running, count(*) FILTER (state = 'ACCEPTED') AS pending,
 CAST(coalesce(sum(CASE WHEN state = 'RUNNING' THEN "allocatedMB" END), 0) AS BIGINT) AS "usedMB",
 CAST(coalesce(sum(CASE WHEN state = 'RUNNING' THEN "allocatedVCores" END), 0) AS BIGINT) AS "usedVCores" """
_LATEST = """SELECT "user", seq, id, state, "allocatedMB" FROM {apps}
 QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY seq DESC) = 1"""

ORACLES = {
    "apps_snapshot": """SELECT id, name, state, "user", queue, "applicationType", "startedTime", "finishedTime", "allocatedMB" FROM {apps}
 UNION ALL SELECT id || '_2', name, 'RUNNING', "user", queue, "applicationType", "startedTime", "finishedTime", "allocatedMB"
 FROM {apps} WHERE "allocatedVCores" % 4 = 0""",
    "apps_filtered": """SELECT * FROM {apps} WHERE state IN ('RUNNING', 'FINISHED') AND "user" = 'user7'
 AND "applicationType" IN ('SPARK', 'FLINK') AND queue = 'NATION_7'""",
    "apps_running": """SELECT id, "user", queue FROM {apps} WHERE state = 'RUNNING'""",
    "apps_search": "SELECT id, name FROM {apps} WHERE contains(lower(name), 'ck-job-1')",
    "apps_visible": """SELECT name, state, "user", id, queue, "startedTime", "elapsedTime", "allocatedVCores", "allocatedMB", "applicationType" FROM {apps}""",
    "app_facets": """SELECT DISTINCT 'user' AS facet, "user" AS value FROM {apps}
 UNION SELECT DISTINCT 'applicationType', "applicationType" FROM {apps}""",
    "facet_union": """SELECT 'user' AS facet, "user" AS value FROM {apps} UNION SELECT 'user', c_name FROM customer""",
    "page_totals": """SELECT * FROM (SELECT row_number() OVER (ORDER BY "allocatedMB" DESC, id) AS place, id, "allocatedMB",
 count(*) OVER () AS total FROM {apps} WHERE state = 'RUNNING') WHERE place BETWEEN 17 AND 32""",
    "apps_page": """SELECT * FROM (SELECT row_number() OVER (ORDER BY "elapsedTime", id) AS place, id, "elapsedTime" FROM {apps})
 WHERE place BETWEEN 193 AND 256""",
    "apps_sorted_page": """SELECT * FROM (SELECT row_number() OVER (ORDER BY lower(name), name, id) AS place, id, name FROM {apps})
 WHERE place <= 1000""",
    "app_positions": "SELECT id, name, row_number() OVER (ORDER BY lower(name), name, id) - 1 AS position FROM {apps}",
    "apps_by_state": f"SELECT state, {_ROLLUP} FROM {{apps}} GROUP BY state",
    "apps_by_queue": f"SELECT queue, {_ROLLUP} FROM {{apps}} GROUP BY queue",
    "latest_app_state": _LATEST,
    "stream_latest_apps": _LATEST,
    "fmt_timestamp": f"""SELECT id, {_instant('"startedTime"')} AS started, {_instant('"finishedTime"')} AS finished,
 CASE WHEN "finishedTime" = 0 THEN 'n/a' ELSE CAST("finishedTime" AS VARCHAR) END AS finished_raw FROM {{apps}}""",
    "fmt_elapsed": f"""SELECT id, {_elapsed('"elapsedTime"')} AS short, {_elapsed('("elapsedTime" * 997)')} AS long,
 CASE WHEN "elapsedTime" = 0 THEN 'n/a' ELSE CAST("elapsedTime" AS VARCHAR) END AS raw FROM {{apps}}""",
    "fmt_mem": f"""SELECT id, {_mem('"allocatedMB"')} AS held, {_mem('("allocatedMB" * 2048)')} AS held_much,
 concat("allocatedMB", ' MB') AS held_raw FROM {{apps}}""",
    "state_class": """SELECT id, state, CASE state WHEN 'RUNNING' THEN 'running' WHEN 'FINISHED' THEN 'success' WHEN 'FAILED' THEN 'failure'
 WHEN 'KILLED' THEN 'stopped' ELSE 'neutral' END AS class, CASE state WHEN 'RUNNING' THEN 'primary' WHEN 'FINISHED' THEN 'success'
 WHEN 'FAILED' THEN 'danger' WHEN 'KILLED' THEN 'info' ELSE 'info' END AS badge FROM {apps}""",
}
ORACLES = {name: sql(text) for name, text in ORACLES.items()}
