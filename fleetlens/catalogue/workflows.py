"""Queries over workflows, tasks, logs and paged answers, with their plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens import fixed
from fleetlens import functions as L
from fleetlens.catalogue.views import Views, sql
from fleetlens.operators import workflows as W
from fleetlens.plans.drilldown import workflow_drilldown as drilldown
from fleetlens.sources import logs, pages

RM = "http://rm.example:8088"


def _last_start(df: DataFrame):
    """The newest start as a driver value, so that range ends are literals the scan can use."""
    return df.agg(F.max("startTime")).first()[0]


def instances_last_3d(spark: SparkSession, folder: str) -> DataFrame:
    instances = Views(spark, folder).process_instances
    return W.in_range(instances, _last_start(instances)).select("id", "name", "state", "duration")


def workflow_filter(spark: SparkSession, folder: str) -> DataFrame:
    return W.filter_instances(Views(spark, folder).process_instances, "SUCCESS", "URGENT").select("id", "name", "state")


def task_filter(spark: SparkSession, folder: str) -> DataFrame:
    return W.filter_instances(Views(spark, folder).task_instances, "FAILURE", "sk-1").select("id", "name", "state")


def running_instances(spark: SparkSession, folder: str) -> DataFrame:
    return W.running_only(Views(spark, folder).process_instances).select("id", L.allowed_action(F.col("state")).alias("action"))


def state_labels(spark: SparkSession, folder: str) -> DataFrame:
    return W.with_state(Views(spark, folder).process_instances).select("id", "state", "label", "tag", "running", "action")


def workflow_tasks(spark: SparkSession, folder: str) -> DataFrame:
    views = Views(spark, folder)
    flows = views.process_instances.select("id", "name", "state")
    tasks = views.task_instances.select("id", "processInstanceId", "state")
    return W.expand_tasks(flows, tasks).select("processInstanceId", "workflow_name", "workflow_state", "id", "state")


def log_app_id(spark: SparkSession, folder: str) -> DataFrame:
    return W.mine_app_ids(Views(spark, folder).task_logs, lines=None)


def task_app_link(spark: SparkSession, folder: str) -> DataFrame:
    views = Views(spark, folder)
    mined = W.mine_app_ids(views.task_logs)
    apps = views.apps.select("id", "state", "queue")
    return W.with_apps(mined, apps, RM, key="taskInstanceId").select(
        "taskInstanceId", "appId", "app_state", "app_queue", "appUrl"
    )


def workflow_drilldown(spark: SparkSession, folder: str) -> DataFrame:
    """Workflows of the last seven days, their tasks, and the applications in the tasks' logs."""
    views = Views(spark, folder)
    flows = views.process_instances.select("id", "name", "state", "startTime")
    tasks = views.task_instances.select("id", "processInstanceId", "state")
    apps = views.apps.select("id", "state")
    rows = drilldown(flows, tasks, views.task_logs, apps, RM, _last_start(flows), key="7d")
    return rows.select("processInstanceId", "workflow_name", "id", "state", "appId", "app_state")


def fmt_duration(spark: SparkSession, folder: str) -> DataFrame:
    views = Views(spark, folder)
    columns = ["id", L.format_duration(F.col("duration")).alias("took")]
    return views.process_instances.select(*columns).unionByName(views.task_instances.select(*columns))


def retry_text(spark: SparkSession, folder: str) -> DataFrame:
    tries = F.nullif(F.col("retryTimes"), F.lit(2))
    return Views(spark, folder).task_instances.select("id", L.retry_text(tries, F.col("maxRetryTimes")).alias("retries"))


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return logs.log_lines(Views(spark, folder).task_logs)


def log_slice(spark: SparkSession, folder: str) -> DataFrame:
    return logs.log_slice(Views(spark, folder).task_logs, skip=2, limit=fixed.LOG_LINES_PER_READ)


def is_numeric(spark: SparkSession, folder: str) -> DataFrame:
    views = Views(spark, folder)
    parts = views.table("part")
    key = F.col("p_partkey")
    odd = (
        F.when(key % 6 == 0, F.concat(F.lit("0x"), F.hex(key)))
        .when(key % 6 == 1, F.concat(key.cast("string"), F.lit("e3")))
        .when(key % 6 == 2, F.concat(key.cast("string"), F.lit("d")))
        .when(key % 6 == 3, F.concat(F.lit(" -."), key.cast("string"), F.lit("  ")))
        .when(key % 6 == 4, F.lit("  "))
        .otherwise(F.lit(""))
    )
    texts = [
        views.table("documents").select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("v")),
        parts.select(F.lit("price"), key, F.col("p_retailprice").cast("string")),
        parts.select(F.lit("brand"), key, "p_brand"),
        parts.select(F.lit("odd"), key, odd),
    ]
    rows = texts[0].union(texts[1]).union(texts[2]).union(texts[3])
    return rows.select("kind", "id", L.is_numeric(F.col("v")).alias("numeric"))


def paged_projects(spark: SparkSession, folder: str) -> DataFrame:
    return pages.union_pages(Views(spark, folder).project_pages, ["listing"]).select("listing", "page_no", "id", "name")


def paged_projects_whole(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.union_pages(Views(spark, folder).project_pages, ["listing"], max_pages=None)
    return found.select("listing", "page_no", "id", "name")


def paged_project_errors(spark: SparkSession, folder: str) -> DataFrame:
    return pages.page_errors(Views(spark, folder).project_pages, ["listing"])


QUERIES = {
    f.__name__: f
    for f in [
        instances_last_3d, workflow_filter, task_filter, running_instances, state_labels, workflow_tasks, log_app_id,
        task_app_link, workflow_drilldown, fmt_duration, retry_text, log_lines, log_slice, is_numeric, paged_projects,
        paged_projects_whole, paged_project_errors,
    ]
}

_TOOK = """CASE WHEN duration <= 0 THEN '—' WHEN duration < 60 THEN concat(duration, 's') WHEN duration < 3600 THEN concat(duration // 60, 'm ', duration % 60, 's')
 ELSE concat(duration // 3600, 'h ', duration % 3600 // 60, 'm') END AS took"""
_MINED = "CASE WHEN regexp_matches({t}, 'application_\\d+_\\d+') THEN regexp_extract({t}, 'application_\\d+_\\d+') END"
_NUMBER = (
    "'^([+-]?(Infinity|([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)?$'"
)
_PROJECTS = "(SELECT c_custkey // 1200 AS listing, c_custkey % 1200 // 100 + 1 AS page_no, c_custkey AS id, c_name AS name FROM customer)"


def mined(text: str) -> str:
    return _MINED.replace("{t}", text)


ORACLES = {
    "instances_last_3d": """SELECT id, name, state, duration FROM {process_instances}
 WHERE "startTime" >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 72 HOUR""",
    "workflow_filter": "SELECT id, name, state FROM {process_instances} WHERE state = 'SUCCESS' AND contains(name, 'URGENT')",
    "task_filter": "SELECT id, name, state FROM {task_instances} WHERE state = 'FAILURE' AND contains(name, 'sk-1')",
    "running_instances": "SELECT id, 'PAUSE/STOP' AS action FROM {process_instances} WHERE state = 'RUNNING_EXEUTION'",
    "state_labels": """SELECT id, state, CASE state WHEN 'SUCCESS' THEN '成功' WHEN 'RUNNING_EXEUTION' THEN '运行中' ELSE '待停止' END AS label,
 CASE state WHEN 'SUCCESS' THEN 'success' WHEN 'RUNNING_EXEUTION' THEN 'primary' ELSE 'info' END AS tag, state = 'RUNNING_EXEUTION' AS running,
 CASE WHEN state = 'RUNNING_EXEUTION' THEN 'PAUSE/STOP' ELSE 'REPEAT_RUNNING' END AS action FROM {process_instances}""",
    "workflow_tasks": """SELECT w.id AS "processInstanceId", w.name AS workflow_name, w.state AS workflow_state, t.id, t.state
 FROM {process_instances} w LEFT JOIN {task_instances} t ON t."processInstanceId" = w.id""",
    "log_app_id": f"""SELECT "taskInstanceId", {mined('log')} AS "appId" FROM {{task_logs}}""",
    "task_app_link": f"""WITH m AS (SELECT "taskInstanceId", {mined('log')} AS "appId" FROM {{task_logs}})
 SELECT "taskInstanceId", "appId", a.state AS app_state, a.queue AS app_queue, '{RM}/cluster/app/' || "appId" AS "appUrl" FROM m LEFT JOIN {{apps}} a ON a.id = "appId" """,
    "workflow_drilldown": f"""WITH m AS (SELECT "taskInstanceId", {mined('log')} AS "appId" FROM {{task_logs}}),
 w AS (SELECT id, name FROM {{process_instances}} WHERE "startTime" >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 168 HOUR)
 SELECT w.id AS "processInstanceId", w.name AS workflow_name, t.id, t.state, m."appId", a.state AS app_state FROM w
 LEFT JOIN {{task_instances}} t ON t."processInstanceId" = w.id LEFT JOIN m ON m."taskInstanceId" = t.id LEFT JOIN {{apps}} a ON a.id = m."appId" """,
    "fmt_duration": f"SELECT id, {_TOOK} FROM {{process_instances}} UNION ALL SELECT id, {_TOOK} FROM {{task_instances}}",
    "retry_text": """SELECT id, CASE WHEN "retryTimes" = 2 THEN '—' ELSE concat("retryTimes", '/', coalesce(CAST("maxRetryTimes" AS VARCHAR), '-')) END AS retries FROM {task_instances}""",
    "log_lines": """SELECT "taskInstanceId", CAST(generate_subscripts(string_split(log, chr(10)), 1) - 1 AS INT) AS line_no, unnest(string_split(log, chr(10))) AS line FROM {task_logs}""",
    "log_slice": """SELECT * FROM (SELECT "taskInstanceId", CAST(generate_subscripts(string_split(log, chr(10)), 1) - 1 AS INT) AS line_no, unnest(string_split(log, chr(10))) AS line FROM {task_logs})
 WHERE line_no >= 2 AND line_no < 502""",
    "is_numeric": f"""WITH v AS (SELECT 'text' AS kind, doc_id AS id, text AS v FROM documents UNION ALL SELECT 'price', p_partkey, CAST(p_retailprice AS VARCHAR) FROM part
 UNION ALL SELECT 'brand', p_partkey, p_brand FROM part UNION ALL SELECT 'odd', p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat('0x', hex(p_partkey))
 WHEN 1 THEN concat(p_partkey, 'e3') WHEN 2 THEN concat(p_partkey, 'd') WHEN 3 THEN concat(' -.', p_partkey, '  ') WHEN 4 THEN '  ' ELSE '' END FROM part)
 SELECT kind, id, v <> '' AND regexp_matches(trim(v, chr(10) || chr(13) || chr(9) || ' '), {_NUMBER}) AS numeric FROM v""",
    "paged_project_errors": f"SELECT DISTINCT listing, page_no, 10113 AS code, 'page failed' AS msg FROM {_PROJECTS} WHERE listing % 5 = 1 AND page_no = 2",
}
ORACLES["paged_projects"] = f"""WITH p AS {_PROJECTS} SELECT * FROM p
 WHERE listing NOT IN (SELECT listing FROM p WHERE listing % 5 = 1 AND page_no = 2)"""
ORACLES["paged_projects_whole"] = f"""WITH p AS {_PROJECTS} SELECT * FROM p
 WHERE listing NOT IN (SELECT listing FROM p WHERE listing % 5 = 1 AND page_no = 2)"""
ORACLES = {name: sql(text) for name, text in ORACLES.items()}
