"""The plans that queries must have at scale."""

import contextlib
import io

import pytest

from fleetlens.catalogue import QUERIES
from fleetlens.session import shared_dir, work_dir


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def of(spark, tables, name):
    return plan(QUERIES[name](spark, tables))


def test_filters_reach_the_scan(spark, tables):
    # states are computed from ids here, so the user's own columns carry the test
    from pyspark.sql import functions as F

    from fleetlens.operators.apps import filter_apps
    from fleetlens.operators.workflows import in_range

    path = work_dir(spark, "plan")
    apps = spark.range(10).select(F.lit("RUNNING").alias("state"), F.lit("u").alias("user"), F.lit("q").alias("queue"), F.lit("t").alias("applicationType"))
    apps.write.parquet(path)
    text = plan(filter_apps(spark.read.parquet(path), user="u", types=["t"]).select("queue"))
    assert "EqualTo(user,u)" in text and "EqualTo(state,RUNNING)" in text and "ReadSchema: struct<state" in text

    from datetime import datetime

    orders = spark.read.parquet(f"{tables}/orders.parquet")
    text = plan(in_range(orders, datetime(1998, 1, 1), column="o_orderdate").select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_pages_are_top_k(spark, tables):
    for name in ("apps_page", "apps_sorted_page", "page_totals", "listing_page", "top_nodes"):
        assert "TakeOrderedAndProject" in of(spark, tables, name), name


def test_totals_are_broadcast_as_one_row(spark, tables):
    for name in ("queue_usage", "queue_quota"):
        text = of(spark, tables, name)
        assert "BroadcastNestedLoopJoin" in text and "CartesianProduct" not in text


def test_latest_is_combined_before_the_shuffle(spark, tables):
    text = of(spark, tables, "latest_app_state")
    assert text.count("Exchange") >= 1 and "Window" not in text
    assert text.index("partial_max") < text.index("Exchange", text.index("partial_max"))


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith(("fmt_", "audit_", "node_", "path_")) and n not in ("audit_verdict_counts", "audit_table_refs")])
def test_column_functions_do_not_shuffle(spark, tables, name):
    assert "Exchange" not in of(spark, tables, name)


def test_queue_trees_do_not_shuffle(spark, tables):
    for name in ("queue_tree", "queue_fields"):
        assert "Exchange" not in of(spark, tables, name)


def test_logs_leave_the_scan_as_ids(spark, tables):
    text = of(spark, tables, "task_app_link")
    exchanges = [line for line in text.splitlines() if "Exchange" in line or "Arguments: hashpartitioning" in line]
    assert exchanges and "log#" not in " ".join(exchanges)


def test_no_python_in_any_plan(spark, tables):
    quick = [n for n in QUERIES if not n.startswith(("sql_", "stream_", "guarded_", "capped_", "csv_export"))]
    for name in quick:
        text = of(spark, tables, name)
        assert "PythonUDF" not in text and "ArrowEvalPython" not in text and "BatchEvalPython" not in text and "MapInPandas" not in text, name


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or shared_dir(spark))
    assert work_dir(spark, "x").startswith(shared_dir(spark)) and work_dir(spark, "x") != work_dir(spark, "x")


@contextlib.contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(k) for k in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_a_busy_workflow_is_split(spark):
    """One workflow holds most tasks: its join is cut into several tasks and loses no row."""
    from pyspark.sql import functions as F

    from fleetlens.operators.workflows import expand_tasks

    flows = spark.range(2000).select("id", F.lit("w").alias("name"))
    parent = F.when(F.col("id") % 3 < 2, F.lit(7)).otherwise(F.col("id") % 1500)
    tasks = spark.range(300_000).select("id", parent.alias("processInstanceId"), F.sha2(F.col("id").cast("string"), 256).alias("name"))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
    }
    with settings(spark, **small):
        df = expand_tasks(flows, tasks)
        rows = df.collect()
        text = plan(df)
    # workflow 7 and every third one below 1500 have tasks
    assert len(rows) == 300_000 + 1_499 and sum(r.id is None for r in rows) == 1_499
    assert "skew=true" in text


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        def __init__(self, **conf):
            self.conf = conf

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session(**{"spark.master": "yarn"}))
    assert shared_dir(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///work"})) == "hdfs:///work"
    local = shared_dir(Session(**{"spark.master": "local[2]"}))
    assert local and local == shared_dir(Session(**{"spark.master": "local[4]"}))
