"""Operators against brute force on small tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetlens import fixed
from fleetlens.operators import apps as A
from fleetlens.operators import paging, queues
from fleetlens.operators import workflows as W
from fleetlens.operators.latest import latest_by
from fleetlens.operators.listing import sort_listing
from fleetlens.operators.queues import leaf_queues, queue_usage
from fleetlens.operators.storage import cluster_usage

APPS = [
    ("a1", "Load-A", "RUNNING", "ann", "q1", "SPARK", 30),
    ("a2", "load-b", "FINISHED", "bob", "q1", "SPARK", 20),
    ("a3", "_tmp", "RUNNING", "ann", "q2", "TEZ", 10),
    ("a4", "100%_x", "KILLED", None, "q2", "TEZ", None),
    ("a5", "éclair", "ACCEPTED", "Zoe", "q1", "FLINK", 10),
]
KIND = "id string, name string, state string, `user` string, queue string, applicationType string, allocatedMB bigint"


@pytest.fixture
def apps(spark):
    return spark.createDataFrame(APPS, KIND).withColumn("allocatedVCores", F.lit(1))


def ids(df):
    return [r.id for r in df.collect()]


def test_filter(apps):
    assert set(ids(A.filter_apps(apps))) == {"a1", "a3"}
    assert len(ids(A.filter_apps(apps, states=()))) == 5
    assert ids(A.filter_apps(apps, states=["FINISHED", "RUNNING"], user="ann", types=["TEZ"])) == ["a3"]
    assert ids(A.filter_apps(apps, states=(), queue="q9")) == []


def test_search_takes_no_wildcards(apps):
    assert set(ids(A.search_name(apps, "LOAD"))) == {"a1", "a2"}
    assert ids(A.search_name(apps, "%_")) == ["a4"]
    assert len(ids(A.search_name(apps, ""))) == 5


def test_columns(apps):
    assert [c for c, _ in fixed.APP_COLUMNS][:5] == ["name", "state", "user", "id", "queue"]
    assert len(fixed.APP_COLUMNS) == 32 and sum(on for _, on in fixed.APP_COLUMNS) == 15
    assert A.project_visible(apps).columns == ["name", "state", "user", "id", "queue", "allocatedVCores", "allocatedMB", "applicationType"]
    assert A.project_visible(apps, visible=["id", "name"]).columns == ["name", "id"]
    assert A.project_visible(apps, visible=["id"], toggled=["id", "state"]).columns == ["state"]


def test_sort(apps):
    assert ids(A.sort_apps(apps, "name")) == ["a3", "a4", "a5", "a1", "a2"]
    assert ids(A.sort_apps(apps, "name", desc=True)) == ["a2", "a1", "a5", "a4", "a3"]
    assert ids(A.sort_apps(apps.filter("allocatedMB IS NOT NULL"), "allocatedMB")) == ["a3", "a5", "a2", "a1"]
    assert ids(A.sort_apps(apps)) == ["a1", "a2", "a3", "a4", "a5"]
    assert ids(A.sort_apps(apps, "user")) == ["a1", "a3", "a2", "a4", "a5"]


def test_facets_accumulate(apps, spark):
    first = A.facets(apps, ["user", "applicationType"])
    assert [tuple(r) for r in first.collect()] == [("applicationType", "FLINK"), ("applicationType", "SPARK"), ("applicationType", "TEZ"), ("user", "Zoe"), ("user", "ann"), ("user", "bob")]
    more = spark.createDataFrame([("cid",), ("ann",)], "`user` string")
    assert [r.value for r in A.facets(more, ["user"], first).collect() if r.facet == "user"] == ["Zoe", "ann", "bob", "cid"]


def test_rollup(apps):
    got = {r.queue: r for r in A.rollup_apps(apps, ["queue"]).collect()}
    assert (got["q1"].apps, got["q1"].running, got["q1"].pending, got["q1"].usedMB) == (3, 1, 1, 30)
    assert (got["q2"].apps, got["q2"].running, got["q2"].pending, got["q2"].usedMB, got["q2"].usedVCores) == (2, 1, 0, 10, 1)


def test_latest_with_ties_and_a_hot_key(spark):
    rows = [("hot", i % 50, i) for i in range(3000)] + [("cold", 1, 5), ("cold", 1, 6), ("null", None, 3), ("null", 0, 1)]
    df = spark.createDataFrame(rows, "k string, seq int, v int").repartition(7)
    got = {r.k: (r.seq, r.v) for r in latest_by(df, ["k"], "seq").collect()}
    assert got == {"hot": (49, 2999), "cold": (1, 6), "null": (0, 1)}
    assert latest_by(df, ["k"], "seq").columns == ["k", "seq", "v"]


def test_pages(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    order = [F.col("v").asc()]
    assert [r.v for r in paging.page(df, order, 3, 16).collect()] == list(range(48, 64))
    ranked = paging.page(df, order, 62, 16, "place").collect()
    assert [(r.v, r.place) for r in ranked] == [(v, v + 1) for v in range(992, 1000)]
    assert paging.page(df, order, 99, 16).collect() == []
    assert [r.total for r in paging.page_with_total(df, order, 0, 2).collect()] == [1000, 1000]


def test_deep_pages_are_the_same_pages(spark, monkeypatch):
    monkeypatch.setattr(paging, "SHALLOW_ROWS", 10)
    df = spark.range(1000).repartition(5).select((F.col("id") * 7919 % 1000).alias("v"))
    got = paging.page(df, [F.col("v").desc()], 30, 16, "place").collect()
    assert [(r.v, r.place) for r in got] == [(999 - i, i + 1) for i in range(480, 496)]
    placed = paging.with_position(df, [F.col("v").asc()]).collect()
    assert len(placed) == 1000 and all(r.v == r.position for r in placed)


def test_row_caps(spark):
    df = spark.range(150)
    shown, more = paging.cap_rows(df)
    assert (shown.count(), more) == (100, True)
    shown, more = paging.cap_rows(df, 150)
    assert (shown.count(), more) == (150, False)
    empty, more = paging.cap_rows(df.filter("id < 0"))
    assert (empty.columns, empty.count(), more) == (["id"], 0, False)
    with pytest.raises(paging.RowLimitExceeded):
        paging.cap_rows(df, 10_001)


def test_listing_order(spark):
    rows = [("/b", "z", "DIRECTORY"), ("/a", "b", "FILE"), ("/a", "A", "SYMLINK"), ("/a", "a", "FILE"), ("/a", "y", "DIRECTORY"), ("/a", "B", "DIRECTORY")]
    df = spark.createDataFrame(rows, "dir string, pathSuffix string, type string")
    got = [(r.dir, r.pathSuffix) for r in sort_listing(df).collect()]
    assert got == [("/a", "B"), ("/a", "y"), ("/a", "a"), ("/a", "A"), ("/a", "b"), ("/b", "z")]


def test_leaf_queues(spark):
    rows = [(1, "root", None), (1, "b", "root"), (1, "A", "root"), (1, "c", "b"), (2, "root", None), (2, "", "root")]
    df = spark.createDataFrame(rows, "snapshot int, queueName string, parent string")
    assert [tuple(r) for r in leaf_queues(df, ["snapshot"]).collect()] == [(1, "A"), (1, "c")]


def test_queue_usage_without_totals(spark):
    kind = "queueName string, scheduler string, absoluteCapacity double, quotaMemory bigint, quotaVCores bigint, fairMemory bigint, fairVCores bigint, memory bigint, vCores bigint"
    queues = spark.createDataFrame([("q", "capacity", 50.0, 0, 0, None, None, 10, 1)], kind)
    totals = spark.createDataFrame([], "totalMB bigint, totalVirtualCores bigint")
    row = queue_usage(queues, totals).first()
    assert (row.memQuota, row.memPct, row.memSeverity) == (0.0, 0, "normal")


def test_cluster_usage(spark):
    kind = "CapacityTotal bigint, CapacityUsed bigint, CapacityRemaining bigint, CapacityUsedNonDFS bigint"
    row = cluster_usage(spark.createDataFrame([(1000, 845, 100, 54), ], kind)).first()
    assert (row.usedPct, row.remainingPct, row.nonDfsPct, row.usedText) == (85, 15, 5, "845 B")


def test_ranges(spark):
    day = "2024-01-{:02d} 12:00:00"
    df = spark.createDataFrame([(i, day.format(i)) for i in range(1, 11)], "id int, t string")
    df = df.select("id", F.col("t").cast("timestamp_ntz").alias("startTime"))
    as_of = datetime(2024, 1, 9, 12)
    assert ids(W.in_range(df, as_of, "1d")) == [8, 9]
    assert ids(W.in_range(df, as_of)) == [6, 7, 8, 9]
    assert ids(W.in_range(df, as_of, "7d")) == list(range(2, 10))
    assert len(ids(W.in_range(df, as_of, "all"))) == 10


def test_instances(spark):
    df = spark.createDataFrame([(1, "SUCCESS", "load_a"), (2, "FAILURE", "Load_b")], "id int, state string, name string")
    assert ids(W.filter_instances(df)) == [1, 2]
    assert ids(W.filter_instances(df, state="FAILURE")) == [2]
    assert ids(W.filter_instances(df, name="load")) == [1]
    assert (W.choose_view("  "), W.choose_view(" x ")) == ("process", "task")


def test_expand_tasks_keeps_every_workflow(spark):
    flows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id bigint, name string")
    tasks = spark.createDataFrame([(i, 1, "t") for i in range(500)] + [(900, 3, "u"), (901, 7, "orphan")], "id bigint, processInstanceId bigint, name string")
    got = W.expand_tasks(flows, tasks).collect()
    by = {}
    for r in got:
        by.setdefault((r.processInstanceId, r.workflow_name), []).append(r.id)
    assert {k: len(v) for k, v in by.items()} == {(1, "a"): 500, (2, "b"): 1, (3, "c"): 1}
    assert by[2, "b"] == [None]
    assert W.expand_tasks(flows, tasks, "inner").count() == 501


def test_link_apps(spark):
    tasks = spark.createDataFrame([(i,) for i in range(6)], "id bigint")
    far = "\n" * 300 + "application_1_9"
    near = "\n" * 299 + "application_1_9"
    logs = spark.createDataFrame([(0, "x application_1_7 application_1_9"), (1, far), (2, near), (3, "none"), (4, "application_5_5")], "taskInstanceId bigint, log string")
    apps = spark.createDataFrame([("application_1_7", "RUNNING"), ("application_1_9", "KILLED"), ("#3", "TRAP")], "id string, state string")
    got = {r.id: (r.appId, r.app_state, r.appUrl) for r in W.link_apps(tasks, logs, apps, "http://rm/").collect()}
    assert got[0] == ("application_1_7", "RUNNING", "http://rm/cluster/app/application_1_7")
    assert got[1][:2] == ("application_1_9", "KILLED") and got[3] == (None, None, None) and got[5] == (None, None, None)
    assert got[2][:2] == ("application_1_9", "KILLED") and got[4] == ("application_5_5", None, "http://rm/cluster/app/application_5_5")
    part = {r.id: r.appId for r in W.link_apps(tasks, logs, apps, "http://rm", lines=300).collect()}
    assert part[1] is None and part[2] == "application_1_9"


def test_leaves_by_path(spark):
    rows = [("root", None, "root"), ("a", "root", "root.a"), ("x", "a", "root.a.x"), ("b", "root", "root.b"), ("a", "b", "root.b.a")]
    flat = spark.createDataFrame(rows, "queueName string, parent string, path string")
    assert [r.queueName for r in queues.leaf_queues(flat).collect()] == ["a", "x"]


def test_totals_of_several_snapshots(spark):
    flat = spark.createDataFrame([("root",)], "queueName string")
    totals = spark.createDataFrame([(100, 50), (200, 10)], "totalMB bigint, totalVirtualCores bigint")
    assert queues.with_totals(flat, totals.limit(1)).first().totalMB == 100
    with pytest.raises(Exception, match="several snapshots"):
        queues.with_totals(flat, totals).collect()


def test_total_past_the_last_page(spark):
    got = paging.page_with_total(spark.range(5), [F.col("id")], 9, 2).collect()
    assert [(r.id, r.total) for r in got] == [(None, 5)]
