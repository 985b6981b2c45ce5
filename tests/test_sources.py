"""Readers of landed files."""

import json

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.running import running_total
from fleetlens.sources import logs, pages, scheduler, snapshots
from fleetlens.sources.jdbc import Partitioning, jdbc_options, jdbc_ranges, key_bounds
from fleetlens.sources.registry import Registry, UnknownSource


def land(folder, name, docs):
    path = f"{folder}/{name}.json"
    with open(path, "w", encoding="utf-8") as out:
        for doc in docs:
            out.write((doc if isinstance(doc, str) else json.dumps(doc)) + "\n")
    return path


def test_apps(spark, folder):
    docs = [
        {"apps": {"app": [{"id": "a1", "startedTime": 5, "unmanagedApplication": True, "extra": 1}, {"id": "a2"}]}},
        {"apps": None},
        {"apps": {"app": None}},
        {},
        {"apps": {"app": []}},
    ]
    df = snapshots.read_apps(spark, land(folder, "apps", docs))
    assert sorted((r.id, r.startedTime, r.unmanagedApplication) for r in df.collect()) == [("a1", 5, True), ("a2", None, None)]
    assert len(df.columns) == 35


def test_narrow_readers(spark, folder):
    apps = land(folder, "apps", [{"apps": {"app": [{"id": "a1", "user": "u", "queue": "q", "diagnostics": "long"}]}}])
    narrow = snapshots.read_apps(spark, apps, fields=["user", "id"])
    assert narrow.columns == ["user", "id"] and [tuple(r) for r in narrow.collect()] == [("u", "a1")]
    text = snapshots.apps_from_text(spark.read.text(apps), fields=["id", "allocatedMB"])
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert "diagnostics" not in plan and [tuple(r) for r in text.collect()] == [("a1", None)]
    metrics = land(folder, "m", [{"clusterMetrics": {"totalMB": 5, "lostNodes": 1}}, {}])
    assert sorted(tuple(r) for r in snapshots.read_metrics(spark, metrics, fields=["lostNodes"]).collect()) == [(0,), (1,)]
    listing = land(folder, "l", [{"dir": "/a", "FileStatuses": {"FileStatus": [{"pathSuffix": "x", "group": "g"}]}}])
    assert [tuple(r) for r in snapshots.read_listing(spark, listing, fields=["group"]).collect()] == [("/a", "g")]
    with pytest.raises(ValueError, match="nope"):
        snapshots.read_apps(spark, apps, fields=["nope"])


def test_metrics(spark, folder):
    path = land(folder, "m", [{"clusterMetrics": {"totalMB": 5}}, {}])
    rows = snapshots.read_metrics(spark, path).orderBy("totalMB").collect()
    assert [r.totalMB for r in rows] == [0, 5] and rows[0].appsRunning == 0 and len(rows[0]) == 26


def test_listing(spark, folder):
    docs = [{"dir": "/a", "FileStatuses": {"FileStatus": [{"pathSuffix": "x", "type": "FILE", "length": 3}]}}, {"dir": "/b"}]
    rows = snapshots.read_listing(spark, land(folder, "l", docs)).collect()
    assert [(r.dir, r.pathSuffix, r.length) for r in rows] == [("/a", "x", 3)]


def test_storage(spark, folder):
    nodes = {"h1": {"capacity": 10, "usedSpace": 4}, "h2": {"capacity": 0, "usedSpace": 9}, "h3": {"capacity": 5, "adminState": "Gone"}}
    names = {"fs": "x:name=FSNamesystem", "info": "x:name=NameNodeInfo"}
    docs = [
        {"beans": [{"name": names["fs"], "CapacityTotal": 7}, {"name": names["info"], "LiveNodes": json.dumps(nodes)}]},
        {"beans": [{"name": names["info"], "LiveNodes": nodes}, {"name": "FSNamesystemState", "CapacityTotal": 9}]},
        {"beans": [{"name": names["fs"], "CapacityTotal": 3}, {"name": names["info"], "LiveNodes": "{broken"}]},
        {},
    ]
    cluster, found = snapshots.read_storage(spark, land(folder, "s", docs))
    assert sorted(r.CapacityTotal for r in cluster.collect()) == [0, 0, 3, 7]
    got = sorted((r.host, r.capacity, r.usedSpace, r.remaining, r.adminState or "") for r in found.collect())
    assert got == [("h1", 10, 4, 0, "")] * 2 + [("h3", 5, 0, 0, "Gone")] * 2


CAPACITY = {
    "type": "capacityScheduler", "queueName": "root", "absoluteCapacity": 100.0,
    "queues": {"queue": [{"queueName": "b", "resourcesUsed": {"memory": 3}, "numActiveApplications": 2}, {"queueName": "a"}]},
}
FAIR = {
    "type": "FairScheduler",
    "rootQueue": {
        "queueName": "root",
        "childQueues": {"queue": [{"queueName": "f", "usedResources": {"memory": 8}, "resourcesUsed": {"memory": 1}, "fairResources": {"vCores": 2}, "fairShare": {"memory": 5}, "maxResources": {"memory": 64}}]},
    },
}


def chain(levels):
    node = {"queueName": f"q{levels - 1}"}
    for i in range(levels - 2, -1, -1):
        node = {"queueName": f"q{i}", "queues": {"queue": [node]}}
    return {**node, "type": "capacity"}


def queue_rows(spark, folder, infos, **more):
    path = land(folder, "q", [{"scheduler": {"schedulerInfo": i}} for i in infos])
    return scheduler.read_scheduler(spark, path, **more)


def test_scheduler_dialects(spark, folder):
    infos = [CAPACITY, FAIR, {"type": "fifoScheduler", "queueName": "root"}, {"type": "capacity", "queues": {"queue": [{"queueName": "lost"}]}}]
    rows = {(r.scheduler, r.path): r for r in queue_rows(spark, folder, infos).collect()}
    assert set(rows) == {("capacity", "root"), ("capacity", "root.a"), ("capacity", "root.b"), ("fair", "root"), ("fair", "root.f"), ("unknown", "root")}
    b = rows["capacity", "root.b"]
    assert (b.parent, b.depth, b.memory, b.numActiveApps, b.numPendingApps, b.quotaMemory, b.fairMemory) == ("root", 1, 3, 2, None, 0, None)
    f = rows["fair", "root.f"]
    assert (f.memory, f.quotaMemory, f.fairMemory, f.fairVCores) == (8, 64, None, 2)


def test_leaves(spark, folder):
    from fleetlens.operators.queues import leaf_queues

    nameless = {"type": "capacity", "queues": {"queue": [{"queueName": "z"}, {"queueName": ""}, {"queueName": "Y", "queues": {"queue": []}}]}}
    docs = [{"scheduler": {"schedulerInfo": i}} for i in (CAPACITY, FAIR, nameless, {"type": "capacity"})]
    text = spark.read.text(land(folder, "leaves", docs))
    assert [r.queueName for r in scheduler.leaf_names(text).collect()] == ["a", "b", "f", "Y", "z"]
    flat = scheduler.unroll_queues(text, keep=["value"])
    assert sorted(r.queueName for r in leaf_queues(flat, ["value"]).collect()) == ["a", "b", "f"]


def test_scheduler_broken_and_missing_documents(spark, folder):
    path = land(folder, "q", ["{broken", {}, {"scheduler": None}])
    assert scheduler.read_scheduler(spark, path).collect() == []


@pytest.mark.parametrize("levels", [1, 6, 7, 30, 200])
def test_scheduler_of_any_depth(spark, folder, levels):
    rows = queue_rows(spark, folder, [chain(levels), chain(2)]).collect()
    assert len(rows) == levels + 2 and max(r.depth for r in rows) == max(levels, 2) - 1


def test_scheduler_parses_once(spark, folder):
    rows = queue_rows(spark, folder, [chain(9), {"type": "capacity", "queueName": "root", "queues": {"queue": "[[["}}, None])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson(") == 1 and "Exchange" not in plan
    assert sorted(r.depth for r in rows.collect()) == [0, *range(9)]


def test_scheduler_refuses_to_cut_a_tree(spark, folder):
    with pytest.raises(Exception, match="deeper than 3"):
        queue_rows(spark, folder, [chain(4)], depth=3).collect()
    assert queue_rows(spark, folder, [chain(3)], depth=3).count() == 3


def project_pages(spark, rows):
    kind = "listing int, page_no int, code int, msg string, data struct<totalList: array<struct<id: bigint, name: string>>, total: bigint>"
    made = [(li, no, code, msg, ([(i, f"p{i}") for i in ids] if ids is not None else None, total)) for li, no, code, msg, ids, total in rows]
    return spark.createDataFrame(made, kind)


def test_pages(spark):
    rows = [
        (1, 1, 0, "", [1, 2], 5), (1, 2, 0, "", [3, 4], 5), (1, 3, 0, "", [5], 5), (1, 4, 0, "", [6], 5),  # complete after 3
        (2, 1, 0, "", [1], 9), (2, 2, 0, "", [], 9), (2, 3, 0, "", [7], 9),  # empty page ends it
        (3, 1, 0, "", [1], 9), (3, 2, 10113, "no", None, None), (3, 3, 0, "", [2], 9),  # failed
        (4, 1, 0, "", [1, 2], 2), (4, 2, 7, None, None, None),  # the failing page is never asked for
        (5, 1, 0, "", [1], None), (5, 2, 0, "", [2], None),  # no total: one page
        (6, 1, 1, "", None, None),  # fails with no message
    ]
    df = project_pages(spark, rows)
    for most in (10, None):
        got = sorted((r.listing, r.id) for r in pages.union_pages(df, ["listing"], most).collect())
        assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 1), (4, 1), (4, 2), (5, 1)]
        errors = sorted(tuple(r) for r in pages.page_errors(df, ["listing"], most).collect())
        assert errors == [(3, 2, 10113, "no"), (6, 1, 1, "查询失败")]


def test_pages_limit(spark):
    df = project_pages(spark, [(1, p, 0, "", [p], 12) for p in range(1, 13)])
    assert pages.union_pages(df, ["listing"]).count() == 12
    assert pages.union_pages(df, ["listing"], max_pages=10).count() == 10


def test_an_answer_comes_before_a_failed_copy(spark):
    good, bad = [(1, p, 0, "", [p], 2) for p in (1, 2)], (1, 1, 10113, "down", [], 0)
    for rows in ([bad, *good], [*good, bad], [good[0], bad, good[1], bad]):
        df = project_pages(spark, rows)
        assert sorted(r.id for r in pages.union_pages(df, ["listing"]).collect()) == [1, 2]
        assert pages.page_errors(df, ["listing"]).count() == 0


def test_pages_landed_twice_or_missing(spark):
    twice = [(1, p, 0, "", [10 * p], 3) for p in (1, 2, 1, 2, 3)]
    gap = [(2, p, 0, "", [p], 3) for p in (1, 3)]
    late = [(3, p, 0, "", [p], 2) for p in (1, 2, 5)]  # a page past the end does not make a gap
    df = project_pages(spark, twice + gap + late)
    got = sorted((r.listing, r.page_no) for r in pages.union_pages(df, ["listing"]).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (3, 1), (3, 2)]
    assert [tuple(r) for r in pages.page_errors(df, ["listing"]).collect()] == [(2, 2, None, "page missing")]
    newer = df.filter("listing = 1").withColumn("at", F.monotonically_increasing_id())
    assert pages.union_pages(newer, ["listing"], seq="at").count() == 3


def test_running_total_over_blocks(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("n"), (F.col("id") % 7).alias("v"))
    got = running_total(df, ["k"], "n", F.col("v"), "total", block=16).collect()
    sums = {0: 0, 1: 0}
    for r in sorted(got, key=lambda r: r.n):
        sums[r.k] += r.v
        assert r.total == sums[r.k]
    assert len(got) == 1000


def test_log_slices(spark):
    text = "\n".join(f"l{i}" for i in range(10))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "a\n"), (4, None)], "taskInstanceId bigint, log string")
    got = sorted((r.taskInstanceId, r.line_no, r.line) for r in logs.log_slice(df, 8, 500).collect())
    assert got == [(1, 8, "l8"), (1, 9, "l9")]
    assert logs.log_slice(df, 0, 3).filter("taskInstanceId = 1").count() == 3
    assert logs.log_lines(df).count() == 10 + 1 + 2
    assert (logs.next_skip(0, True), logs.next_skip(500, False)) == (500, 500)


CONFIG = {
    "allowedDbs": ["b", " a ", "lake", ""],
    "datasources": [
        {"name": "b", "type": "mysql", "host": "h", "password": "secret", "schema": "bb"},
        {"name": "a", "label": "Alpha", "type": "ORACLE", "host": "o", "rowLimit": "rownum", "readOnly": False},
        {"name": "c", "type": "mysql"},
        {"name": "lake", "type": "parquet", "path": "/root/testdata/sf0.001"},
    ],
}


def test_registry(spark):
    registry = Registry.from_config(CONFIG)
    rows = registry.list(spark).collect()
    assert [(r.name, r.display, r.port) for r in rows] == [("a", "Alpha (a)", 1521), ("b", "b", 3306), ("lake", "lake", 0)]
    assert "password" not in registry.list(spark).columns and "secret" not in repr(registry)
    assert [r.name for r in registry.list(spark, "mysql").collect()] == ["b"]
    assert registry.get("b").service == "bb" and registry.get("c").service == "c"
    assert registry.get("a").read_only is False and registry.get("b").read_only is True
    assert registry.open(spark, "lake", "region").count() == 5
    with pytest.raises(UnknownSource):
        registry.get("nope")


def test_settings_that_are_left_out():
    cfg = {"datasources": [{"name": 7, "label": "  ", "schema": "s", "type": " Oracle ", "unknown": 1}], "allowedDbs": [" a ", ""], "queryTimeout": "9"}
    registry = Registry.from_config(cfg)
    source = registry.get("7")
    assert (source.label, source.service, source.port, source.host, source.read_only) == ("7", "s", 1521, "127.0.0.1", True)
    assert (registry.allowed, registry.query_timeout, registry.connect_timeout) == (("a",), 9, 5)


@pytest.mark.parametrize("bad", [{"name": "x", "type": "db2"}, {"name": "x", "rowLimit": "top"}, {}, {"name": "x", "port": "high"}])
def test_registry_refuses(bad):
    with pytest.raises(ValueError):
        Registry.from_config({"datasources": [bad]})
    with pytest.raises(ValueError):
        Registry.from_config({})


def test_jdbc_ranges():
    assert jdbc_ranges("id", []) == ["1 = 1"]
    assert jdbc_ranges("id", [7, 3, 7]) == ["id < 3 OR id IS NULL", "id >= 3 AND id < 7", "id >= 7"]
    assert jdbc_ranges("d", ["2024-01-01", "o'k"])[1:] == ["d >= '2024-01-01' AND d < 'o''k'", "d >= 'o''k'"]


def test_jdbc_ranges_of_skewed_keys(spark):
    keys = spark.range(10_000).selectExpr("CASE WHEN id < 100 THEN NULL WHEN id % 3 = 0 THEN 5 ELSE id * id END AS id")
    bounds = key_bounds(keys, "id", 8)
    ranges = jdbc_ranges("id", bounds)
    sizes = [keys.where(r).count() for r in ranges]
    assert sum(sizes) == 10_000 and 4 <= len(ranges) <= 8 and sorted(sizes)[-2] < 2_000


def test_jdbc_options():
    registry = Registry.from_config(CONFIG)
    mysql = jdbc_options(registry.get("b"), "t", 60, 5, Partitioning("id", "0", "1000", 16))
    assert mysql["url"] == "jdbc:mysql://h:3306/bb?connectTimeout=5000"
    assert (mysql["queryTimeout"], mysql["partitionColumn"], mysql["numPartitions"]) == ("60", "id", "16")
    oracle = jdbc_options(registry.get("a"), "t")
    assert oracle["url"] == "jdbc:oracle:thin:@//o:1521/a" and oracle["oracle.net.CONNECT_TIMEOUT"] == "5000"
    assert "partitionColumn" not in oracle
