"""Edges of every column function."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fleetlens import functions as L

AS_OF = datetime(2024, 1, 2, tzinfo=timezone.utc)
NOW = 1704153600000


def one(spark, value, kind, make):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(make(F.col("v"))).first()[0]


def all_of(spark, cases, kind, make):
    """Every case in one job: maps the inputs to what came out."""
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], f"i int, v {kind}")
    got = dict(df.select("i", make(F.col("v"))).collect())
    assert [(v, got[i]) for i, (v, _) in enumerate(cases)] == [(v, w) for v, w in cases]


def test_timestamp(spark):
    cases = [
        (None, "n/a"),
        (0, "n/a"),
        (NOW - 59_999, "2024-01-01 23:59:00 (刚刚)"),
        (NOW - 60_000, "2024-01-01 23:59:00 (1 分钟前)"),
        (NOW - 3_599_999, "2024-01-01 23:00:00 (59 分钟前)"),
        (NOW - 3_600_000, "2024-01-01 23:00:00 (1 小时前)"),
        (NOW - 86_399_999, "2024-01-01 00:00:00 (23 小时前)"),
        (NOW - 86_400_000, "2024-01-01 00:00:00 (1 天前)"),
        (NOW + 5_000, "2024-01-02 00:00:05 (刚刚)"),
        (-(1 << 63), "Invalid Date"),
        ((1 << 63) - 1, "Invalid Date"),
    ]
    all_of(spark, cases, "bigint", lambda c: L.format_timestamp(c, AS_OF))
    all_of(spark, [(0, "n/a"), (12, "12")], "bigint", lambda c: L.format_timestamp(c, AS_OF, humanize=False))


def test_timestamp_does_not_follow_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
        assert one(spark, NOW, "bigint", lambda c: L.utc_text(c)) == "2024-01-02 00:00:00"
        assert one(spark, datetime(2024, 1, 2), "timestamp_ntz", L.epoch_millis) == NOW
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_elapsed(spark):
    cases = [
        (None, "n/a"),
        (0, "n/a"),
        (1, "0秒"),
        (999, "0秒"),
        (1_000, "1秒"),
        (59_999, "59秒"),
        (60_000, "1分"),
        (61_000, "1分1秒"),
        (3_600_000, "1小时"),
        (86_400_000, "1天"),
        (90_061_000, "1天1小时1分1秒"),
        (86_401_000, "1天1秒"),
    ]
    all_of(spark, cases, "bigint", L.format_elapsed)
    all_of(spark, [(None, "n/a"), (61_000, "61000")], "bigint", lambda c: L.format_elapsed(c, humanize=False))


def test_duration(spark):
    cases = [
        (None, "—"), (-1, "—"), (0, "—"), (1, "1s"), (59, "59s"), (60, "1m 0s"), (3_599, "59m 59s"), (3_600, "1h 0m"),
        (3_661, "1h 1m"), (90_000, "25h 0m"),
    ]
    all_of(spark, cases, "bigint", L.format_duration)


def test_memory(spark):
    cases = [
        (None, "n/a"), (-1.0, "n/a"), (float("nan"), "n/a"), (float("inf"), "n/a"), (0.0, "0 MB"), (0.5, "1 MB"),
        (1023.0, "1023 MB"), (1023.4, "1023 MB"), (1024.0, "1.0 GB"), (1536.0, "1.5 GB"), (1280.0, "1.3 GB"),
        (1024.0**2, "1.0 TB"), (1024.0**3, "1.0 PB"), (1024.0**4, "1024.0 PB"), (1048575.0, "1024.0 GB"),
    ]
    all_of(spark, cases, "double", L.format_mem)
    all_of(spark, [(2048.0, "2048 MB"), (-1.0, "n/a")], "double", lambda c: L.format_mem(c, humanize=False))


def test_bytes(spark):
    cases = [
        (None, "0 B"), (-5, "0 B"), (0, "0 B"), (1, "1 B"), (1023, "1023 B"), (1024, "1 KB"), (1535, "1 KB"), (1536, "2 KB"),
        (1048575, "1024 KB"), (1048576, "1.0 MB"), (1310720, "1.3 MB"), (1024**3, "1.0 GB"), (1024**4, "1.0 TB"),
        (1024**5, "1.0 PB"), (1024**6, "1024.0 PB"),
    ]
    all_of(spark, cases, "bigint", L.format_bytes)
    df = spark.createDataFrame([("DIRECTORY", 0), ("FILE", 0), ("FILE", 10)], "t string, n bigint")
    assert [r[0] for r in df.select(L.entry_size(F.col("t"), F.col("n"))).collect()] == ["—", "0 B", "10 B"]


def test_utilisation_and_severity(spark):
    rows = [(1, 0), (0, 10), (1, 200), (3, 200), (849, 1000), (84, 100), (85, 100), (59, 100), (60, 100), (30, 10), (None, 5)]
    df = spark.createDataFrame(rows, "u bigint, t bigint")
    pct = L.utilisation(F.col("u"), F.col("t"))
    got = [tuple(r) for r in df.select(pct, L.severity(pct), L.severity_colour(pct)).collect()]
    assert [g[0] for g in got][:-1] == [0, 0, 1, 2, 85, 84, 85, 59, 60, 100]
    assert [g[1] for g in got][4:9] == ["high", "medium", "high", "normal", "medium"]
    assert got[6][2] == "#f56c6c" and got[7][2] == "#5e6ad2" and got[8][2] == "#e6a23c"


def test_rounding_is_half_up(spark):
    cases = [(0.5, 1), (-0.5, 0), (1.5, 2), (2.5, 3), (-1.5, -1), (0.49999999999999994, 0), (7.2, 7)]
    all_of(spark, cases, "double", L.round_half_up)


def test_queue_quota(spark):
    rows = [
        ("fair", 10, 20, 50.0, 10.0),
        ("fair", 0, 20, 50.0, 20.0),
        ("fair", 0, 0, 50.0, 1000.0),
        ("fair", 0, None, 50.0, 1000.0),
        ("capacity", 10, 20, 50.0, 500.0),
        ("capacity", 10, 20, 0.0, 1000.0),
        ("unknown", 10, 20, 12.5, 125.0),
    ]
    df = spark.createDataFrame(rows, "s string, h bigint, f bigint, p double, want double")
    quota = L.queue_quota(F.col("s"), F.col("h"), F.col("f"), F.col("p"), F.lit(1000))
    assert all(r[0] == r[1] for r in df.select(quota, "want").collect())


def test_states(spark):
    cases = [("RUNNING", "running"), ("FINISHED", "success"), ("FAILED", "failure"), ("KILLED", "stopped"), ("NEW", "neutral"), (None, "neutral")]
    all_of(spark, cases, "string", L.app_state_class)
    all_of(spark, [("failure", "danger"), ("paused", "warning"), ("other", "info")], "string", L.badge_type)
    labels = [("RUNNING_EXEUTION", "运行中"), ("RUNNING_EXECUTION", "运行中"), ("KILL", "已终止"), ("TIMEOUT", "超时"), ("X", "X"), (None, None)]
    all_of(spark, labels, "string", L.workflow_state_label)
    all_of(spark, [("FAILURE", "danger"), ("TIMEOUT", "info"), ("X", "info")], "string", L.workflow_state_tag)
    running = [("RUNNING_EXEUTION", True), ("RUNNING_EXECUTION", False), ("SERIAL_WAIT", True), ("DELAY_EXECUTION", True), ("SUCCESS", False), (None, False)]
    all_of(spark, running, "string", L.is_running)
    all_of(spark, [("SUBMITTED_SUCCESS", "PAUSE/STOP"), ("STOP", "REPEAT_RUNNING")], "string", L.allowed_action)
    all_of(spark, [(None, "In Service"), ("Decommissioned", "Decommissioned")], "string", L.node_state)
    all_of(spark, [(None, "success"), ("In Service", "success"), ("Dead", "warning")], "string", L.node_state_class)


def test_retry(spark):
    df = spark.createDataFrame([(None, 3), (0, 3), (2, None)], "n int, m int")
    assert [r[0] for r in df.select(L.retry_text(F.col("n"), F.col("m"))).collect()] == ["—", "0/3", "2/-"]


@pytest.mark.parametrize(
    "cwd, typed, want",
    [
        ("/a", "/x/y", "/x/y"),
        ("/a", "x", "/a/x"),
        ("/", "x", "/x"),
        ("/a", "  x//y/ ", "/a/x/y"),
        ("/a", "///", "/"),
        ("/a", " ", "/a"),
        ("/a", "../b", "/a/../b"),
        ("/a", "　/b﻿", "/b"),
    ],
)
def test_resolve_path(spark, cwd, typed, want):
    df = spark.createDataFrame([(cwd, typed)], "c string, t string")
    assert df.select(L.resolve_path(F.col("c"), F.col("t"))).first()[0] == want


def test_path_parts(spark):
    df = spark.createDataFrame([("/",), ("/a",), ("/a/b c/d",)], "p string")
    got = [r[0].asDict() for r in df.select(L.path_parts(F.col("p"))).collect()]
    assert got[0] == {"segments": [], "depth": 0, "parent": None, "ancestors": []}
    assert got[1] == {"segments": ["a"], "depth": 1, "parent": "/", "ancestors": ["/a"]}
    assert got[2]["parent"] == "/a/b c" and got[2]["ancestors"] == ["/a", "/a/b c", "/a/b c/d"]


def test_app_id(spark):
    cases = [("x application_12_0034 application_1_1", "application_12_0034"), ("application_12", None), ("", None), (None, None)]
    all_of(spark, cases, "string", L.app_id)


def test_remote_error(spark):
    cases = [
        ('{"RemoteException": {"exception": "AccessDenied", "message": "no"}}', "AccessDenied: no"),
        ('{"RemoteException": {"exception": "RemoteException", "message": "no"}}', "no"),
        ('{"RemoteException": {"message": "no"}}', "no"),
        ('{"RemoteException": {"exception": "X", "message": ""}}', "HTTP 404 Not Found"),
        ('{"other": 1}', "HTTP 404 Not Found"),
        ("<html><PRE>\n first\nline </PRE><pre>second</pre>", "first\nline"),
        ("<pre></pre>", ""),
        ('{"broken": <pre>x</pre>', "x"),
        ("plain", "HTTP 404 Not Found"),
        ("", "HTTP 404 Not Found"),
    ]
    all_of(spark, cases, "string", lambda c: L.remote_error(c, F.lit(404), F.lit("Not Found")))


def test_is_numeric(spark):
    yes = ["1", "-1.5", "+.5", "5.", "1e3", "1E-3", "0x1f", "0B101", "0o17", "Infinity", "-Infinity", " 12 ", "  ", "\n", "　 7"]
    no = ["", "abc", "1d", "NaN", "0x", "-0x1f", "1e", ".", "1_000", "1 2", "inf", "1,5", "0b2", None]
    all_of(spark, [(t, True) for t in yes] + [(t, False) for t in no], "string", L.is_numeric)
