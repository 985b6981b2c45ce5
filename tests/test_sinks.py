"""Exports, appends and the audit trail."""

import glob

import pytest
from pyspark.sql import functions as F

from fleetlens.governance.policy import Policy
from fleetlens.sinks import append, audit, csv

ROWS = [
    (1, "plain", 1.0), (2, 'a "b"', 2.5), (3, "a,b", None), (4, "a\nb", 1e10), (5, "a\rb", -0.5), (6, None, 0.0), (7, " pad ", 3.0), (8, "", 1.5),
]
LINES = ["1,plain,1", '2,"a ""b""",2.5', '3,"a,b",', '4,"a\nb",10000000000', '5,"a\rb",-0.5', "6,,0", "7, pad ,3", "8,,1.5"]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, text string, n double")


def read(pattern):
    return "".join(open(f, encoding="utf-8", newline="").read() for f in sorted(glob.glob(pattern)))


def test_lines(rows):
    assert [r[0] for r in rows.select(csv.csv_line(rows)).collect()] == LINES
    assert csv.header_line(["a", 'b"c', "d,e"]) == 'a,"b""c","d,e"'


def test_export_of_a_result(rows, folder):
    csv.export_result(rows, f"{folder}/out")
    assert read(f"{folder}/out/part-*") == "﻿id,text,n\n" + "\n".join(LINES) + "\n"
    with pytest.raises(ValueError, match="export_csv"):
        csv.export_result(rows, f"{folder}/big", most=3)


def test_export_in_parts(rows, folder):
    csv.export_csv(rows.coalesce(1), f"{folder}/out")
    text = read(f"{folder}/out/part-*")
    assert text.startswith("id,text,n\n") and '2,"a ""b""",2.5\n' in text and '4,"a\nb",10000000000\n' in text
    assert "6,,0\n" in text and "7, pad ,3\n" in text and "8,,1.5\n" in text and '5,"a\rb",-0.5' in text


def test_exports_refuse_repeated_names(spark, folder):
    with pytest.raises(ValueError, match="repeat"):
        csv.export_csv(spark.sql("SELECT 1 AS a, 2 AS a"), f"{folder}/x")
    with pytest.raises(ValueError, match="nothing to export"):
        csv.export_result(None, f"{folder}/x")


def test_append(spark, folder):
    policy = Policy(writable_tables=("a.t", "b.*"))
    df = spark.range(10)
    assert append.guarded_append(df, "a.t", folder, policy).first().affected_rows == 10
    assert append.guarded_append(df.limit(3), "a.t", folder, policy).first().affected_rows == 3
    assert spark.read.parquet(f"{folder}/a/t").count() == 13
    assert append.is_target_writable("b.any", policy) and not append.is_target_writable("bb.any", policy)
    with pytest.raises(append.NotWritable):
        append.guarded_append(df, "a.u", folder, policy)


def test_audit(spark, folder):
    df = spark.createDataFrame([("x" * 300,), ("short",)], "s string")
    rows = audit.audit_rows(df, F.lit(5), F.lit("db"), F.lit(1), F.lit(2), F.col("s"))
    audit.append_audit(rows, f"{folder}/audit")
    audit.append_audit(rows, f"{folder}/audit")
    got = spark.read.parquet(f"{folder}/audit")
    assert got.count() == 4 and sorted({len(r.sql) for r in got.collect()}) == [5, 300] and {len(r.preview) for r in got.collect()} == {5, 200}


@pytest.mark.parametrize("target", ["shop.../../../escaped", "shop.", "shop.a.b", "shop./x", "shop..", "shop"])
def test_append_stays_in_its_folder(spark, folder, target):
    with pytest.raises(append.NotWritable):
        append.guarded_append(spark.range(1), target, folder, Policy(writable_tables=("shop.*", target)))


def test_number_text(spark):
    values = [12345678.5, 0.0001, 1e-6, 1.5e-7, 1e20, 1e21, -0.0, -1234567.25, 0.1, 123456789012345680.0]
    texts = ["12345678.5", "0.0001", "0.000001", "1.5e-7", "1" + "0" * 20, "1e+21", "0", "-1234567.25", "0.1", "123456789012345680"]
    df = spark.createDataFrame([(v,) for v in values], "n double")
    assert [r.line for r in df.select(csv.csv_line(df).alias("line")).collect()] == texts
