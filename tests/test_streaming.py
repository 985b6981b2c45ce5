"""Streams must come to the batch answer."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.latest import latest_by
from fleetlens.streaming.latest import compact, read_latest, stream_latest

SCHEMA = "k string, seq bigint, v bigint"


def rows(spark, low, high):
    return spark.range(low, high).select(
        F.concat(F.lit("k"), F.col("id") % 5).alias("k"), (F.col("id") * 37 % 101).alias("seq"), F.col("id").alias("v")
    )


def answer(df):
    return sorted(tuple(r) for r in df.collect())


def start(spark, folder, sink):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landing")
    return stream_latest(stream, ["k"], "seq", f"{folder}/{sink}", f"{folder}/progress", every_seconds=None)


def test_stream_equals_batch(spark, folder):
    for low in (0, 100, 200):
        rows(spark, low, low + 100).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
    start(spark, folder, "sink").awaitTermination()
    want = answer(latest_by(rows(spark, 0, 300), ["k"], "seq"))
    assert answer(read_latest(spark, f"{folder}/sink", ["k"], "seq")) == want

    # a batch written twice, as after a crash, changes nothing
    batch = spark.read.parquet(f"{folder}/sink/batch=0").collect()
    spark.createDataFrame(batch, SCHEMA).write.mode("overwrite").parquet(f"{folder}/sink/batch=0")
    assert answer(read_latest(spark, f"{folder}/sink", ["k"], "seq")) == want

    # compacted, and continued in the new place
    compact(spark, f"{folder}/sink", f"{folder}/folded", ["k"], "seq")
    rows(spark, 300, 350).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
    start(spark, folder, "folded").awaitTermination()
    want = answer(latest_by(rows(spark, 0, 350), ["k"], "seq"))
    assert answer(read_latest(spark, f"{folder}/folded", ["k"], "seq")) == want


def test_refresh_is_one_of_the_offered(spark, folder):
    rows(spark, 0, 1).write.parquet(f"{folder}/landing")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/landing")
    with pytest.raises(ValueError):
        stream_latest(stream, ["k"], "seq", f"{folder}/s", f"{folder}/p", every_seconds=7)
    query = stream_latest(stream, ["k"], "seq", f"{folder}/s", f"{folder}/p", every_seconds=10)
    assert query.isActive
    query.stop()


def test_landed_application_files_as_a_stream(spark, folder):
    """The newest landed answer about an application wins, whatever order the files are read in."""
    import json
    import os

    from fleetlens.sources.snapshots import read_apps

    os.makedirs(f"{folder}/landing")
    states = {"a.json": ("KILLED", 3000), "b.json": ("RUNNING", 2000), "c.json": ("ACCEPTED", 1000)}
    for name, (state, landed) in states.items():
        path = f"{folder}/landing/{name}"
        with open(path, "w") as out:
            json.dump({"apps": {"app": [{"id": "a1", "state": state}, {"id": f"only-{name}", "state": state}]}}, out)
        os.utime(path, (landed, landed))
    apps = read_apps(spark, f"{folder}/landing", stream=True, stamped=True).select("id", "landed", "state")
    stream_latest(apps, ["id"], "landed", f"{folder}/sink", f"{folder}/progress", every_seconds=None).awaitTermination()
    got = {r.id: r.state for r in read_latest(spark, f"{folder}/sink", ["id"], "landed").collect()}
    assert got == {"a1": "KILLED", "only-a.json": "KILLED", "only-b.json": "RUNNING", "only-c.json": "ACCEPTED"}
