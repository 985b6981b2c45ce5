"""Session set-up and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

#: Most bytes of texts that go to Python at once; a task holds some four copies of a batch, half of them in Python.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "1m"


def build_session(master: str | None = None, app: str = "fleetlens", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        BATCH_SETTING: BATCH_BYTES,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python end at ``BATCH_BYTES`` from now on, unless the session says otherwise; rows do not depend on it."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="fleetlens-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the driver's
    own disk is of no use to the executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_dir()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new path, not yet created, inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/fleetlens-{purpose}-{uuid.uuid4().hex}"


def checkpoint(df):
    """Cut the lineage of ``df`` with a copy in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
