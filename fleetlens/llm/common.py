"""What several operators share: working tables, whole texts, sizes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import work_dir

_WRITTEN: dict[str, list[str]] = {}
_OWNER: ContextVar[str] = ContextVar("owner", default="")

#: ASCII white space; the words of most operators are what stands between it. Fixed value.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a written table in the shared folder: computed once, lineage cut, safe when executors are lost."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.setdefault(_OWNER.get(), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Working tables written within belong to ``owner``, who alone removes them."""
    token = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(token)


def release(spark: SparkSession, owner: str = "") -> None:
    """Removes the owner's working tables written so far; call it once the results that read them are written."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    paths = _WRITTEN.pop(owner, [])
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def text_of(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else unchanged."""
    return F.translate(text, UPPER, LOWER)


def words_between(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of separators."""
    return F.filter(F.split(text, separators), lambda w: w != "")


def parts_for(total: int, per_part: int) -> int:
    """How many partitions hold ``total`` things at ``per_part`` each, one at least."""
    return max(1, -(-int(total) // per_part))
