"""The audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens import fixed

AUDIT = "at bigint, db string, `rows` bigint, cost_ms bigint, sql string, preview string"


def audit_rows(df: DataFrame, at: Column, db: Column, rows: Column, cost_ms: Column, sql: Column) -> DataFrame:
    """One audit row per statement, with its whole text and a short preview for lists."""
    return df.select(
        at.cast("bigint").alias("at"),
        db.alias("db"),
        rows.cast("bigint").alias("rows"),
        cost_ms.cast("bigint").alias("cost_ms"),
        sql.alias("sql"),
        F.substring(sql, 1, fixed.AUDIT_SQL_CHARS).alias("preview"),
    )


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


#: Folders an audit trail is spread over by the statements' ids.
SHARDS = 64


def append_once(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose ``key`` the trail does not hold yet, so a run that is repeated adds nothing.

    Ids are looked up in the folders that could hold them, not in the whole trail.
    """
    rows = df.withColumn("shard", F.pmod(F.crc32(F.col(key).cast("binary")), F.lit(SHARDS)).cast("int"))
    shards = [r.shard for r in rows.select("shard").distinct().collect()]
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        held = spark.read.schema(rows.schema).parquet(path).where(F.col("shard").isin(shards)).select(key)
        rows = rows.join(held, key, "left_anti").select(*rows.columns)
    rows.write.mode("append").partitionBy("shard").parquet(path)
