"""A corpus from raw documents to token counts: five operators, one after the other, each over all that the last one kept."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.byte_bpe import round_trip
from fleetlens.llm.common import owned, release
from fleetlens.llm.decontamination import find_contamination
from fleetlens.llm.quality import keep_good
from fleetlens.llm.queries import tokenizer
from fleetlens.llm.secret_scan import redact_live
from fleetlens.llm.simhash import near_groups
from fleetlens.session import bound_batches, work_dir


def _owner() -> str:
    """Whose working tables a stage writes and the next one removes: this thread's."""
    return f"pipeline-{threading.get_ident()}"


def _unused(name: str, docs: DataFrame) -> str:
    while name in docs.columns:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the weak-label classifier rejects as junk or toxic.

    Each row is judged by its own text; repeated rows stay or go together. An empty table gives an empty one.
    """
    bound_batches(spark)
    with owned(_owner()):
        return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the row of the smallest doc_id, null last.

    Rows are told apart by id and text, so rows of one id, or of none, that differ in text are documents of their own; of
    rows alike in both, one stays. Null and empty texts are copies of each other. An empty table gives an empty one.
    """
    release(spark, _owner())
    bound_batches(spark)
    key = _unused("_near_key", docs)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    with owned(_owner()):
        found = near_groups(keyed.select(key, "text"), id_col=key).select(F.col("doc_id").alias("key"), "component_id").distinct()
        rows = keyed.select("doc_id", F.col(key).alias("key")).distinct().join(found, "key")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
        kept = rows.groupBy("component_id").agg(first).select(F.col("first.doc_id").alias("id"), F.col("first.key").alias("key"))
        staying = keyed.join(kept, (keyed[key] == kept["key"]) & keyed["doc_id"].eqNullSafe(kept["id"]), "left_semi")
        return staying.dropDuplicates(["doc_id", key]).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    Rows are judged by their own text, whatever their id; repeated rows stay or go together. Null and empty texts stay. An
    empty table gives an empty one.
    """
    release(spark, _owner())
    key = _unused("_row_key", docs)
    keyed = docs.withColumn(key, F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("other"), "text").alias("b")))
    with owned(_owner()):
        found = find_contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
        hit = found.where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct()
        return keyed.join(hit, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces credentials that look live; the documents stay, null and empty texts and repeated rows as they are."""
    release(spark, _owner())
    with owned(_owner()):
        return redact_live(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids, and returns digests of both; null and empty texts have no tokens."""
    release(spark, _owner())
    bound_batches(spark)
    with owned(_owner()):
        return round_trip(docs, *tokenizer())


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Fingerprints, components and learned weights are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole table of documents; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spark.read.parquet(_written(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)


def _written(df: DataFrame, name: str) -> str:
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return path
