"""The operators as queries over whole tables, with plain SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.alignment import align_tokens
from fleetlens.llm.byte_bpe import round_trip
from fleetlens.llm.decontamination import find_contamination
from fleetlens.llm.language_model import score_texts
from fleetlens.llm.merkle import fold, manifest, proof_text
from fleetlens.llm.oracles import ORACLES
from fleetlens.llm.order_minhash import compare_edits, printed
from fleetlens.llm.pii import scan_personal_data
from fleetlens.llm.quality import classify
from fleetlens.llm.secret_scan import scan_secrets
from fleetlens.llm.sharding import shard_rows
from fleetlens.llm.simhash import near_groups
from fleetlens.llm.substrings import remove_repeats
from fleetlens.llm.token_counts import count_tokens
from fleetlens.session import bound_batches

__all__ = ["ORACLES", "QUERIES"]

SHARDS = 24


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_substrings(spark: SparkSession, folder: str) -> DataFrame:
    left = remove_repeats(_table(spark, folder, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(_table(spark, folder, "documents"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    grouped = near_groups(_table(spark, folder, "documents"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(_table(spark, folder, "documents"))
    digest = F.sha2(F.col("base_spans"), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans", "n_live", "n_example")


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = shard_rows(_table(spark, folder, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_personal_data(_table(spark, folder, "documents"))
    digest = F.sha2("base_spans", 256).alias("base_sha256")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", digest, "spans")


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = find_contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    compared = compare_edits(_table(spark, folder, "documents"))
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("signature")).alias("fingerprint"),
        printed(F.col("edited_signature")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def tokenizer() -> tuple[str, str]:
    """Path and pattern of the byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(_table(spark, folder, "documents"), *tokenizer())


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(_table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    documents = _table(spark, folder, "documents")
    aligned = align_tokens(documents, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), digest=True)
    return aligned.withColumn("doc_id", F.col("doc_id").cast("long")).withColumnRenamed("groups", "groups_sha256")


def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tampered = {"n_chars": F.when(chosen, more).otherwise(F.col("n_chars").cast("string"))}
    proven = manifest(_table(spark, folder, "documents"), tampered)
    folded = proven.withColumn("folded_root", fold(F.col("claimed"), F.col("path")))
    proof = F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256")
    return folded.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_substrings": op2_substrings,
    "op3_language_model": op3_language_model,
    "op4_simhash": op4_simhash,
    "op5_secret_scan": op5_secret_scan,
    "op6_sharding": op6_sharding,
    "op7_personal_data": op7_personal_data,
    "op8_decontamination": op8_decontamination,
    "op9_order_minhash": op9_order_minhash,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_token_counts": op11_token_counts,
    "op12_alignment": op12_alignment,
    "op13_manifest": op13_manifest,
}
