"""The registered queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import decontam, langid, line_dedup, packing, pii, quality_rules, secret_scan, simhash, token_count, toxicity
from frameloom.llm.common import id_remainder, table
from frameloom.llm.oracles import ORACLES


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predictions(docs, langid.fit_by_id(docs), ["doc_id"])
    return found.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), text="drop")
    found = found.select("doc_id", "n_words", decontam.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity_by_id(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_votes")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: its number of lines and the numbers of those that go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = line_dedup.removals(docs).toDF("id", "key", "gone")
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    found = own.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    return found.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join("gone", ",").alias("removed_lines"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitised(pii.personal_data(table(spark, sf_dir, "documents"), with_text=False))
    clean = F.when(F.size("spans") > 0, F.sha2("clean_text", 256)).otherwise(F.col("text_sha256"))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), clean.alias("clean_sha256"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    spans, base = F.col("spans"), F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    counts = [pii.count_of(spans, kind).alias(f"n_{kind}") for kind in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(spans).alias("spans"), F.array_join(F.transform(spans, lambda s: s["form"]), ",").alias("forms"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces_of(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packing.pack(pieces.drop("ids"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_benchmark_decontamination, op3_quality_rules, op4_toxicity, op5_line_dedup, op6_secret_scan, op7_simhash_near_dedup, op8_best_fit_packing, op9_personal_data, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    """SQL can't express the others' methods (models, hashes of another library, tokenizers): tests compare them with plain Python."""
    return dict(ORACLES)
