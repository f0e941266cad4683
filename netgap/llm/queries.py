"""The contract queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, language, near_dedup, oracles, quality_rules, storage, substring_dedup, token_files, toxicity, warc, weak_labels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def vocab_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.fit(docs, labels.filter(fold(5) != 0))
    found = toxicity.score(docs, index)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence_ids")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(spark, table(spark, sf_dir, "documents"), vocab_path())


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(fold(4) != 2))
    found = language.predict(docs, model)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": oracles.OP4, "op8_substring_dedup": oracles.OP8, "op10_quality_rules": oracles.OP10}


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contaminated(docs, benchmark)
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.col("n_items").isNotNull().alias("contaminated"), "item_ids")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "warc")
    warc.write(warc.captures(table(spark, sf_dir, "pages")), path)
    records = storage.written(warc.read(spark, path, payloads=False), "records")
    found = warc.resolved(storage.written(warc.transactions(records), "transactions"))
    return found.select(F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, vocab_path())
    return token_files.read(spark, path, ids=False)


def op9_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, weights = weak_labels.fit(docs)
    found = weak_labels.score(docs, model, weights)
    return found.select("doc_id", "score", "posterior", (F.col("score") >= 0.5).alias("kept"))
