"""Corpus pipeline: language, near copies, repeated passages, benchmark leaks, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Rows with a null doc_id pass the language stage on their text and are kept by the later ones as they are.  Extra columns of
any name travel with their row; rows that repeat an id are kept or dropped together; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netgap.llm import bpe, decontaminate, language, near_dedup, queries, storage, substring_dedup


def bounded(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by bytes: the default of 10,000 rows holds 64 MB of text several times over
    beside the heap.  Set for the session, as the caller writes what a stage returns."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language; ``lang`` becomes the predicted one."""
    bounded(spark)
    found = language.identified(docs, language.fit(docs)).filter("not found.rejected")
    return found.select(*[F.col("found.lang_pred").alias("lang") if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class."""
    bounded(spark)
    found = near_dedup.classes(docs)
    gone = found.filter("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages; documents of which nothing is left go.  Texts that lose nothing stay as they are."""
    bounded(spark)
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = substring_dedup.remove_repeats(whole, carry=["row"])
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(cut, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    out = found.filter(~cut | (F.length("kept") > 0))
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    bounded(spark)
    found = decontaminate.contaminated(docs, queries.table(spark, sf_dir, "benchmark")).select("doc_id")
    return docs.join(found, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of their decoding."""
    bounded(spark)
    return bpe.encode_digests(spark, docs, queries.vocab_path())


STAGES = [
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE", token_ids),
]
#: SQL can express neither the classifier nor alignment; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = storage.written(docs, "stage")
    return docs
