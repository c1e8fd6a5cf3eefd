"""A corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, tokens.

STAGES holds (name, function); each function takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of ``documents``; the last returns doc_id, n_tokens, ids, ids_sha256 and decoded_sha256. A stage's result is written
as Parquet and read again as the next one's docs, so no stage recomputes another and a lost executor costs one stage.

Defined results: rows with a null doc_id pass the stages that work on pairs; a document that a later stage finds wholly
repeated stays, with an empty text; empty tables give empty results; extra columns stay until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import bpe, decontaminate, near_dedup, quality, shared, substring_dedup


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, shared.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates (five-word shingles, 0.8)."""
    gone = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without windows of 50 words that start in a document with a smaller id.

    A changed text is its kept words joined by single spaces; other texts stay as they are. n_chars follows the text.
    """
    rows, kept = substring_dedup.remove_repeats(docs)
    changes = rows.where("changed").select("doc_id", "text_sha").distinct().join(kept, ["doc_id", "text_sha"], "left")
    changes = changes.select(F.col("doc_id").alias("changed_id"), F.col("text_sha").alias("changed_sha"), F.coalesce("kept_text", F.lit("")).alias("new_text"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("changed_id"), F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("changed_sha"))
    joined = packed.join(changes, ["changed_id", "changed_sha"], "left").withColumn("text", F.coalesce("new_text", "row.text"))
    renewed = {"text": F.col("text"), "n_chars": F.when(F.col("new_text").isNotNull(), F.length("text")).otherwise(F.col("row.n_chars")).cast("long") if "n_chars" in docs.columns else None}
    return joined.select(*[renewed[c].alias(c) if c in renewed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    leaks = decontaminate.contaminated(docs, shared.table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with digests of them and of the text decoded from them."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: No stage can be expressed in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = shared.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, read = shared.staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-")), before
        if read is not None:
            shared.remove(spark, read)
        before = docs
    return docs
