"""One query per operator over the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import suffix_dedup as op

    return op.digest(op.suffix_dedup(_table(spark, sf_dir, "documents"), min_bytes=50))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import decontaminate as op

    found = op.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import line_dedup as op

    return op.digest(op.line_dedup(_table(spark, sf_dir, "documents")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import substring_dedup as op

    return op.digest(op.substring_dedup(_table(spark, sf_dir, "documents"), min_words=50))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import secrets as op

    # a source is an owner, its texts of one language are a repository
    return op.digest(op.secrets(_table(spark, sf_dir, "documents"), repository=F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))), owner="source"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import quality as op

    return op.digest(op.apply_policy(op.ledger(_table(spark, sf_dir, "documents"))))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects, alone and together with others: sums over the ledger's bits."""
    from quillspark.llm import quality as op

    return op.ablation(op.ledger(_table(spark, sf_dir, "documents")), op.POLICIES["v1"])


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from quillspark.llm import packing as op

    return op.digest(op.pack_documents(_table(spark, sf_dir, "documents"), path("word_bpe_49k.json"), length=4096))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import html_extract as op

    return op.digest(op.extract(_table(spark, sf_dir, "pages")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import simhash_dedup as op

    return op.digest(op.simhash_groups(_table(spark, sf_dir, "documents"), shingle=4, radius=4))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import pii as op

    return op.digest(op.pii(_table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name in ("pipeline", "quality_ablation") or (name.startswith("op") and callable(f))}


def oracle_sql() -> dict[str, str]:
    from quillspark.llm.oracles import SQL

    return dict(SQL)
