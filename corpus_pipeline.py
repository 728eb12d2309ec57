"""A corpus pipeline over `documents`: each stage works on all that the one before it kept.

Stages: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, packing.  All but the last
return the columns of `documents`; the last returns one row per packed piece with its ids.

Defined results: a null or empty text fails the quality rules; a row with a null id takes part in the rules,
decontamination and packing, but never in a comparison with other rows; rows that repeat both id and text are
one document to the comparisons, and stay or go together; columns beside `doc_id` and `text` are handed on,
`n_chars` follows the text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, line_dedup, packing, quality, simhash_dedup
from quillspark.llm._common import stage

#: SQL has no tokeniser and no patience diff; the tests hold `run` against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of policy v1 go."""
    return quality.keep(docs, quality.POLICIES["v1"])


def line_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks of lines go from the later document; `n_chars` follows the text.

    A document left with fewer words than the quality rules ask for (a copy of earlier ones but for a stub) goes.
    """
    # the other columns travel as one, whatever their names
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(None).alias("none")]
    cleaned = line_dedup.line_dedup(docs.select("doc_id", "text", F.struct(*rest).alias("rest")))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    cleaned = cleaned.where((F.col("_qs_removed") == 0) | (words >= quality.MIN_WORDS))

    def column(c: str):
        if c in ("doc_id", "text"):
            return F.col(c)
        held = F.col("rest").getField(c)
        return F.when(F.col("_qs_removed") > 0, F.length("text").cast("long")).otherwise(held).alias(c) if c == "n_chars" else held.alias(c)

    return cleaned.select(*map(column, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; groups are components of five-word similarity."""
    return simhash_dedup.drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 ids."""
    from public_tokenizers import path

    pieces = packing.pack_documents(docs, path("word_bpe_49k.json"))
    return pieces.select("*", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_blocks),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
