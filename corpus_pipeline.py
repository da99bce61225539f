"""documents -> training corpus: quality rules, near copies, repeated passages, benchmark passages, source mix.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and returns a DataFrame with the
columns of documents; the last adds `copies`, how often the mix takes the document. run() writes each result but the
last to the shared folder and reads it again, so a lost executor costs a stage's tasks and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix.llm import common, decontaminate, jaccard, mixing, rules, suffixes
from quorix.session import ship

#: The stages cannot be written in SQL as a whole; tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie outside their group's fences go."""
    return rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by shingles, directly or over others, the one with the smallest id stays."""
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier go; documents without a word left go too."""
    count = common.fresh("_removed", docs.columns)
    cut = suffixes.remove_repeats(docs, count)
    emptied = (F.col(count) > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(common.WORD_PATTERN)
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else common.named(c) for c in docs.columns]
    return cut.where(~emptied).select(*columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with an item of the benchmark go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shortest=decontaminate.SHORTEST)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
