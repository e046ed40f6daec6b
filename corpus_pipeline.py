"""Training-corpus pipeline: its stages in order, each over what its predecessor kept.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents.
Nulls in any column, empty texts and tables, repeated rows and further columns with any names pass through; what each stage makes of them is said at its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from runlattice.llm.common import dropped, fresh, stored, table
from runlattice.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; n_chars follows the text. Documents of which nothing is left but were not empty go; null texts, null ids and other columns stay."""
    was = fresh(docs, "was")
    kept = line_dedup.deduplicated(docs.withColumn(was, F.length("text")), text="text")
    words = F.length(F.translate("text", " \t\n\x0b\f\r", ""))
    unchanged = F.col(was).eqNullSafe(F.length("text"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(unchanged, F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return kept.filter(F.col("text").isNull() | unchanged | (words > 0)).drop(was)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, on shingles of five words as stages on word shingles take by default (the query op1 has a contract of four)."""
    return minhash.deduplicated(docs, k=5)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of these and of the decoded text."""
    return bpe.round_trip_digests(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: Learned scores have no SQL; tests hold each stage and the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; between stages the table is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
