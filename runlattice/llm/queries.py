"""The queries of the ten operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runlattice.llm import bpe, decontaminate, html_extract, line_dedup, minhash, pii, quality, suffix_dedup, token_output, toxicity
from runlattice.llm.common import table

#: The key of the registered query, so its results can be repeated; a deployment passes its own secret.
KEY = b"runlattice-test-key"
Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"), key=KEY)


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.written_index(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"), with_bytes=False)


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.report(table(spark, sf_dir, "pages"))


def op6_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(quality.ledger(table(spark, sf_dir, "documents")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_pii_pseudonyms, op3_token_orc, op4_suffix_dedup, op5_html_main_text, op6_quality_ledger, op7_decontaminate, op8_line_dedup, op9_bpe_round_trip, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_ledger": quality.ORACLE, "op7_decontaminate": decontaminate.ORACLE}
