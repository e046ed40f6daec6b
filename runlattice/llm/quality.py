"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps its measurements and one bit per failed rule. Versioned policies
are masks over these bits, applied without touching a text again, and ablations are bitwise aggregations of the ledger. All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
#: Java's and DuckDB's pattern of the same characters.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger: the rule's name and, over the measurements, the SQL condition under which a document fails it."""

    bit: int
    name: str
    fails: str


#: Bits are never given to another rule; a changed threshold is a new rule.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule(5, "capitals", "100 * n_capitals > 30 * word_chars"),
    Rule(6, "exclamations", "10 * n_exclamations > n_words"),
)
BASE_MASK = 0b11
#: Rejecting bits of each policy version.
POLICIES = {1: 0b0000111, 2: 0b0101111, 3: 0b1111111}
CURRENT = 3


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_exclamations.

    A null text counts as empty: every measurement is 0. Arrays stay within a row; nothing is shuffled. Repeated windows are sought by 64-bit hashes,
    sorted only where distinct hashes are fewer than windows.
    """
    t = F.col("t")
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    trimmed = F.btrim(t, F.lit(BLANKS))
    base = base.select(
        "doc_id",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK)).alias("w"),
        F.length(F.translate(t, BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"),
        (F.length(t) - F.length(F.translate(t, "!", ""))).cast("bigint").alias("n_exclamations"),
    )
    w = F.col("w")
    n = F.size("w")
    hashes = F.transform(F.slice(w, 1, n - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))
    base = base.select("doc_id", n.cast("bigint").alias("n_words"), "word_chars", "n_symbols", F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), "n_capitals", "n_exclamations", F.when(n >= WINDOW, hashes).alias("h"))
    h = F.col("h")
    sorted_pairs = F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    base = base.withColumn("s", sorted_pairs)
    s = F.col("s")
    twice = F.filter(s, lambda e, i: (F.get(s, i - 1)["x"] == e["x"]) | (F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False))))
    places = F.array_sort(F.transform(twice, lambda e: e["i"]))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("bigint").alias("n"), p.alias("last")), lambda a: a["n"])
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(F.when(s.isNotNull(), covered), F.lit(0)).cast("bigint").alias("n_repeat_words"), "n_lines", "n_capitals", "n_exclamations")


def failed_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = F.lit(0).cast("bigint")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The measurements of each document and ``failed``, its bits."""
    return measured(docs, doc_id, text).withColumn("failed", failed_bits())


def judged(ledger_rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """A ledger with the verdict of a policy version: base_failed, kept. The base rules reject under every version."""
    failed = F.col("failed")
    return ledger_rows.withColumn("base_failed", failed.bitwiseAND(F.lit(BASE_MASK)) != 0).withColumn("kept", failed.bitwiseAND(F.lit(POLICIES[version] | BASE_MASK)) == 0)


def ablations(ledger_rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """What each rule of a policy does: rule, n_failed, n_only (documents that it alone rejects, which its removal would keep).

    Documents are first counted by their bits, 2^rules groups at most, so the ledger is read once and little is shuffled.
    """
    mask = POLICIES[version] | BASE_MASK
    counts = ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in RULES if mask >> r.bit & 1])
    each = counts.select("bits", "n", F.inline(rules))
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
  length(regexp_replace(t, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_capitals, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations
  FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, ((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_capitals > 30 * word_chars THEN 32 ELSE 0 END) + (CASE WHEN 10 * n_exclamations > n_words THEN 64 ELSE 0 END))::BIGINT AS failed FROM m)
SELECT *, (failed & 3) <> 0 AS base_failed, (failed & 127) = 0 AS kept FROM f
"""
