"""Line deduplication by winnowing over line hashes.

The lines of a document that hold words are a sequence of hashes. A window is a shortest stretch of neighbouring lines with min_words words: those that start at a
line and those that end at one, which together cover every repeated run of min_words words exactly. Of every window the line with the least hash is its fingerprint;
equal windows have equal ones, so a repeated run is sure to have a fingerprint in common with its first occurrence. The positions of the fingerprints are joined: only
those whose line is a fingerprint in several places go on. There the match is extended both ways, to the windows that hold the fingerprint, and these are compared by their content,
128 bits of the hashes of their lines. Overlapping windows make up the whole run. Of the windows that are equal all but the first (least doc_id, then place) are later copies, and
their lines are deleted. Repeated lines that aren't part of a repeated run of min_words words stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.llm.common import dropped, ensure_workers_import, fresh, mix64, stored, text_strings

MIN_WORDS = 25
BLANKS = " \t\n\x0b\f\r"
#: Of a window: document, fingerprint and its line, 128 bits of the content, first line, lines.
WINDOWS = "doc bigint, fp bigint, at int, a bigint, b bigint, first int, lines int"
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def windows(counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the shortest windows from each line on and up to each line; each window once."""
    ends = np.cumsum(counts)
    total, n = (int(ends[-1]) if len(ends) else 0), len(counts)
    if total < min_words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = ends - counts
    forth = np.searchsorted(ends, before + min_words)
    back = np.searchsorted(before, ends - min_words, "right") - 1
    first = np.concatenate([np.flatnonzero(forth < n), back[ends >= min_words]])
    last = np.concatenate([forth[forth < n], np.flatnonzero(ends >= min_words)])
    codes = np.unique(first * n + last)
    return codes // n, codes % n


def content(one: np.ndarray, two: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the lines from first to last, of the two halves of their hashes."""
    size = last - first + 1
    a, b = mix64(size.astype(np.uint64)), mix64(size.astype(np.uint64) + _B1)
    for i in range(int(size.max()) if len(size) else 0):
        live = size > i
        at = first[live] + i
        a[live] = mix64(a[live] * _B1 + one[at])
        b[live] = mix64((b[live] ^ two[at]) * _B2 + one[at])
    return a, b


def occurrences(text: str, min_words: int) -> list[np.ndarray] | None:
    """fp, at, a, b, first, lines of every window; lines with words are numbered, others are not."""
    words = [w for x in text.split("\n") if (w := x.encode().split())]
    first, last = windows(np.array([len(w) for w in words], dtype=np.int64), min_words)
    if not len(first):
        return None
    hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words), dtype=np.uint64)
    one, two = hashes[::2], hashes[1::2]
    at = np.array([i + int(one[i : j + 1].argmin()) for i, j in zip(first.tolist(), last.tolist())], dtype=np.int64)
    a, b = content(one, two, first, last)
    return [one[at].view(np.int64), at, a.view(np.int64), b.view(np.int64), first, last - first + 1]


def winnowed(docs: DataFrame, min_words: int, doc_id: str, text: str) -> DataFrame:
    """The windows of every document with their fingerprints."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for d, t in zip(batch.column(0).to_pylist(), text_strings(batch.column(1))):
                if (found := occurrences(t, min_words)) is not None:
                    held.append([np.full(len(found[0]), d, np.int64), *found])
            if held:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                columns = [pa.array(np.concatenate([h[i] for h in held]).astype(kind.to_pandas_dtype())) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in WINDOWS.split(", ")])

    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.col(f"`{text}`").cast("string").alias("text")).filter("doc IS NOT NULL")
    return rows.mapInArrow(mapped, WINDOWS)


def deletions(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines to delete: doc_id, lines (array<int>, sorted, from 0, lines without words not counted); documents without any are left out.

    First and last places of a fingerprint or a content are minima and maxima, combined before the shuffle, so a passage, however frequent, is one row of each
    task there and nothing meets itself in pairs.
    """
    ensure_workers_import(docs.sparkSession)
    every = stored(winnowed(docs, min_words, doc_id, text), "windows")
    place = F.struct("doc", "at")
    repeated = every.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo <> hi").select("fp")
    matched = stored(every.join(repeated, "fp", "left_semi").select("doc", "a", "b", "first", "lines"), "matched")
    dropped(every)
    place = F.struct("doc", "first")
    equal = matched.groupBy("a", "b").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo <> hi").select("a", "b", "lo")
    later = matched.join(equal, ["a", "b"]).filter(place != F.col("lo"))
    of_doc = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("first", F.col("first") + F.col("lines") - 1)))))
    return later.groupBy(F.col("doc").alias("doc_id")).agg(of_doc.alias("lines"))


def without_lines(docs: DataFrame, lines: DataFrame, doc_id: str = "doc_id", text: str = "text", deleted: str | None = None) -> DataFrame:
    """docs with the given lines deleted from their texts; lines without words stay. deleted: the name of an added column of how many."""
    key, gone, parts, own = (fresh(docs, c) for c in ("key", "gone", "parts", "own"))
    doc, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    both = docs.join(lines.select(F.col("doc_id").alias(key), F.col("lines").alias(gone)), doc.cast("bigint") == F.col(key), "left")
    both = both.withColumn(parts, F.when(F.col(gone).isNotNull(), F.split(t, "\n", -1)))
    both = both.withColumn(own, F.filter(F.transform(parts, lambda x, i: F.when(F.btrim(x, F.lit(BLANKS)) != "", i)), lambda i: i.isNotNull()))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.transform(gone, lambda o: F.get(own, o)))
    rest = F.array_join(F.transform(stay, lambda i: F.col(parts)[i]), "\n")
    columns = [(F.when(F.col(gone).isNotNull(), rest).otherwise(t) if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns]
    return both.select(*columns, *([F.coalesce(F.array_size(gone), F.lit(0)).cast("bigint").alias(deleted)] if deleted else []))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the later copies of repeated runs of lines; columns and rows as before, whatever their names, texts shortened.

    A run is a stretch of neighbouring lines with min_words words or more; lines are equal when their words are, lines without words don't count. Its first occurrence
    (least doc_id, then place) stays. Runs repeat within a document as well as across. A null text stays null, an empty one empty; rows
    with a null id stay as they are; rows that share an id are one document in one place; an empty table stays empty.
    """
    return without_lines(docs, deletions(docs, min_words, doc_id, text), doc_id, text)


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, n_lines, n_deleted, text (what is left)."""
    ensure_workers_import(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("bigint").alias("n_lines"))
    return without_lines(rows, deletions(docs, min_words), deleted="n_deleted").select("doc_id", "n_lines", "n_deleted", "text")
