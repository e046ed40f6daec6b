"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set. MinHash orders shingles by a random hash; an item of n shingles keeps the
n - ceil(t * n) + 1 least of them as its sketch, so its class fixes the sketch length. A document that holds at least t of the item's shingles lacks
at most n - ceil(t * n), so it holds one of the sketch at least: the search misses nothing, however long the document is. (Bands of whole-document
signatures can't do that: 30 shingles in a document of 20,000 have a similarity near 0.001.) A document is compared only with classes whose items
fit into it, and candidates are verified by exact containment of word shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.llm.common import LOWER, distinct_sorted, ensure_workers_import, fresh, shingle_hashes, text_bytes, words_of

K = 5
#: Containment threshold as a fraction of integers.
NUMERATOR, DENOMINATOR = 4, 5
#: Most item shingles that are sent to every worker; larger benchmarks are joined by shuffle. 2 million are 16 MB of hashes and about 100 MB of text.
BROADCAST_SHINGLES = 2_000_000
FILTER_BITS = 22

PAIRS = "doc_id bigint, item_id bigint, n_item_shingles bigint, n_shared bigint"


def item_words(text: bytes) -> list[bytes]:
    return words_of(text.translate(LOWER))


def needed(n: int) -> int:
    return -(-NUMERATOR * n // DENOMINATOR)


class Index:
    """Sketches of the items by size class, and the items themselves for verification."""

    def __init__(self, items: list[tuple[int, bytes]], k: int) -> None:
        self.k = k
        self.items = []
        probes, owners, self.lengths = [], [], set()
        for item_id, text in items:
            words = item_words(text)
            if not words:
                continue
            m = min(k, len(words))
            hashes = distinct_sorted(shingle_hashes(words, k))
            n = len(hashes)
            self.lengths.add(m)
            sketch = hashes[: n - needed(n) + 1]
            probes.append(sketch)
            owners.append(np.full(len(sketch), len(self.items), dtype=np.int64))
            self.items.append((item_id, m, frozenset(zip(*(words[i:] for i in range(m)))), hashes))
        probe = np.concatenate(probes) if probes else np.empty(0, np.uint64)
        order = np.argsort(probe, kind="stable")
        self.probe, self.owner = probe[order], (np.concatenate(owners) if owners else np.empty(0, np.int64))[order]
        self.size_class = np.array([int(math.log2(len(x[2]))) for x in self.items], dtype=np.int64)
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.probe & np.uint64((1 << FILTER_BITS) - 1)] = True

    def found(self, text: bytes) -> list[tuple[int, int, int]]:
        """(item, its shingles, shared shingles) of every item that the text contains to the threshold."""
        words = item_words(text)
        by_length = {m: shingle_hashes(words, m) for m in self.lengths if len(words) >= m}
        if not by_length:
            return []
        every = np.concatenate(list(by_length.values()))
        hits = every[self.filter[every & np.uint64((1 << FILTER_BITS) - 1)]]
        if not len(hits):
            return []
        hits = distinct_sorted(hits)
        lo, hi = np.searchsorted(self.probe, hits, "left"), np.searchsorted(self.probe, hits, "right")
        owners = {int(o) for a, b in zip(lo, hi) for o in self.owner[a:b]}
        largest = int(math.log2(len(every)))
        out, own = [], {}
        for o in sorted(owners):
            item_id, m, shingles, hashes = self.items[o]
            if m not in by_length or self.size_class[o] > largest + 1 or len(by_length[m]) < needed(len(shingles)):
                continue
            if m not in own:
                own[m] = distinct_sorted(by_length[m])
            at = np.minimum(np.searchsorted(own[m], hashes), len(own[m]) - 1)
            if (own[m][at] == hashes).sum() < needed(len(shingles)):
                continue
            if ("words", m) not in own:
                own["words", m] = set(zip(*(words[i:] for i in range(m))))
            shared = len(shingles & own["words", m])
            if shared >= needed(len(shingles)):
                out.append((item_id, len(shingles), shared))
        return out


def _scanned(docs: DataFrame, items: list[tuple[int, bytes]], k: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((items, k))
    built: list[Index] = []

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(Index(*sent.value))
        for batch in batches:
            rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))) for x in built[0].found(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "item_id", "n_item_shingles", "n_shared"])

    return docs.mapInArrow(search, PAIRS)


def _shuffled(docs: DataFrame, bench: DataFrame, k: int) -> DataFrame:
    """The same search for benchmarks that are too large to send: sketches and documents meet by shingle length and hash.

    Equal rows go through the joins as one and repeat their pairs at the end.
    """

    def shingled(df: DataFrame, lengths: list[int] | None) -> DataFrame:
        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = {"key": [], "id": [], "times": [], "m": [], "size": [], "hash": [], "sketch": []}
                for key, i, times, t in zip(*(batch.column(c).to_pylist() for c in range(3)), text_bytes(batch.column(3))):
                    words = item_words(t)
                    for m in [min(k, len(words))] if lengths is None else lengths:
                        if not 0 < m <= len(words):
                            continue
                        h = distinct_sorted(shingle_hashes(words, m))
                        n = len(h)
                        for c, x in zip(("key", "id", "times", "m", "size"), (key, i, times, m, n)):
                            rows[c] += [x] * n
                        rows["hash"] += h.view(np.int64).tolist()
                        rows["sketch"] += [j <= n - needed(n) for j in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.bool_() if c == "sketch" else pa.int64()) for c, x in rows.items()], list(rows))

        each = df.groupBy("id", F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("times"))
        return each.select(F.xxhash64("id", "text").alias("key"), "id", "times", "text").mapInArrow(mapped, "key bigint, id bigint, times bigint, m bigint, size bigint, hash bigint, sketch boolean")

    items = shingled(bench, None).select(F.col("key").alias("item"), F.col("id").alias("item_id"), F.col("times").alias("item_times"), "m", F.col("size").alias("n"), "hash", "sketch")
    lengths = sorted(r["m"] for r in items.select("m").distinct().collect())
    own = shingled(docs, lengths).select(F.col("key").alias("doc"), F.col("id").alias("doc_id"), F.col("times").alias("doc_times"), "m", F.col("size").alias("doc_n"), "hash")
    fits = F.col("doc_n") * DENOMINATOR >= F.col("n") * NUMERATOR
    pairs = own.join(items.filter("sketch"), ["m", "hash"]).filter(fits).select("doc", "doc_id", "doc_times", "item", "item_id", "item_times", "m", "n").distinct()
    shared = pairs.join(items.select("item", "hash"), "item").join(own.select("doc", "m", "hash"), ["doc", "m", "hash"])
    counts = shared.groupBy("doc", "doc_id", "doc_times", "item", "item_id", "item_times", "n").agg(F.count("*").alias("n_shared"))
    found = counts.filter(F.col("n_shared") * DENOMINATOR >= F.col("n") * NUMERATOR)
    return found.select("doc_id", "item_id", F.col("n").alias("n_item_shingles"), "n_shared", F.explode(F.sequence(F.lit(1), F.col("doc_times") * F.col("item_times"))).alias("__time")).drop("__time")


def contained(docs: DataFrame, bench: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """Pairs of document and benchmark item of whose distinct k-word shingles the document holds 4 in 5 or more.

    Words are runs of other than ASCII white space, A-Z lower-cased. An item of fewer than k words is one shingle of its length, looked for among the
    document's shingles of that length. Items and documents without words match nothing. Returns one row per pair:
    doc_id, item_id, n_item_shingles, n_shared; repeated rows repeat their pairs; no rows for empty tables. Documents are scanned
    once, without a shuffle, while the items stay below broadcast_shingles words, which is counted first.
    """
    ensure_workers_import(docs.sparkSession)
    d = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    b = bench.select(F.col(f"`{item_id}`").cast("bigint").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    n_words = b.agg(F.coalesce(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+"))), F.lit(0))).first()[0]
    if n_words > broadcast_shingles:
        return _shuffled(d, b, k)
    return _scanned(d, [(r[0], (r[1] or "").encode()) for r in b.collect()], k)


def decontaminated(docs: DataFrame, bench: DataFrame, **options: object) -> DataFrame:
    """docs without the documents that contain a benchmark item; columns as before, whatever their names. A null id is kept, rows that share an id go together, empty tables take nothing away."""
    name = fresh(docs, "hit")
    hit = contained(docs, bench, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, F.col(f"`{options.get('doc_id', 'doc_id')}`").cast("bigint") == F.col(name), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(len(w), 5) AS m, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
ms AS (SELECT DISTINCT m FROM bs),
dx AS (SELECT DISTINCT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS s FROM d, ms WHERE len(w) >= m)
SELECT doc_id, item_id, any_value(n) AS n_item_shingles, count(*) AS n_shared
FROM dx JOIN bs USING (m, s) JOIN bn USING (item_id) GROUP BY doc_id, item_id HAVING 5 * count(*) >= 4 * any_value(n)
"""
