"""Connected components of a graph of links, by alternating large and small stars; of a small graph on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from runlattice.llm.common import dropped, stored

#: Links that the driver takes (two longs each); more are joined in rounds.
DRIVER_LINKS = 200_000


def _on_driver(few: pa.Table) -> pa.Table:
    """(node, root) of the links (a, b) by union-find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for a, b in zip(few["a"].to_pylist(), few["b"].to_pylist()):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    rows = [(x, root) for x in parent if (root := find(x)) != x]
    return pa.table({"node": pa.array([r[0] for r in rows], pa.int64()), "root": pa.array([r[1] for r in rows], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), root being the least node that it reaches; nodes that are roots are left out.

    Each round moves links towards the least neighbour, with a map-side minimum and an equi-join that Spark can split
    where a node has very many links; rounds grow as the logarithm of the longest chain. Every round is written to the shared folder; the result is a stored table.
    """
    few = edges.select("a", "b").limit(DRIVER_LINKS + 1).toArrow()
    if few.num_rows <= DRIVER_LINKS:
        return stored(edges.sparkSession.createDataFrame(_on_driver(few), "node bigint, root bigint"), "links")
    now, mark = _marked(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while mark["n"] and mark != before:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        before, (after, mark) = mark, _marked(small)
        dropped(now)
        now = after
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._stored_at = now._stored_at
    return out


def _marked(links: DataFrame) -> tuple[DataFrame, dict]:
    """links as a stored table, with their number and a sum over them, taken while they are written."""
    seen = Observation()
    table = stored(links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "links")
    return table, seen.get
