"""Pairs of masks that overlap, suppression among them, and visibility by depth."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlattice.functions import kernels, masks
from runlattice.operators.sweep import from_positions
from runlattice.storage import dropped, stored


def candidate_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], mask: str = "mask", cell: int = 64) -> DataFrame:
    """Rows of left and right with equal keys whose boxes overlap: columns of left as l, of right as r, boxes included.

    Boxes are cut into cells of a grid, so the join is an equi-join on keys and cell; a pair is made in the one cell that holds the upper left
    corner of its common box, so nothing is made twice and no distinct is needed.
    """

    def gridded(df: DataFrame) -> DataFrame:
        df = df.withColumn("__b", masks.bbox(mask)).filter("__b.w > 0 AND __b.h > 0")
        cells = lambda at, size: F.sequence(F.floor(at / cell).cast("int"), F.floor((at + size - 1) / cell).cast("int"))
        b = F.col("__b")
        rows = df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias("v"), F.explode(cells(b["x"], b["w"])).alias("cx"))
        v = F.col("v")["__b"]
        return rows.select("*", F.explode(cells(v["y"], v["h"])).alias("cy"))

    l, r = gridded(left).withColumnRenamed("v", "l"), gridded(right).withColumnRenamed("v", "r")
    a, b = F.col("l")["__b"], F.col("r")["__b"]
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    meet = (x < F.least(a["x"] + a["w"], b["x"] + b["w"])) & (y < F.least(a["y"] + a["h"], b["y"] + b["h"]))
    own = (F.floor(x / cell) == F.col("cx")) & (F.floor(y / cell) == F.col("cy"))
    return l.join(r, [*keys, "cx", "cy"]).filter(meet & own).select(*keys, "l", "r")


def iou_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], ids: tuple[str, str], mask: str = "mask", crowd: str | None = None, same: bool = False, cell: int = 64) -> DataFrame:
    """keys, a, b, common, iou of every pair with a common pixel; other pairs have an IoU of 0 and no row.

    crowd: a boolean column of right; there the denominator is the left mask's area. same: left and right are one set, and each pair is
    made once, the lesser id as a. Extents that differ give -1.
    """
    def side(df: DataFrame, id_column: str, crowd_column: str | None) -> DataFrame:
        about = F.col(crowd_column) if crowd_column else F.lit(False)
        return df.select(*keys, F.col(id_column).alias("id"), about.alias("crowd"), F.col(mask).alias("mask"), masks.area(mask).alias("area"))

    pairs = candidate_pairs(side(left, ids[0], None), side(right, ids[1], crowd), keys, "mask", cell)
    l, r = F.col("l"), F.col("r")
    if same:
        pairs = pairs.filter(l["id"] < r["id"])
    fit = (l["mask"]["h"] == r["mask"]["h"]) & (l["mask"]["w"] == r["mask"]["w"])
    sized = pairs.select(*keys, l["id"].alias("a"), r["id"].alias("b"), fit.alias("fit"), l["area"].alias("area_a"), r["area"].alias("area_b"), r["crowd"].alias("crowd"), masks.overlap(l["mask"], F.when(fit, r["mask"]).otherwise(l["mask"])).alias("common"))
    below = F.when(F.col("crowd"), F.col("area_a")).otherwise(F.col("area_a") + F.col("area_b") - F.col("common"))
    ratio = F.when(F.col("fit"), F.col("common") / below).otherwise(F.lit(-1.0))
    return sized.filter("common > 0 OR NOT fit").select(*keys, "a", "b", F.when(F.col("fit"), F.col("common")).otherwise(0).cast("bigint").alias("common"), ratio.alias("iou"))


def nms(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """Greedy suppression in order of id: a node goes if a kept one with a lesser id overlaps it by more than threshold.

    nodes (id), edges (a, b, iou) with a < b. In each round the nodes without an earlier undecided neighbour are kept and
    their later neighbours go, so rounds are as many as the longest chain of overlaps, not as the nodes. Returns id, kept for every row of nodes; rows that
    share an id share its verdict, null ids are kept. Each round is a stored table.
    """
    hits = stored(edges.filter(F.col("iou") > threshold).select("a", "b").distinct(), "hits")
    state = stored(nodes.select("id", F.lit(None).cast("boolean").alias("kept")).filter("id IS NOT NULL").distinct(), "state")
    while True:
        open_ = state.filter("kept IS NULL").select("id")
        live = hits.join(open_.withColumnRenamed("id", "a"), "a").join(open_.withColumnRenamed("id", "b"), "b")
        blocked = live.select(F.col("b").alias("id")).distinct().withColumn("blocked", F.lit(True))
        keep = open_.join(blocked, "id", "left").filter("blocked IS NULL").select("id", F.lit(True).alias("now"))
        gone = live.join(keep.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id"), F.lit(False).alias("now")).distinct()
        after = stored(state.join(keep.union(gone), "id", "left").select("id", F.coalesce("kept", "now").alias("kept")), "state")
        dropped(state)
        state = after
        if state.filter("kept IS NULL").isEmpty():
            dropped(hits)
            return nodes.select("id").join(state, "id", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))


def pixels(df: DataFrame, mask: str = "mask") -> DataFrame:
    """df without its mask, a row for each foreground pixel: h, w, at (x * h + y), x, y."""
    keep = [c for c in df.columns if c != mask]
    rows = df.select(*keep, F.col(mask)["h"].alias("h"), F.col(mask)["w"].alias("w"), F.explode(masks.positions(mask)).alias("at"))
    return rows.withColumns({"x": F.expr("at div h").cast("int"), "y": F.expr("at % h").cast("int")})


def visible(df: DataFrame, keys: Sequence[str], id_column: str, depth: Column, mask: str = "mask", parts: int = 1) -> DataFrame:
    """keys, id, mask of what each mask shows when those of less depth lie over it (least id among equal ones); hidden masks don't appear.

    The runs of the masks are painted from the back on a canvas of their group's extent, batch by batch; a task holds one batch and what shows of one group.
    Masks of a group must have one extent; null masks are left out. With parts above 1 a group is first painted in so many tasks by id, for groups with very many layers.
    """
    of = {c: df.schema[c].dataType for c in [*keys, id_column]}
    rows = df.filter(F.col(mask).isNotNull()).select(*keys, F.col(id_column), depth.alias("__depth"), F.col(mask).alias("__m"))
    if parts > 1:
        some = rows.withColumn("__part", F.pmod(F.xxhash64(id_column), F.lit(parts)).cast("int"))
        rows = _painted(some, [*keys, "__part"], id_column, {**of, "__part": T.IntegerType()}).drop("__part")
    return _painted(rows, keys, id_column, of).select(*keys, id_column, F.col("__m").alias("mask"))


def _painted(rows: DataFrame, keys: Sequence[str], id_column: str, of: dict[str, T.DataType]) -> DataFrame:
    """Rows of (keys, id, __depth, __m) with the parts of the masks that show. What a batch leaves of its last group goes on to the next batch."""
    schema = T.StructType([*(T.StructField(c, of[c]) for c in [*keys, id_column]), T.StructField("__depth", rows.schema["__depth"].dataType), T.StructField("__m", T._parse_datatype_string(masks.MASK))])
    names = [*keys, id_column, "__depth", "__m"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([*batch.columns[:-1], masks.to_arrow(masks.masks_of(batch.column("__m")))], names)
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            shown, groups = _shown(batch, list(keys), id_column)
            last = groups == groups[-1] if len(groups) else np.empty(0, dtype=bool)
            yield shown.filter(pa.array(~last))
            held = shown.filter(pa.array(last))
        if held is not None:
            yield held

    return rows.select(names).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def _shown(batch: pa.RecordBatch, keys: list[str], id_column: str) -> tuple[pa.RecordBatch, np.ndarray]:
    """What shows of the masks of a batch sorted by keys, and the number of the group of each row: groups side by side on one canvas, painted from the back."""
    at = list(zip(*(batch.column(c).to_pylist() for c in keys)))
    group = np.cumsum([0] + [a != b for a, b in zip(at, at[1:])])[: len(at)]
    flat = masks.Flat(batch.column("__m"))
    first = np.flatnonzero(np.diff(group, prepend=-1))
    h, w = flat.h[first], flat.w[first]
    if ((flat.h != h[group]) | (flat.w != w[group])).any():
        raise kernels.MaskError("masks differ in extent")
    offset = np.concatenate([[0], np.cumsum(h * w)])
    rank = np.empty(len(at), dtype=np.int64)
    rank[np.asarray(pc.sort_indices(pa.table({"d": batch.column("__depth"), "i": batch.column(id_column)}), sort_keys=[("d", "descending"), ("i", "descending")]))] = np.arange(len(at))
    order = np.argsort(rank[flat.owner], kind="stable")
    base, owner = offset[group[flat.owner]][order], flat.owner[order]
    canvas = np.full(offset[-1], -1, dtype=np.int64)
    for s, e, i in zip((flat.start[order] + base).tolist(), (flat.end[order] + base).tolist(), owner.tolist()):
        canvas[s:e] = i
    turn = np.flatnonzero(np.diff(canvas, prepend=-1))
    stop, who = np.append(turn[1:], len(canvas)), canvas[turn]
    turn, stop, who = (x[who >= 0] for x in (turn, stop, who))
    order = np.argsort(who, kind="stable")
    turn, stop, who = (x[order] for x in (turn, stop, who))
    rows, begin = np.unique(who, return_index=True)
    turn, stop = turn - offset[group[who]], stop - offset[group[who]]
    before = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
    before[begin] = 0
    counts = np.stack([turn - before, stop - turn], axis=1).ravel()
    finish = np.append(begin[1:], len(who)) if len(begin) else begin
    tail = h[group[rows]] * w[group[rows]] - stop[finish - 1] if len(rows) else rows
    counts = np.insert(counts, 2 * finish[tail > 0], tail[tail > 0])
    ends = np.concatenate([[0], 2 * finish + np.cumsum(tail > 0)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype(np.int32)))
    some = batch.take(pa.array(rows))
    shown = pa.StructArray.from_arrays([pa.array(x[group[rows]].astype(np.int32)) for x in (h, w)] + [lists], fields=list(masks.MASK_ARROW))
    return pa.RecordBatch.from_arrays([*some.columns[:-1], shown], batch.schema.names), group[rows]


def merge_to_label_map(df: DataFrame, keys: Sequence[str], ordinal: str, mask: str = "mask") -> DataFrame:
    """keys, x, y, label: of each covered pixel the greatest ordinal + 1, so the last mask wins; background pixels have no row."""
    top = visible(df.select(*keys, ordinal, mask), keys, ordinal, -F.col(ordinal), mask)
    return pixels(top).select(*keys, "x", "y", (F.col(ordinal) + 1).cast("int").alias("label"))


def from_label_map(df: DataFrame, keys: Sequence[str], labels: str, h: int, w: int) -> DataFrame:
    """keys, label, mask of each label above 0 in a column-major array of labels."""
    rows = df.select(*keys, F.posexplode(labels).alias("at", "label")).filter("label > 0").withColumns({"h": F.lit(h), "w": F.lit(w)})
    return from_positions(rows, [*keys, "label"], "h", "w", "at")


def components(df: DataFrame, keep: Sequence[str], mask: str = "mask", connectivity: int = 4, min_size: int = 1, where: str | None = None) -> DataFrame:
    """A row for each component: keep, its stats, mask. where: SQL over the stats (comp, area, x, y, w, h, cx, cy), in place of a callback."""
    rows = df.select(*keep, F.explode(F.arrays_zip(masks.component_stats(mask, connectivity, min_size).alias("s"), masks.components(mask, connectivity, min_size).alias("m"))).alias("c"))
    out = rows.select(*keep, "c.s.*", F.col("c.m").alias("mask"))
    return out.filter(where) if where else out


def component_stats(df: DataFrame, keep: Sequence[str], mask: str = "mask", connectivity: int = 4, min_size: int = 1) -> DataFrame:
    """A row for each component, without building its mask."""
    return df.select(*keep, F.inline(masks.component_stats(mask, connectivity, min_size)))


def hconcat_groups(df: DataFrame, keys: Sequence[str], ordinal: str, mask: str = "mask") -> DataFrame:
    """One mask per group, its masks side by side in order of ordinal; heights must agree."""
    return _concat_groups(df, keys, ordinal, mask, 1)


def vconcat_groups(df: DataFrame, keys: Sequence[str], ordinal: str, mask: str = "mask") -> DataFrame:
    return _concat_groups(df, keys, ordinal, mask, 0)


def _concat_groups(df: DataFrame, keys: Sequence[str], ordinal: str, mask: str, axis: int) -> DataFrame:
    got = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(ordinal, mask))).alias("__m")).withColumn("__m", F.transform("__m", lambda e: e[mask]))
    return got.select(*keys, masks.apply(lambda m: kernels.concatenate(m, axis), masks.MASK, "__m").alias("mask"))
