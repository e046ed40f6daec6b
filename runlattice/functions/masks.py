"""Mask columns: struct<h:int, w:int, counts:array<int>>.

Counting and rearranging whole runs stays in Catalyst (higher-order functions over counts). Operations that walk runs in order are Arrow
functions over NumPy kernels: maps over rows, without a shuffle. Every result is canonical, so equality of columns is equality of masks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from runlattice.functions import kernels as k
from runlattice.functions.kernels import Mask

MASK = "struct<h:int,w:int,counts:array<int>>"
BBOX = "struct<x:double,y:double,w:double,h:double>"
STATS = "comp:int,area:bigint,x:int,y:int,w:int,h:int,cx:double,cy:double"
MASK_ARROW = pa.struct([("h", pa.int32()), ("w", pa.int32()), ("counts", pa.list_(pa.int32()))])
STATS_ARROW = pa.struct([("comp", pa.int32()), ("area", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("cx", pa.float64()), ("cy", pa.float64())])
MOMENTS = ",".join(f"{n}:double" for n in [*(f"m{i}{j}" for i in range(4) for j in range(4 - i)), *(p + n for p in ("mu", "nu") for n in ("20", "11", "02", "30", "21", "12", "03"))])

ColumnLike = Column | str


def _col(c: object) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


# -- Arrow bridge


def masks_of(array: pa.Array) -> list[Mask | None]:
    hs, ws, lists = array.field("h"), array.field("w"), array.field("counts")
    flat, ends = np.asarray(lists.values), np.asarray(lists.offsets)
    known = array.is_valid().to_pylist() if array.null_count else None
    return [None if (known and not known[i]) or h is None or w is None else Mask(h, w, flat[ends[i] : ends[i + 1]].astype(np.int64)) for i, (h, w) in enumerate(zip(hs.to_pylist(), ws.to_pylist()))]


def to_arrow(masks: Sequence[Mask | None]) -> pa.Array:
    ends = np.cumsum([0, *(0 if m is None else len(m.counts) for m in masks)], dtype=np.int32)
    flat = np.concatenate([m.counts for m in masks if m is not None]) if any(m is not None for m in masks) else np.empty(0)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
    return pa.StructArray.from_arrays([pa.array([m and m.h for m in masks], pa.int32()), pa.array([m and m.w for m in masks], pa.int32()), lists], fields=list(MASK_ARROW), mask=pa.array([m is None for m in masks], pa.bool_()))


def _values(array: pa.Array) -> list:
    if pa.types.is_struct(array.type) and [f.name for f in array.type] == ["h", "w", "counts"]:
        return masks_of(array)
    if pa.types.is_list(array.type) and pa.types.is_struct(array.type.value_type) and [f.name for f in array.type.value_type] == ["h", "w", "counts"]:
        flat, ends = masks_of(array.values), np.asarray(array.offsets)
        return [flat[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], array.is_valid().to_pylist())]
    return array.to_pylist()


def _result(values: list, result: str) -> pa.Array:
    if result == MASK:
        return to_arrow(values)
    if result == f"array<{MASK}>":
        ends = np.cumsum([0, *(len(v or []) for v in values)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), to_arrow([m for v in values for m in (v or [])]), mask=pa.array([v is None for v in values], pa.bool_()))
    types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}
    if result in types:
        return pa.array(values, types[result])
    return pa.array(values, _struct_type(result))


def _struct_type(result: str) -> pa.DataType:
    if result.startswith("array<"):
        return pa.list_(_struct_type(result[6:-1]))
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    return pa.struct([(n, kinds[t]) for n, t in (f.split(":") for f in result[7:-1].split(","))])


def apply(function: Callable, result: str, *columns: ColumnLike) -> Column:
    """A Column of function over the columns' values row by row; a null argument gives null."""

    @F.arrow_udf(result)
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            given = zip(*(_values(rows.field(i)) for i in range(rows.type.num_fields)))
            yield _result([None if any(v is None for v in args) else function(*args) for args in given], result)

    return udf(F.struct(*[_col(c).alias(f"c{i}") for i, c in enumerate(columns)]))


class Flat:
    """The masks of a batch in flat arrays: sizes, and foreground intervals with the row that owns each. Null masks have no intervals."""

    def __init__(self, array: pa.Array) -> None:
        lists = array.field("counts")
        self.valid = np.asarray(array.is_valid()) & np.asarray(array.field("h").is_valid()) & np.asarray(array.field("w").is_valid())
        self.h, self.w = (np.asarray(array.field(c).fill_null(0), dtype=np.int64) for c in "hw")
        ends = np.asarray(lists.offsets, dtype=np.int64) if len(array) else np.zeros(1, dtype=np.int64)
        flat = np.asarray(lists.values, dtype=np.int64)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        self.rows, size = len(array), np.diff(ends)
        upto = np.concatenate([[0], np.cumsum(flat)])
        row = np.repeat(np.arange(self.rows), size)
        odd = ((np.arange(len(flat)) - ends[row]) % 2 == 1) & self.valid[row]
        self.owner = row[odd]
        base = upto[ends[self.owner]]
        self.start, self.end = upto[:-1][odd] - base, upto[1:][odd] - base

    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bincount(self.owner, minlength=self.rows))]).astype(np.int32)


def batched(function: Callable[..., pa.Array], result: str, *columns: ColumnLike) -> Column:
    """A Column of function over whole batches of masks in flat arrays, without a loop over rows."""

    @F.arrow_udf(result)
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield function(*(Flat(rows.field(i)) for i in range(rows.type.num_fields)))

    return udf(F.struct(*[_col(c).alias(f"c{i}") for i, c in enumerate(columns)]))


def drawn(function: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]], h: int, w: int, *columns: ColumnLike) -> Column:
    """A Column of masks of one extent that function draws for whole batches: from the columns as Arrow arrays without nulls it makes intervals (row, start, end) in order; a null argument gives null."""

    @F.arrow_udf(MASK)
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            given = pa.RecordBatch.from_arrays(rows.flatten(), [f"c{i}" for i in range(rows.type.num_fields)])
            valid = np.ones(len(rows), dtype=bool)
            for c in given.columns:
                valid &= np.asarray(c.is_valid())
            known = given.filter(pa.array(valid))
            owner, start, end = function(*known.columns) if len(known) else 3 * [np.empty(0, np.int64)]
            yield _packed(h, w, np.flatnonzero(valid)[owner], start, end, valid)

    return udf(F.struct(*[_col(c).alias(f"c{i}") for i, c in enumerate(columns)]))


def _packed(h: int, w: int, owner: np.ndarray, start: np.ndarray, end: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Masks of intervals in order of (owner, start) that don't overlap; empty ones are ignored and touching ones are one run."""
    rows, size = len(valid), h * w
    some = end > start
    owner, start, end = owner[some], start[some], end[some]
    new = np.ones(len(owner) + 1, dtype=bool)
    new[1:-1] = (owner[1:] != owner[:-1]) | (start[1:] != end[:-1])
    owner, start, end = owner[new[:-1]], start[new[:-1]], end[new[1:]]
    upto = np.cumsum(np.bincount(owner, minlength=rows)) if rows else np.empty(0, np.int64)
    before = np.concatenate([[0], end[:-1]]) if len(end) else end
    before[np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else []] = 0
    counts = np.stack([start - before, end - start], axis=1).ravel()
    reached = np.zeros(rows, dtype=np.int64)
    reached[owner] = end
    tail = np.where(valid, size - reached, 0)
    counts = np.insert(counts, 2 * upto[tail > 0], tail[tail > 0])
    ends = np.concatenate([[0], 2 * upto + np.cumsum(tail > 0)]).astype(np.int32)
    extents = [pa.array(np.full(rows, n, dtype=np.int32)) for n in (h, w)]
    return pa.StructArray.from_arrays([*extents, pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype(np.int32)))], fields=list(MASK_ARROW), mask=pa.array(~valid))


def _each(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For so many items of each row: the row of each, and its number in the row."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - (np.cumsum(size) - size)[owner]


def fields(m: ColumnLike) -> tuple[Column, Column, Column]:
    m = _col(m)
    return m["h"], m["w"], m["counts"]


def make(h: Column, w: Column, counts: Column) -> Column:
    return F.struct(h.cast("int").alias("h"), w.cast("int").alias("w"), counts.cast("array<int>").alias("counts"))


def extent(imshape: tuple[int, int] | None = None, imsize: tuple[int, int] | None = None) -> tuple[int, int]:
    """(h, w) from a shape, or from a size given as (w, h)."""
    if imshape is None and imsize is None:
        raise ValueError("a shape or a size")
    return tuple(imshape) if imshape is not None else (imsize[1], imsize[0])


# -- constructors


def from_counts(counts: ColumnLike, h: object, w: object, order: str = "F", validate_sum: bool = True) -> Column:
    """Runs of an array column, column-major ('F') or row-major ('C'); with validate_sum wrong sums raise."""

    def build(c: list[int], h: int, w: int) -> Mask:
        if not validate_sum and sum(c) != h * w:
            return Mask(h, w, np.asarray(c, np.int64))
        return k.canonical(h, w, c) if order == "F" else k.transpose(k.canonical(w, h, c))

    return apply(build, MASK, counts, h, w)


def from_bits(bits: ColumnLike, h: int, w: int) -> Column:
    """Catalyst-only: a column-major array of booleans as a mask; null elements are background."""
    b = _col(bits)
    n = h * w
    at = lambda p: F.coalesce(F.get(b, p), F.lit(False))
    turns = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.when(p == 0, at(p)).otherwise(at(p) != at(p - 1)))
    ends = F.concat(turns, F.array(F.lit(n)))
    starts = F.concat(F.array(F.lit(0)), turns)
    return make(F.lit(h), F.lit(w), F.zip_with(ends, starts, lambda e, s: e - s)) if n else make(F.lit(h), F.lit(w), F.array())


def from_array(values: ColumnLike, h: int, w: int, threshold: float = 1, order: str = "F") -> Column:
    """Foreground where a value is threshold or more, compared as it is, without a cast to bytes."""
    v = _col(values)
    if order == "C":
        v = F.transform(F.sequence(F.lit(0), F.lit(max(h * w - 1, 0))), lambda p: F.get(v, (p % h) * w + (p / h).cast("int")))
    return from_bits(F.transform(v, lambda x: x >= threshold), h, w)


def zeros(imshape: tuple[int, int] | None = None, imsize: tuple[int, int] | None = None) -> Column:
    h, w = extent(imshape, imsize)
    return make(F.lit(h), F.lit(w), F.array(F.lit(h * w)) if h * w else F.array())


empty = zeros


def ones(imshape: tuple[int, int] | None = None, imsize: tuple[int, int] | None = None) -> Column:
    h, w = extent(imshape, imsize)
    return make(F.lit(h), F.lit(w), F.array(F.lit(0), F.lit(h * w)) if h * w else F.array())


full = ones


def zeros_like(m: ColumnLike) -> Column:
    h, w, _ = fields(m)
    return make(h, w, F.when(h * w > 0, F.array(h * w)).otherwise(F.array()))


def ones_like(m: ColumnLike) -> Column:
    h, w, _ = fields(m)
    return make(h, w, F.when(h * w > 0, F.array(F.lit(0), h * w)).otherwise(F.array()))


def from_bbox(x: object, y: object, w: object, h: object, imshape: tuple[int, int] | None = None, imsize: tuple[int, int] | None = None) -> Column:
    """A rectangle, its edges clipped to the image and rounded half away from zero; a null edge lies at zero."""
    ih, iw = extent(imshape, imsize)

    def draw(*edges: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x0, x1, y0, y1 = map(np.asarray, edges)
        owner, column = _each(np.where(y1 > y0, np.maximum(x1 - x0, 0), 0))
        start = (x0[owner] + column) * ih + y0[owner]
        return owner, start, start + (y1 - y0)[owner]

    def edge(v: Column, most: int) -> Column:
        at = F.least(F.greatest(v.cast("double"), F.lit(0.0)), F.lit(float(most)))
        return F.floor(at) + (at - F.floor(at) >= 0.5).cast("bigint")

    return drawn(draw, ih, iw, edge(_col(x), iw), edge(_col(x) + _col(w), iw), edge(_col(y), ih), edge(_col(y) + _col(h), ih))


def from_circle(cx: object, cy: object, radius: object, imshape: tuple[int, int] | None = None, imsize: tuple[int, int] | None = None) -> Column:
    h, w = extent(imshape, imsize)
    return drawn(lambda *columns: k.circles(*(np.asarray(c, dtype=np.float64) for c in columns), h, w), h, w, cx, cy, radius)


def from_polygon(xy: ColumnLike, imshape: tuple[int, int] | None = None, imsize: tuple[int, int] | None = None) -> Column:
    h, w = extent(imshape, imsize)

    def draw(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ends = np.asarray(lists.offsets, dtype=np.int64)
        return k.polygons(np.asarray(lists.values.cast(pa.float64()).fill_null(np.nan))[ends[0] : ends[-1]], ends - ends[0], h, w)

    return drawn(draw, h, w, xy)


# -- codecs and accessors


def coco_string(m: ColumnLike) -> Column:
    return apply(lambda a: k.coco_encode(a.counts), "string", m)


def from_coco(text: ColumnLike, h: object, w: object) -> Column:
    """The mask of a COCO string; null where the string is broken or doesn't fill the extent."""

    def build(t: str, h: int, w: int) -> Mask | None:
        c = k.coco_decode(t)
        return k.canonical(h, w, c) if c is not None and c.sum() == h * w else None

    return apply(build, MASK, text, h, w)


def coco_zlib(m: ColumnLike, level: int = -1) -> Column:
    return apply(lambda a: k.zlib_pack(k.coco_encode(a.counts), level), "binary", m)


def inflate(z: ColumnLike) -> Column:
    """A COCO string from its zlib form."""
    import zlib

    return apply(lambda b: zlib.decompress(b).decode("ascii"), "string", z)


def to_dict(m: ColumnLike, zlevel: int | None = None) -> Column:
    """struct<size, counts> or, with a level, struct<size, zcounts>."""
    h, w, _ = fields(m)
    body = coco_string(m).alias("counts") if zlevel is None else coco_zlib(m, zlevel).alias("zcounts")
    return F.struct(F.array(h, w).alias("size"), body)


def from_dict(d: ColumnLike, kind: str = "counts") -> Column:
    """A mask from a COCO struct with counts, ucounts or zcounts."""
    d = _col(d)
    h, w = d["size"][0], d["size"][1]
    if kind == "ucounts":
        return from_counts(d["ucounts"], h, w)
    return from_coco(d["counts"] if kind == "counts" else inflate(d["zcounts"]), h, w)


def to_array(m: ColumnLike, value: int = 1, order: str = "F") -> Column:
    """Pixels by columns ('F', Catalyst-only) or by rows ('C'), value on foreground; runs that don't fill the extent raise."""
    if order not in ("C", "F"):
        raise ValueError("order is 'C' or 'F'")
    h, w, c = fields(transpose(m) if order == "C" else m)
    pixels = F.flatten(F.transform(c, lambda n, i: F.array_repeat(F.when(i % 2 == 1, F.lit(value)).otherwise(F.lit(0)), n)))
    return F.when(F.assert_true(is_valid(m)).isNull(), pixels)


def decode_channels(m: ColumnLike, image: ColumnLike, values: Sequence[int]) -> Column:
    """Catalyst-only: paints the foreground into a column-major array of pixels of several channels, side by side for each pixel, one value for each channel."""
    n = len(values)
    on, colours = to_array(m, 1), F.array(*[F.lit(v) for v in values])
    return F.transform(_col(image), lambda old, i: F.when(F.get(on, F.floor(i / n).cast("int")) == 1, F.get(colours, i % n)).otherwise(old))


def equal(a: ColumnLike, b: ColumnLike) -> Column:
    """Catalyst-only: same extent and pixels; masks are canonical, so same runs."""
    return _col(a) == _col(b)


def pad_sides(m: ColumnLike, sides: Sequence[int], **options: object) -> Column:
    """Pad by [left, right, top, bottom]."""
    left, right, top, bottom = sides
    return pad(m, top, bottom, left, right, **options)


def tight_crop_and_box(m: ColumnLike) -> Column:
    """struct<mask, box>: the crop to the foreground's box, and that box."""
    return F.struct(tight_crop(m).alias("mask"), bbox(m).alias("box"))


def decode_into(m: ColumnLike, image: ColumnLike, value: int = 1) -> Column:
    """Catalyst-only: paints the foreground into a column-major pixel array."""
    return F.zip_with(to_array(m, 1), _col(image), lambda on, old: F.when(on == 1, F.lit(value)).otherwise(old))


def counts_string(m: ColumnLike) -> Column:
    return F.array_join(_col(m)["counts"].cast("array<string>"), ",")


def density(m: ColumnLike) -> Column:
    """Runs per pixel."""
    h, w, c = fields(m)
    return F.size(c) / (h * w)


def is_valid(m: ColumnLike) -> Column:
    h, w, c = fields(m)
    return F.forall(F.slice(c, 2, F.greatest(F.size(c), F.lit(1))), lambda n: n > 0) & (total(c) == h.cast("bigint") * w)


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, n: a + n)


def positions(m: ColumnLike) -> Column:
    """Linear positions x * h + y of the foreground."""

    def each(a: Flat) -> pa.Array:
        size = a.end - a.start
        upto = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(upto[-1]) - np.repeat(upto[:-1] - a.start, size)
        return pa.ListArray.from_arrays(pa.array(upto[a.offsets()].astype(np.int32)), pa.array(at.astype(np.int32)), mask=pa.array(~a.valid))

    return batched(each, "array<int>", m)


def runs(m: ColumnLike) -> Column:
    """Foreground intervals as array<struct<s,e>> of linear positions."""

    def each(a: Flat) -> pa.Array:
        pairs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (a.start, a.end)], ["s", "e"])
        return pa.ListArray.from_arrays(pa.array(a.offsets()), pairs, mask=pa.array(~a.valid))

    return batched(each, "array<struct<s:int,e:int>>", m)


# -- boolean algebra


def complement(m: ColumnLike) -> Column:
    """Catalyst-only."""
    h, w, c = fields(m)
    return make(h, w, F.when(F.size(c) == 0, c).when(c[0] == 0, F.slice(c, 2, F.size(c))).otherwise(F.concat(F.array(F.lit(0)), c)))


def merge(a: ColumnLike, b: ColumnLike, function: str | int) -> Column:
    table = k.BOOL_FUNCS[function] if isinstance(function, str) else function & 15
    return apply(lambda p, q: k.merge(p, q, table), MASK, a, b)


def union(a: ColumnLike, b: ColumnLike) -> Column:
    return merge(a, b, "union")


def intersection(a: ColumnLike, b: ColumnLike) -> Column:
    return merge(a, b, "intersection")


def difference(a: ColumnLike, b: ColumnLike) -> Column:
    return merge(a, b, "difference")


def xor(a: ColumnLike, b: ColumnLike) -> Column:
    return merge(a, b, "xor")


def merge_many(masks: Sequence[ColumnLike], functions: Sequence[str | int]) -> Column:
    """Left fold over columns with one function, or one for each step."""
    tables = [k.BOOL_FUNCS[f] if isinstance(f, str) else f & 15 for f in functions]
    return apply(lambda *m: k.merge_fold(m, tables), MASK, *masks)


def merge_custom(masks: Sequence[ColumnLike], function: Callable[..., object]) -> Column:
    """Any function of n booleans; it is tabulated here, once, and not called for pixels."""
    table = k.truth_table(function, len(masks))
    return apply(lambda *m: k.merge_custom(m, table), MASK, *masks)


def merge_count(masks: Sequence[ColumnLike], threshold: int) -> Column:
    return apply(lambda *m: k.merge_count(m, threshold), MASK, *masks)


def merge_weighted(masks: Sequence[ColumnLike], weights: Sequence[float], threshold: float) -> Column:
    return apply(lambda *m: k.merge_weighted(m, weights, threshold), MASK, *masks)


# -- geometry, resampling, morphology: one row in, one row out


def _unary(name: str) -> Callable[..., Column]:
    kernel = getattr(k, name)

    def function(m: ColumnLike, *args: object, **options: object) -> Column:
        return apply(lambda a: kernel(a, *args, **options), MASK, m)

    function.__name__, function.__doc__ = name, kernel.__doc__
    return function


crop, pad, shift, flip, transpose, rot90, tile, repeat, stride, part, put = map(_unary, ("crop", "pad", "shift", "flip", "transpose", "rot90", "tile", "repeat", "stride", "part", "put"))
resize, warp_affine, warp_perspective, warp_distorted = map(_unary, ("resize", "warp_affine", "warp_perspective", "warp_distorted"))
conv2d_valid, avg_pool2d_valid, dilate_vertical, contours = map(_unary, ("conv2d_valid", "avg_pool2d_valid", "dilate_vertical", "contours"))
remove_small, fill_holes, largest_component = map(_unary, ("remove_small", "fill_holes", "largest_component"))


def crop_by(m: ColumnLike, x: object, y: object, w: object, h: object) -> Column:
    """Crop with a box for each row."""
    return apply(k.crop, MASK, m, x, y, w, h)


def tight_crop(m: ColumnLike) -> Column:
    return apply(lambda a: k.crop(a, *k.box_of(a)), MASK, m)


def flipud(m: ColumnLike) -> Column:
    return flip(m, 0)


def fliplr(m: ColumnLike) -> Column:
    return flip(m, 1)


def put_part(m: ColumnLike, rows: slice, cols: slice, value: ColumnLike | int) -> Column:
    return apply(lambda a: k.put_part(a, rows, cols, value), MASK, m) if isinstance(value, int) else apply(lambda a, v: k.put_part(a, rows, cols, v), MASK, m, value)


def hconcat(masks: Sequence[ColumnLike]) -> Column:
    return apply(lambda *m: k.hconcat(m), MASK, *masks)


def vconcat(masks: Sequence[ColumnLike]) -> Column:
    return apply(lambda *m: k.vconcat(m), MASK, *masks)


def fill_rectangle(m: ColumnLike, x: float, y: float, w: float, h: float, value: int = 1) -> Column:
    return apply(lambda a: k.merge(a, k.from_bbox((x, y, w, h), a.h, a.w), 14 if value == 1 else 4), MASK, m)


def fill_circle(m: ColumnLike, cx: float, cy: float, radius: float, value: int = 1) -> Column:
    return apply(lambda a: k.merge(a, k.from_circle(cx, cy, radius, a.h, a.w), 14 if value == 1 else 4), MASK, m)


def max_pool2x2(m: ColumnLike) -> Column:
    return apply(lambda a: k.pool2x2(a, 1), MASK, m)


def min_pool2x2(m: ColumnLike) -> Column:
    return apply(lambda a: k.pool2x2(a, 4), MASK, m)


def avg_pool2x2(m: ColumnLike) -> Column:
    return apply(lambda a: k.pool2x2(a, 2), MASK, m)


def dilate3x3(m: ColumnLike, connectivity: int = 4) -> Column:
    return apply(lambda a: k.dilate(a, k.kernel3(connectivity)), MASK, m)


def erode3x3(m: ColumnLike, connectivity: int = 4) -> Column:
    return apply(lambda a: k.erode(a, k.kernel3(connectivity)), MASK, m)


def dilate5x5(m: ColumnLike) -> Column:
    return apply(lambda a: k.dilate(a, k.KERNEL5), MASK, m)


def erode5x5(m: ColumnLike) -> Column:
    return apply(lambda a: k.erode(a, k.KERNEL5), MASK, m)


def dilate(m: ColumnLike, kernel_shape: str = "circle", kernel_size: int = 7) -> Column:
    heights = k.kernel(kernel_shape, kernel_size)
    return apply(lambda a: k.dilate(a, heights), MASK, m)


def erode(m: ColumnLike, kernel_shape: str = "circle", kernel_size: int = 7) -> Column:
    heights = k.kernel(kernel_shape, kernel_size)
    return apply(lambda a: k.erode(a, heights), MASK, m)


def opening(m: ColumnLike, connectivity: int = 4) -> Column:
    q = k.kernel3(connectivity)
    return apply(lambda a: k.dilate(k.erode(a, q), q), MASK, m)


def closing(m: ColumnLike, connectivity: int = 4) -> Column:
    q = k.kernel3(connectivity)
    return apply(lambda a: k.erode(k.dilate(a, q), q), MASK, m)


def opening2(m: ColumnLike) -> Column:
    return apply(lambda a: k.dilate(k.erode(a, k.KERNEL5), k.KERNEL5), MASK, m)


def closing2(m: ColumnLike) -> Column:
    return apply(lambda a: k.erode(k.dilate(a, k.KERNEL5), k.KERNEL5), MASK, m)


# -- measures


def area(m: ColumnLike) -> Column:
    """Catalyst-only: foreground pixels."""
    return total(F.filter(_col(m)["counts"], lambda n, i: i % 2 == 1))


def any_set(m: ColumnLike) -> Column:
    return F.size(_col(m)["counts"]) > 1


def all_set(m: ColumnLike) -> Column:
    h, w, c = fields(m)
    return (h * w == 0) | ((F.size(c) == 2) & (c[0] == 0))


def get_pixel(m: ColumnLike, y: int, x: int) -> Column:
    """Catalyst-only: the pixel of row y, column x; negative ones count from the end."""
    h, w, c = fields(m)
    at = (F.lit(x) + F.when(F.lit(x < 0), w).otherwise(0)) * h + F.lit(y) + F.when(F.lit(y < 0), h).otherwise(0)
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(-1).alias("run"))
    return F.aggregate(c, start, lambda a, n: F.struct((a["upto"] + n).alias("upto"), F.when(a["upto"] <= at, a["run"] + 1).otherwise(a["run"]).alias("run")), lambda a: a["run"] % 2 == 1)


def bbox(m: ColumnLike) -> Column:
    """struct<x,y,w,h> of the foreground's box; zeros for an empty mask."""

    def each(a: Flat) -> pa.Array:
        h = a.h[a.owner]
        x0, x1 = a.start // h, (a.end - 1) // h
        one = x0 == x1
        y0, y1 = np.where(one, a.start % h, 0), np.where(one, (a.end - 1) % h, h - 1)
        out = np.zeros((4, a.rows), dtype=np.int64)
        some, first = np.unique(a.owner, return_index=True)
        if len(some):
            least = [np.minimum.reduceat(v, first) for v in (x0, y0)]
            most = [np.maximum.reduceat(v, first) for v in (x1, y1)]
            out[:, some] = [*least, *(v - u + 1 for u, v in zip(least, most))]
        return pa.StructArray.from_arrays([pa.array(v.astype(np.float64)) for v in out], list("xywh"), mask=pa.array(~a.valid))

    return batched(each, BBOX, m)


def centroid(m: ColumnLike) -> Column:
    """struct<x,y> of the mean pixel; NaN for an empty mask."""

    def mean(a: Mask) -> dict[str, float]:
        r = k.raw_moments(a)
        return {"x": r["m10"] / r["m00"], "y": r["m01"] / r["m00"]} if r["m00"] else {"x": float("nan"), "y": float("nan")}

    return apply(mean, "struct<x:double,y:double>", m)


def moments(m: ColumnLike) -> Column:
    return apply(k.moments, f"struct<{MOMENTS}>", m)


def hu_moments(m: ColumnLike) -> Column:
    return apply(k.hu_moments, "array<double>", m)


def perimeter(m: ColumnLike) -> Column:
    return apply(lambda a: k.area(k.contours(a)), "bigint", m)


def overlap(a: ColumnLike, b: ColumnLike) -> Column:
    """Common foreground pixels; extents must agree."""

    def each(p: Flat, q: Flat) -> pa.Array:
        valid = p.valid & q.valid
        if ((p.h != q.h) | (p.w != q.w))[valid].any():
            raise k.MaskError("masks differ in extent")
        room = int((np.concatenate([[0], p.h * p.w, q.h * q.w])).max()) + 1
        starts, ends = q.start + q.owner * room, q.end + q.owner * room
        upto = np.concatenate([[0], np.cumsum(ends - starts)])

        def covered(x: np.ndarray) -> np.ndarray:
            """Foreground of q before x, all rows side by side."""
            n = np.searchsorted(starts, x, "right")
            return upto[n] - (np.maximum(ends[n - 1] - x, 0) * (n > 0) if len(ends) else 0)

        at = p.owner * room
        both = covered(p.end + at) - covered(p.start + at)
        return pa.array(np.bincount(p.owner, weights=both, minlength=p.rows).astype(np.int64), mask=~valid)

    return batched(each, "bigint", a, b)


def iou(a: ColumnLike, b: ColumnLike) -> Column:
    return apply(k.iou, "double", a, b)


def iou_many(masks: ColumnLike) -> Column:
    """Of an array of masks: pixels of all over pixels of any."""

    def ratio(m: list[Mask]) -> float:
        both = k.area(k.merge_count(m, len(m)))
        return both / k.area(k.merge_count(m, 1)) if both else 0.0

    return apply(ratio, "double", masks)


def bbox_iou(a: ColumnLike, b: ColumnLike) -> Column:
    """Catalyst-only: of two box structs; 0 where they don't overlap strictly."""
    a, b = _col(a), _col(b)
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w * h / (a["w"] * a["h"] + b["w"] * b["h"] - w * h)).otherwise(F.lit(0.0))


def largest_rectangle(m: ColumnLike, aspect_ratio: float | None = None) -> Column:
    f = k.largest_rectangle if aspect_ratio is None else lambda a: k.largest_rectangle_aspect(a, aspect_ratio)
    return apply(lambda a: dict(zip("xywh", map(float, f(a)))), BBOX, m)


def largest_rectangle_around(m: ColumnLike, cx: float, cy: float, aspect_ratio: float | None = None) -> Column:
    return apply(lambda a: dict(zip("xywh", map(float, k.largest_rectangle_around(a, cx, cy, aspect_ratio)))), BBOX, m)


# -- components


def component_stats(m: ColumnLike, connectivity: int = 4, min_size: int = 1) -> Column:
    """array<struct> of comp, area, x, y, w, h, cx, cy, in order of first pixels."""
    return apply(lambda a: k.component_stats(a, connectivity, min_size), f"array<struct<{STATS}>>", m)


def components(m: ColumnLike, connectivity: int = 4, min_size: int = 1) -> Column:
    return apply(lambda a: k.component_masks(a, connectivity, min_size), f"array<{MASK}>", m)


def count_components(m: ColumnLike, connectivity: int = 4, min_size: int = 1) -> Column:
    return apply(lambda a: len(k.component_stats(a, connectivity, min_size)), "int", m)
