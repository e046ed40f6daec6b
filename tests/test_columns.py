"""Mask columns, group sweeps, sources and streams on a few rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlattice.functions import kernels as k
from runlattice.functions import masks
from runlattice.operators import overlap, sweep
from runlattice.plans import catalog
from runlattice.sources import coco, png
from runlattice.streaming import running


def rows(spark, arrays):
    data = [(i, i % 2, [*map(int, m.counts)], m.h, m.w) for i, m in enumerate(map(k.from_dense, arrays))]
    df = spark.createDataFrame(data, "id int, grp int, c array<int>, h int, w int")
    return df.select("id", "grp", masks.make(F.col("h"), F.col("w"), F.col("c")).alias("mask"))


@pytest.fixture(scope="module")
def arrays():
    random = np.random.default_rng(5)
    return [random.random((4, 5)) < d for d in (0.0, 0.3, 0.5, 0.7, 1.0, 0.4)]


def dense(m):
    return k.dense(k.Mask(m["h"], m["w"], np.array(m["counts"], dtype=np.int64)))


def test_native_measures(spark, arrays):
    got = rows(spark, arrays).select("id", masks.area("mask").alias("a"), masks.is_valid("mask").alias("v"), masks.all_set("mask").alias("all"), masks.get_pixel("mask", -1, 2).alias("p"), masks.complement("mask").alias("c"), masks.to_array("mask").alias("px")).collect()
    for r in got:
        a = arrays[r["id"]]
        assert (r["a"], r["v"], r["all"], r["p"]) == (a.sum(), True, a.all(), a[-1, 2])
        assert np.array_equal(dense(r["c"]), ~a)
        assert r["px"] == a.T.ravel().astype(int).tolist()


def test_groups(spark, arrays):
    df = rows(spark, arrays)
    for function, combine in ((sweep.union_groups, lambda v: v.any(0)), (sweep.intersection_groups, lambda v: v.all(0)), (sweep.xor_groups, lambda v: v.sum(0) % 2 == 1)):
        for r in function(df, ["grp"]).collect():
            assert np.array_equal(dense(r["mask"]), combine(np.array([a for i, a in enumerate(arrays) if i % 2 == r["grp"]])))


def test_differing_extents_raise(spark):
    df = rows(spark, [np.ones((2, 2)), np.ones((3, 2)), np.ones((2, 3))])
    with pytest.raises(Exception, match="differ in extent"):
        sweep.union_groups(df, ["grp"]).collect()


def test_null_masks_stay_null(spark):
    df = spark.sql(f"SELECT CAST(NULL AS {masks.MASK}) AS mask")
    assert df.select(masks.transpose("mask").alias("m"), masks.perimeter("mask").alias("p")).first() == (None, None)


def test_nms_in_order(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id int")
    edges = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.9), (2, 3, 0.1), (3, 4, 0.6)], "a int, b int, iou double")
    assert {r["id"]: r["kept"] for r in overlap.nms(nodes, edges, 0.5).collect()} == {0: True, 1: False, 2: True, 3: True, 4: False}


def test_png_filters_and_files(spark, tmp_path):
    a = np.arange(30, dtype=np.uint8).reshape(5, 6) * 7
    assert np.array_equal(png.read_gray(png.write_gray(a)), a)
    (tmp_path / "a.png").write_bytes(png.write_gray(a))
    got = png.read_masks(spark, str(tmp_path), 100).first()
    assert np.array_equal(dense(got["mask"]), a >= 100)
    labels = np.array([[0, 1], [2, 2]], np.uint8)
    (tmp_path / "b.png").write_bytes(png.write_gray(labels))
    split = {r["label"]: dense(r["mask"]) for r in png.read_label_maps(spark, str(tmp_path / "b.png")).collect()}
    assert set(split) == {1, 2} and np.array_equal(split[2], labels == 2)
    with pytest.raises(ValueError):
        png.read_gray(b"GIF89a")


def test_png_row_filters():
    random = np.random.default_rng(3)
    above, row = random.integers(0, 256, 9).astype(np.uint8), random.integers(0, 256, 9).astype(np.uint8)
    for kind in range(5):
        out, left, corner = [], 0, 0
        for v, up in zip(row.tolist(), above.tolist()):
            p = left + up - corner
            near = sorted(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[0][2]
            guess = (0, left, up, (left + up) // 2, near)[kind]
            out.append((v - guess) % 256)
            left, corner = v, up
        assert np.array_equal(png._unfiltered(kind, np.array(out, np.uint8), above), row)


def test_coco_json(spark, tmp_path):
    lines = [{"id": 1, "size": [2, 3], "counts": k.coco_encode([1, 2, 3])}, {"id": 2, "size": [2, 3], "counts": [0, 6]}, {"id": 3, "size": [2, 3], "counts": "\x01"}]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, lines)))
    got = {r["id"]: r["mask"] for r in coco.read_coco(spark, str(tmp_path / "in.json")).collect()}
    assert got[1]["counts"] == [1, 2, 3] and got[2]["counts"] == [0, 6] and got[3] is None
    coco.write_coco(coco.read_coco(spark, str(tmp_path / "in.json")).filter("mask IS NOT NULL"), str(tmp_path / "out"))
    assert coco.read_coco(spark, str(tmp_path / "out")).count() == 2


def test_running_union(spark, arrays, tmp_path):
    rows(spark, arrays).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows(spark, arrays).schema).parquet(str(tmp_path / "in"))
    q = running.covered_positions(stream, ["grp"]).writeStream.outputMode("complete").format("memory").queryName("covered").start()
    q.processAllAvailable()
    q.stop()
    got = sweep.from_positions(spark.table("covered"), ["grp"], "h", "w", "at").collect()
    for r in got:
        assert np.array_equal(dense(r["mask"]), np.array([a for i, a in enumerate(arrays) if i % 2 == r["grp"]]).any(0))


def test_components_where(spark, arrays):
    got = overlap.components(rows(spark, arrays), ["id"], where="area >= 2").collect()
    assert all(r["area"] >= 2 and dense(r["mask"]).sum() == r["area"] for r in got)


# -- batches against the kernels, groups with null keys, errors


def random_masks(n=40, h=500, w=500, seed=5):
    r = np.random.default_rng(seed)
    out = [k.zeros(h, w), k.zeros(0, 5), k.complement(k.zeros(h, w)), None]
    for _ in range(n):
        p = np.repeat(np.repeat(r.random((25, 25)) < r.random() ** 2, 20, axis=0), 20, axis=1)
        p[r.integers(0, h, 50), r.integers(0, w, 50)] ^= True
        out.append(k.from_dense(p))
    return out


def test_flat_measures_of_large_masks():
    many = random_masks()
    flat = masks.Flat(masks.to_arrow(many))
    at = 0
    for i, m in enumerate(many):
        s, e = k.intervals(m) if m is not None else (np.empty(0), np.empty(0))
        n = int((flat.owner == i).sum())
        assert n == len(s) and flat.start[at : at + n].tolist() == s.tolist() and flat.end[at : at + n].tolist() == e.tolist()
        at += n


def test_batched_columns(spark):
    many = [m for m in random_masks(8) if m is None or m.h == 500]
    rows = [(i, m and (m.h, m.w, m.counts.tolist()), n and (n.h, n.w, n.counts.tolist())) for i, (m, n) in enumerate(zip(many, many[1:] + many[:1]))]
    df = spark.createDataFrame(rows, f"id int, a {masks.MASK}, b {masks.MASK}")
    for r in df.select("id", "a", "b", masks.bbox("a").alias("box"), masks.overlap("a", "b").alias("common"), masks.runs("a").alias("runs"), F.size(masks.positions("a")).alias("n")).collect():
        a, b = many[r.id], (many[1:] + many[:1])[r.id]
        if a is None:
            assert r.box is None and r.common is None and r.runs is None
            continue
        assert tuple(r.box) == tuple(map(float, k.box_of(a))) and r.n == k.area(a)
        assert [tuple(x) for x in r.runs] == list(zip(*(x.tolist() for x in k.intervals(a))))
        assert r.common == (None if b is None else k.overlap(a, b))


def test_groups_with_null_keys_and_wrong_ordinals(spark):
    rows = [(None, 0, (2, 2, [1, 3])), (None, 1, (2, 2, [0, 2, 2])), (1, 0, (2, 2, [4])), (1, 0, (2, 2, [2, 1, 1]))]
    df = spark.createDataFrame(rows, f"k int, o int, mask {masks.MASK}")
    assert {r.k: r.mask.counts for r in sweep.union_groups(df, ["k"]).collect()} == {None: [0, 4], 1: [2, 1, 1]}
    assert {r.k: r.iou for r in sweep.iou_groups(df, ["k"]).collect()} == {None: 0.25, 1: 0.0}
    good = df.filter("k IS NULL")
    assert sweep.custom_groups(good, ["k"], "o", lambda a, b: a != b, 2).first().mask.counts == [0, 1, 1, 2]
    for bad in (df.filter("k = 1"), df.filter("o = 0 AND k IS NULL")):
        with pytest.raises(Exception, match="ordinals"):
            sweep.custom_groups(bad, ["k"], "o", lambda a, b: a != b, 2).collect()


def test_suppression_of_repeated_ids(spark):
    nodes = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "id int")
    edges = spark.createDataFrame([(1, 2, 0.9), (1, 2, 0.9), (2, 3, 0.9)], "a int, b int, iou double")
    assert sorted(map(tuple, overlap.nms(nodes, edges, 0.5).collect()), key=str) == sorted([(1, True), (2, False), (2, False), (3, True), (None, True)], key=str)


def test_visible_by_layers(spark):
    r = np.random.default_rng(2)
    rows, front = [], np.full((2, 12), None, dtype=object)
    for i in range(30):
        p = r.random(12) < 0.3
        g, d = int(i % 2), int(r.integers(0, 3))
        m = k.from_intervals(3, 4, *(np.flatnonzero(np.diff(np.concatenate([[0], p, [0]])) == s) for s in (1, -1)))
        rows.append((g, i, d, (m.h, m.w, m.counts.tolist())))
        for q in np.flatnonzero(p):
            front[g, q] = min(x for x in (front[g, q], (d, i)) if x is not None)
    df = spark.createDataFrame(rows, f"g int, id int, d int, mask {masks.MASK}")
    for parts in (1, 3):
        got = np.full((2, 12), None, dtype=object)
        for x in overlap.visible(df, ["g"], "id", F.col("d"), parts=parts).select("g", "id", masks.positions("mask").alias("at")).collect():
            for q in x["at"]:
                assert got[x.g, q] is None
                got[x.g, q] = x.id
        assert got.tolist() == [[None if v is None else v[1] for v in row] for row in front.tolist()]


def test_polygons_against_traced_outlines():
    """Every step of an outline on the fine grid that crosses a column's middle toggles the column from there on; steps traced one by one with fractions."""
    from fractions import Fraction
    from math import floor

    r = np.random.default_rng(4)
    half = Fraction(1, 2)
    for _ in range(60):
        xy = r.uniform(-3, 25, 2 * int(r.integers(3, 7)))
        fine = [(int(x * 5 + 0.5), int(y * 5 + 0.5)) for x, y in xy.reshape(-1, 2)]
        bits = np.zeros((20, 22), dtype=bool)
        for (x0, y0), (x1, y1) in zip(fine, fine[1:] + fine[:1]):
            flat = abs(x1 - x0) >= abs(y1 - y0)
            (x0, y0), (x1, y1) = sorted([(x0, y0), (x1, y1)], key=lambda p: p if flat else (p[1], p[0]))
            if (x0, y0) == (x1, y1):
                continue
            steps = range(max(abs(x1 - x0), abs(y1 - y0)) + 1)
            trace = [(x0 + t, floor(y0 + Fraction(y1 - y0, x1 - x0) * t + half)) if flat else (floor(x0 + Fraction(x1 - x0, y1 - y0) * t + half), y0 + t) for t in steps]
            for (u, v), (u2, v2) in zip(trace, trace[1:]):
                if u != u2 and min(u, u2) % 5 == 2 and 0 <= min(u, u2) // 5 < 22:
                    row = min(max(-((2 - min(v, v2)) // 5), 0), 20)
                    bits[row:, min(u, u2) // 5] ^= True
        assert k.from_polygon(xy.tolist(), 20, 22).counts.tolist() == k.from_dense(bits).counts.tolist()


def line_items(spark, path, shift):
    """A table of 60 line items in 6 orders from shift on, as the box queries read it."""
    r = np.random.default_rng(8)
    data = [(shift + i // 10, int(r.integers(0, 20)), int(r.integers(0, 20)), i % 7 + 1, float(r.integers(1, 51))) for i in range(60)]
    spark.createDataFrame(data, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.mark.parametrize("name, ids", [("from_bbox", ["id"]), ("iou_pairs", ["a", "b"]), ("iou_crowd", ["a", "b"]), ("nms", ["id"]), ("occlusion_visible", ["id"])])
def test_box_queries_with_ids_beyond_64_bits(spark, tmp_path, name, ids):
    """The ids of an order far on are greater by a constant, and nothing else changes."""
    shift = 9_000_000
    near, far = (catalog.QUERIES[name](spark, line_items(spark, tmp_path / str(s), s)) for s in (0, shift))
    assert dict(near.dtypes)[ids[0]] == "bigint" and dict(far.dtypes)[ids[0]] == "decimal(38,0)"

    def moved(row, by):
        row = row.asDict()
        more = {c: int(row[c]) + by * 10 * 1000000 * 10000 * 51 for c in ids} | ({"image": row["image"] + by // 10} if "image" in row else {})
        return sorted((row | more).items())

    expected = sorted(moved(r, shift) for r in near.collect())
    assert expected and expected == sorted(moved(r, 0) for r in far.collect())
    assert max(v for r in expected for c, v in r if c in ids) >= 1 << 63


def test_rectangles_circles_and_polygons_of_whole_batches(spark):
    """Drawn together they are what the kernels draw one by one; nulls stay null, but a null edge of a rectangle lies at zero."""
    r = np.random.default_rng(9)
    data = [(i, *(float(v) for v in r.uniform(-5, 25, 4).round(1)), [float(v) for v in r.uniform(-9, 30, 2 * int(r.integers(0, 7)))]) for i in range(300)]
    data += [(300, 0.0, 0.0, 22.0, 20.0, [1e5, 1.0, 3.0, 2.0, 5.0, 7.0]), (301, 3.0, 0.0, 4.0, 20.0, []), (302, None, 1.0, 4.0, 20.0, None)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, d double, xy array<double>").repartition(3)
    got = df.select("*", masks.from_bbox("a", "b", "c", "d", (20, 22)).alias("box"), masks.from_circle("a", "b", "c", (20, 22)).alias("circle"), masks.from_polygon("xy", (20, 22)).alias("polygon"), masks.from_circle("a", "b", "c", (0, 5)).alias("none")).collect()
    assert len(got) == len(data)
    for row in got:
        edge = lambda v, most: int(np.floor(min(max(v, 0.0), most) + 0.5))
        a, b = row["a"] or 0.0, row["b"]
        x0, x1, y0, y1 = edge(a, 22), edge(a + row["c"] if row["a"] is not None else 0.0, 22), edge(b, 20), edge(b + row["d"], 20)
        assert row["box"]["counts"] == k.from_bbox((x0, y0, x1 - x0, y1 - y0), 20, 22).counts.tolist()
        if row["a"] is None:
            assert row["circle"] is None and row["polygon"] is None
            continue
        assert row["circle"]["counts"] == k.from_circle(a, b, row["c"], 20, 22).counts.tolist()
        assert row["none"]["counts"] == []
        assert row["polygon"]["counts"] == k.from_polygon(row["xy"], 20, 22).counts.tolist()


def test_batches_of_polygons():
    r = np.random.default_rng(10)
    each = [r.uniform(-5, 40, 2 * int(n)) for n in r.integers(0, 9, 400)]
    owner, start, end = k.polygons(np.concatenate(each), np.cumsum([0, *map(len, each)]), 16, 20)
    for i, xy in enumerate(each):
        assert k.from_intervals(16, 20, start[owner == i], end[owner == i]).counts.tolist() == k.from_polygon(xy, 16, 20).counts.tolist()
