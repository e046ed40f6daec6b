"""Every operator as a query over the driver's tables, with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.functions import kernels, masks
from runlattice.operators import overlap, sweep
from runlattice.plans import datasets
from runlattice.plans import pixel_sql as px
from runlattice.sources import png

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def of_mask(name: str, function: Callable[[Column], Column], sql: str | None = None) -> None:
    """A query of mask to mask over emb8: id, counts."""
    add(name, lambda s, d: datasets.emb8(s, d).select("id", masks.counts_string(function(F.col("mask"))).alias("counts")), sql)


def measure(name: str, columns: Callable[[Column], list[Column]], sql: str, where: str = "true") -> None:
    add(name, lambda s, d: datasets.emb8(s, d).filter(where if where == "true" else F.expr(where)).select("id", *columns(F.col("mask"))), f"WITH {px.EMB8} {sql}")


def emb8_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = datasets.emb8(spark, sf_dir)
    two = one.select((F.col("id") - 1).alias("id"), F.col("mask").alias("mask2"))
    return one.join(two, "id")


def extent(h: int, w: int) -> str:
    return f"SELECT id, {h} AS h, {w} AS w FROM b"


# -- sources, codecs, accessors

of_mask("encode_counts", lambda m: m, px.counts("SELECT id, x, y FROM e"))
add("encode_act", lambda s, d: datasets.act(s, d).select("id", masks.counts_string("mask").alias("counts")), px.counts("SELECT id, x, y FROM e", "SELECT id, 24 AS h, 7 AS w FROM b", px.ACT))
add("from_bbox", lambda s, d: datasets.box(s, d).select("id", masks.counts_string("mask").alias("counts")), px.counts("SELECT id, x, y FROM e", "SELECT id, 48 AS h, 64 AS w FROM b", px.box()))
add(
    "from_circle",
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), masks.counts_string(masks.from_circle((F.col("p_partkey") % 20).cast("double"), (F.col("p_size") % 16).cast("double"), (1 + F.col("p_partkey") % 7) + F.lit(0.5), (16, 20))).alias("counts")),
    px.counts("SELECT id, x, y FROM b, (SELECT unnest(range(0, 20)) AS x), (SELECT unnest(range(0, 16)) AS y) WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) < r * r", "SELECT id, 16 AS h, 20 AS w FROM b", "b AS (SELECT p_partkey AS id, p_partkey % 20 AS cx, p_size % 16 AS cy, 1.5 + p_partkey % 7 AS r FROM part)"),
)
add("from_counts_row_major", lambda s, d: datasets.emb8(s, d).select("id", masks.counts_string(masks.from_counts(F.col("mask")["counts"], F.lit(8), F.lit(8), order="C")).alias("counts")), px.counts("SELECT id, y AS x, x AS y FROM e"))
add("zeros_ones", lambda s, d: datasets.emb8(s, d).select("id", masks.counts_string(masks.zeros((3, 4))).alias("zeros"), masks.counts_string(masks.ones(imsize=(4, 3))).alias("ones"), masks.counts_string(masks.zeros_like("mask")).alias("zeros_like"), masks.counts_string(masks.ones_like("mask")).alias("ones_like")), "SELECT vec_id AS id, '12' AS zeros, '0,12' AS ones, '64' AS zeros_like, '0,64' AS ones_like FROM embeddings")
of_mask("coco_roundtrip", lambda m: masks.from_coco(masks.coco_string(m), 8, 8), px.counts("SELECT id, x, y FROM e"))
of_mask("zlib_roundtrip", lambda m: masks.from_coco(masks.inflate(masks.coco_zlib(m)), 8, 8), px.counts("SELECT id, x, y FROM e"))
of_mask("dict_roundtrip", lambda m: masks.from_dict(masks.to_dict(m, 6), "zcounts"), px.counts("SELECT id, x, y FROM e"))
of_mask("png_roundtrip", lambda m: png.from_png(png.to_png(m), 128), px.counts("SELECT id, x, y FROM e"))
add("to_array", lambda s, d: datasets.emb8(s, d).select("id", F.array_join(masks.to_array("mask", 7).cast("array<string>"), "").alias("pixels")), f"WITH {px.EMB8} SELECT id, string_agg(CASE WHEN e.id IS NULL THEN '0' ELSE '7' END, '' ORDER BY x * 8 + y) AS pixels FROM b CROSS JOIN g LEFT JOIN e USING (id, x, y) GROUP BY id")
add(
    "decode_into",
    lambda s, d: datasets.emb8(s, d).select("id", F.array_join(masks.decode_into("mask", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: p % 5), 9).cast("array<string>"), "").alias("pixels")),
    f"WITH {px.EMB8} SELECT id, string_agg(CASE WHEN e.id IS NULL THEN ((x * 8 + y) % 5)::VARCHAR ELSE '9' END, '' ORDER BY x * 8 + y) AS pixels FROM b CROSS JOIN g LEFT JOIN e USING (id, x, y) GROUP BY id",
)
add("pixels", lambda s, d: overlap.pixels(datasets.emb8(s, d).select("id", "mask")).select("id", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y")), f"WITH {px.EMB8} SELECT id, x, y FROM e")

# -- measures

measure("area", lambda m: [masks.area(m).alias("area")], "SELECT id, count(e.x) AS area FROM b LEFT JOIN e USING (id) GROUP BY id")
measure("any_all", lambda m: [masks.any_set(m).alias("any_set"), masks.all_set(m).alias("all_set")], "SELECT id, count(e.x) > 0 AS any_set, count(e.x) = 64 AS all_set FROM b LEFT JOIN e USING (id) GROUP BY id")
measure("density", lambda m: [F.round(masks.density(m), 6).alias("density")], "SELECT id, round((1 + coalesce(sum((v <> f)::INT), 0)) / 64.0, 6)::DOUBLE AS density FROM (SELECT id, v, lag(v, 1, 0) OVER (PARTITION BY id ORDER BY pos) AS f FROM (SELECT b.id, g.x * 8 + g.y AS pos, (e.id IS NOT NULL)::INT AS v FROM b CROSS JOIN g LEFT JOIN e ON e.id = b.id AND e.x = g.x AND e.y = g.y)) GROUP BY id")
#: Every third mask gets a run too many, every third a run without pixels inside.
BROKEN = "CASE id % 3 WHEN 1 THEN concat(mask.counts, array(1)) WHEN 2 THEN concat(slice(mask.counts, 1, 1), array(0), slice(mask.counts, 2, 64)) ELSE mask.counts END"
add("is_valid", lambda s, d: datasets.emb8(s, d).select("id", masks.is_valid(masks.make(F.lit(8), F.lit(8), F.expr(BROKEN))).alias("valid")), "SELECT vec_id AS id, vec_id % 3 = 0 AS valid FROM embeddings")
measure("get_pixel", lambda m: [masks.get_pixel(m, 2, 3).alias("p"), masks.get_pixel(m, -1, -2).alias("q")], "SELECT id, coalesce(bool_or(x = 3 AND y = 2), false) AS p, coalesce(bool_or(x = 6 AND y = 7), false) AS q FROM b LEFT JOIN e USING (id) GROUP BY id")
measure("bbox", lambda m: [masks.bbox(m)[c].alias(c) for c in "xywh"], "SELECT id, coalesce(min(x), 0)::DOUBLE AS x, coalesce(min(y), 0)::DOUBLE AS y, coalesce(max(x) - min(x) + 1, 0)::DOUBLE AS w, coalesce(max(y) - min(y) + 1, 0)::DOUBLE AS h FROM b LEFT JOIN e USING (id) GROUP BY id")
add("centroid", lambda s, d: datasets.emb8(s, d).filter(masks.any_set("mask")).select("id", *[F.round(masks.centroid("mask")[c], 6).alias("c" + c) for c in "xy"]), f"WITH {px.EMB8} SELECT id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM e GROUP BY id")
measure("raw_moments", lambda m: [masks.moments(m)[f"m{i}{j}"].alias(f"m{i}{j}") for i in range(4) for j in range(4 - i)], "SELECT id, " + ", ".join(f"coalesce(sum(x ** {i} * y ** {j}), 0)::DOUBLE AS m{i}{j}" for i in range(4) for j in range(4 - i)) + " FROM b LEFT JOIN e USING (id) GROUP BY id")
CENTRAL = [(2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3)]
#: Raw moments as exact integers, and central ones times the area to the power of their order less one.
MU_SQL = f"WITH {px.EMB8}, r AS (SELECT id, count(*)::HUGEINT AS a, " + ", ".join(f"sum(x ** {i} * y ** {j})::HUGEINT AS m{i}{j}" for i in range(4) for j in range(4 - i) if i + j) + (
    " FROM e GROUP BY id), mu AS (SELECT id, a, m20 * a - m10 * m10 AS c20, m11 * a - m10 * m01 AS c11, m02 * a - m01 * m01 AS c02, m30 * a * a - 3 * m10 * m20 * a + 2 * m10 * m10 * m10 AS c30, "
    "m21 * a * a - 2 * m10 * m11 * a - m01 * m20 * a + 2 * m10 * m10 * m01 AS c21, m12 * a * a - 2 * m01 * m11 * a - m10 * m02 * a + 2 * m01 * m01 * m10 AS c12, m03 * a * a - 3 * m01 * m02 * a + 2 * m01 * m01 * m01 AS c03 FROM r)"
)
add("central_moments", lambda s, d: datasets.emb8(s, d).filter(masks.any_set("mask")).select("id", masks.moments("mask").alias("m")).select("id", *[F.col(f"m.mu{i}{j}").alias(f"mu{i}{j}") for i, j in CENTRAL]), MU_SQL + " SELECT id, " + ", ".join(f"c{i}{j}::DOUBLE / (a{' * a' * (i + j - 2)})::DOUBLE AS mu{i}{j}" for i, j in CENTRAL) + " FROM mu")
HU_SQL = MU_SQL + ", h AS (SELECT id, a::DOUBLE AS a, c20 + c02 AS h1, c20 - c02 AS d, c11 AS e, c30 + c12 AS p, c21 + c03 AS q, c30 - 3 * c12 AS s, 3 * c21 - c03 AS t FROM mu)"
HU = ["h1 / a ** 3", "(d * d + 4 * e * e) / a ** 6", "(s * s + t * t) / a ** 9", "(p * p + q * q) / a ** 9", "(s * p * (p * p - 3 * q * q) + t * q * (3 * p * p - q * q))::DOUBLE / a ** 18", "(d * (p * p - q * q) + 4 * e * p * q) / a ** 12", "(t * p * (p * p - 3 * q * q) - s * q * (3 * p * p - q * q))::DOUBLE / a ** 18"]
add("hu_moments", lambda s, d: datasets.emb8(s, d).filter(masks.any_set("mask")).select("id", masks.hu_moments("mask").alias("v")).select("id", *[(F.round(F.col("v")[i], 6) + 0.0).alias(f"hu{i + 1}") for i in range(7)]), HU_SQL + " SELECT id, " + ", ".join(f"round({x}, 6) + 0.0 AS hu{i + 1}" for i, x in enumerate(HU)) + " FROM h")
EDGE = "SELECT e.id, e.x, e.y FROM e LEFT JOIN (SELECT id, x, y FROM (SELECT id, x + 1 AS x, y FROM e UNION ALL SELECT id, x - 1, y FROM e UNION ALL SELECT id, x, y + 1 FROM e UNION ALL SELECT id, x, y - 1 FROM e) GROUP BY id, x, y HAVING count(*) = 4) AS c ON c.id = e.id AND c.x = e.x AND c.y = e.y WHERE c.id IS NULL"
measure("perimeter", lambda m: [masks.perimeter(m).alias("perimeter")], f"SELECT b.id, count(c.x) AS perimeter FROM b LEFT JOIN ({EDGE}) AS c USING (id) GROUP BY b.id")

add(
    "to_array_rows",
    lambda s, d: datasets.emb8(s, d).select("id", F.array_join(masks.to_array(masks.crop("mask", 0, 0, 5, 3), 7, order="C").cast("array<string>"), "").alias("pixels")),
    f"WITH {px.EMB8} SELECT id, string_agg(CASE WHEN e.id IS NULL THEN '0' ELSE '7' END, '' ORDER BY y * 8 + x) AS pixels FROM b CROSS JOIN (SELECT * FROM g WHERE x < 5 AND y < 3) LEFT JOIN e USING (id, x, y) GROUP BY id",
)
add(
    "decode_channels",
    lambda s, d: datasets.emb8(s, d).select("id", F.array_join(masks.decode_channels("mask", F.sequence(F.lit(0), F.lit(191)), [7, 8, 9]), " ").alias("pixels")),
    f"WITH {px.EMB8} SELECT id, string_agg(CASE WHEN e.id IS NULL THEN (x * 8 + y) * 3 + c ELSE 7 + c END, ' ' ORDER BY x * 8 + y, c) AS pixels FROM b CROSS JOIN g CROSS JOIN (VALUES (0), (1), (2)) AS k(c) LEFT JOIN e USING (id, x, y) GROUP BY id",
)
add(
    "equal",
    lambda s, d: emb8_pairs(s, d).select("id", masks.equal("mask", F.when(F.col("id") % 2 == 0, F.col("mask")).otherwise(F.col("mask2"))).alias("same"), masks.equal("mask", masks.make(F.lit(4), F.lit(16), F.col("mask.counts"))).alias("other_shape")),
    f"WITH {px.EMB8}{px.PAIR} SELECT id, id % 2 = 0 OR sum(abs(a - c)) = 0 AS same, false AS other_shape FROM i GROUP BY id",
)
of_mask("pad_sides", lambda m: masks.pad_sides(m, [3, 0, 1, 2]), px.counts("SELECT id, x + 3 AS x, y + 1 AS y FROM e", "SELECT id, 11 AS h, 11 AS w FROM b"))
add("tight_box", lambda s, d: datasets.emb8(s, d).select("id", masks.tight_crop_and_box("mask").alias("t")).select("id", masks.area("t.mask").alias("area"), *[F.col(f"t.box.{c}").alias(c) for c in "xywh"]), f"WITH {px.EMB8} SELECT id, count(e.x) AS area, coalesce(min(x), 0)::DOUBLE AS x, coalesce(min(y), 0)::DOUBLE AS y, coalesce(max(x) - min(x) + 1, 0)::DOUBLE AS w, coalesce(max(y) - min(y) + 1, 0)::DOUBLE AS h FROM b LEFT JOIN e USING (id) GROUP BY id")

# -- boolean algebra

of_mask("complement", masks.complement, px.counts("SELECT id, x, y FROM n"))
for _name in ("union", "intersection", "difference", "xor", "nor", "nand", "xnor", "implication"):
    add("pair_" + _name, lambda s, d, f=_name: emb8_pairs(s, d).select("id", masks.counts_string(masks.merge("mask", "mask2", f)).alias("counts")), px.pair(kernels.BOOL_FUNCS[_name]))
add("merge_any_function", lambda s, d: emb8_pairs(s, d).select("id", *[masks.counts_string(masks.merge("mask", "mask2", t)).alias(f"t{t}") for t in (2, 5, 13)]), "SELECT * FROM " + " JOIN ".join(f"(SELECT id, counts AS t{t} FROM ({px.pair(t)})) AS q{t}{'' if t == 2 else ' USING (id)'}" for t in (2, 5, 13)))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = emb8_pairs(spark, sf_dir)
    return rows.join(rows.select((F.col("id") - 1).alias("id"), F.col("mask2").alias("mask3")), "id")


def triple_sql(condition: str) -> str:
    """a, c, f: the bits of masks id, id + 1 and id + 2."""
    return px.counts(f"SELECT i.id, i.x, i.y FROM i JOIN b2 AS m ON m.id = i.id + 1 LEFT JOIN e AS e3 ON e3.id = i.id + 2 AND e3.x = i.x AND e3.y = i.y WHERE {condition.replace('f', '(e3.id IS NOT NULL)::INT')}", "SELECT id, 8 AS h, 8 AS w FROM b2 WHERE id + 1 IN (SELECT id FROM b2)", px.EMB8 + px.PAIR)


THREE = ["mask", "mask2", "mask3"]
for _name, _function, _sql in (
    ("custom_3ary", lambda: masks.merge_custom(THREE, lambda a, b, c: (a and not b) or (c and not a)), "(a = 1 AND c = 0) OR (f = 1 AND a = 0)"),
    ("fold_mixed", lambda: masks.merge_many(THREE, ["difference", "nand"]), "NOT ((a = 1 AND c = 0) AND f = 1)"),
    ("merge_count_columns", lambda: masks.merge_count(THREE, 2), "a + c + f >= 2"),
    ("weighted_atleast", lambda: masks.merge_weighted(THREE, [0.5, 0.25, 0.75], 0.75), "2 * a + c + 3 * f >= 3"),
):
    add(_name, lambda s, d, f=_function: triples(s, d).select("id", masks.counts_string(f()).alias("counts")), triple_sql(_sql))


def by_label(name: str, function: Callable[[DataFrame], DataFrame], condition: str) -> None:
    add(name, lambda s, d: function(datasets.emb8(s, d)).select(F.col("label").cast("bigint").alias("id"), masks.counts_string("mask").alias("counts")), px.groups(condition).replace("SELECT id, CASE", "SELECT id::BIGINT AS id, CASE"))


by_label("union_agg", lambda df: sweep.union_groups(df, ["label"]), "k >= 1")
by_label("intersection_agg", lambda df: sweep.intersection_groups(df, ["label"]), "k = n")
by_label("xor_agg", lambda df: sweep.xor_groups(df, ["label"]), "k % 2 = 1")
by_label("merge_count", lambda df: sweep.count_groups(df, ["label"], 20), "k >= 20")
by_label("nor_agg", lambda df: sweep.merge_groups(df, ["label"], decide=lambda total, n: total == 0), "k = 0")
by_label("weighted_agg", lambda df: sweep.weighted_groups(df, ["label"], F.col("id") % 3 + 1, 45), "s >= 45")


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.emb8(spark, sf_dir).withColumns({"grp": F.expr("id div 4"), "ord": F.expr("cast(id % 4 as int)")})
    whole = rows.groupBy("grp").agg(F.count("*").alias("n")).filter("n = 4").select("grp")
    return rows.join(whole, "grp")


def quad_sql(condition: str) -> str:
    return px.counts(
        f"SELECT grp AS id, x, y FROM (SELECT v.grp, g.x, g.y, max((e.id % 4 = 0)::INT) AS a, max((e.id % 4 = 1)::INT) AS c, max((e.id % 4 = 2)::INT) AS d, max((e.id % 4 = 3)::INT) AS f FROM (SELECT id // 4 AS grp FROM b GROUP BY 1 HAVING count(*) = 4) AS v CROSS JOIN g LEFT JOIN e ON e.id // 4 = v.grp AND e.x = g.x AND e.y = g.y GROUP BY v.grp, g.x, g.y) WHERE {condition}",
        "SELECT id // 4 AS id, 8 AS h, 8 AS w FROM b GROUP BY 1 HAVING count(*) = 4",
    )


def coalesced(text: str) -> str:
    return " ".join(f"coalesce({t}, 0)" if t in "acdf" else t for t in text.split())


add("custom_agg", lambda s, d: sweep.custom_groups(quads(s, d), ["grp"], "ord", lambda a, b, c, d: (a != b) and not (c and d), 4).select(F.col("grp").alias("id"), masks.counts_string("mask").alias("counts")), quad_sql(coalesced("a <> c AND NOT ( d = 1 AND f = 1 )")))
add("fold_agg", lambda s, d: sweep.fold_groups(quads(s, d), ["grp"], "ord", ["difference"], 4).select(F.col("grp").alias("id"), masks.counts_string("mask").alias("counts")), quad_sql(coalesced("a = 1 AND c = 0 AND d = 0 AND f = 0")))

# -- geometry

of_mask("crop", lambda m: masks.crop(m, 2, 1, 4, 5), px.counts("SELECT id, x - 2 AS x, y - 1 AS y FROM e WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 5", extent(5, 4)))
of_mask("crop_by_row", lambda m: masks.crop_by(m, F.expr("cast(id % 3 as int)"), F.expr("cast(id % 2 as int)"), F.lit(5), F.lit(6)), px.counts("SELECT id, x - id % 3 AS x, y - id % 2 AS y FROM e WHERE x BETWEEN id % 3 AND id % 3 + 4 AND y BETWEEN id % 2 AND id % 2 + 5", extent(6, 5)))
of_mask("tight_crop", masks.tight_crop, px.counts("SELECT e.id, e.x - t.x0 AS x, e.y - t.y0 AS y FROM e JOIN (SELECT id, min(x) AS x0, min(y) AS y0 FROM e GROUP BY id) AS t USING (id)", "SELECT id, coalesce(max(y) - min(y) + 1, 0) AS h, coalesce(max(x) - min(x) + 1, 0) AS w FROM b LEFT JOIN e USING (id) GROUP BY id"))
of_mask("pad_const0", lambda m: masks.pad(m, 1, 2, 3, 0), px.counts("SELECT id, x + 3 AS x, y + 1 AS y FROM e", extent(11, 11)))
of_mask("pad_const1", lambda m: masks.pad(m, 1, 2, 3, 0, value=1), px.counts("SELECT id, x, y FROM b, (SELECT unnest(range(0, 11)) AS x), (SELECT unnest(range(0, 11)) AS y) EXCEPT SELECT id, x + 3, y + 1 FROM n", extent(11, 11)))
of_mask("pad_edge", lambda m: masks.pad(m, 2, 1, 1, 2, border="edge"), px.counts("SELECT id, px AS x, py AS y FROM e JOIN (SELECT unnest(range(0, 11)) AS px) ON e.x = greatest(0, least(7, px - 1)) JOIN (SELECT unnest(range(0, 11)) AS py) ON e.y = greatest(0, least(7, py - 2))", extent(11, 11)))
of_mask("shift", lambda m: masks.shift(m, 2, -1), px.counts("SELECT id, x - 1 AS x, y + 2 AS y FROM e WHERE x >= 1 AND y <= 5"))
of_mask("shift_border1", lambda m: masks.shift(m, -1, 3, border=1), px.counts("SELECT id, x, y FROM b, g EXCEPT SELECT id, x + 3, y - 1 FROM n"))
of_mask("flipud", masks.flipud, px.counts("SELECT id, x, 7 - y AS y FROM e"))
of_mask("fliplr", masks.fliplr, px.counts("SELECT id, 7 - x AS x, y FROM e"))
of_mask("transpose", masks.transpose, px.counts("SELECT id, y AS x, x AS y FROM e"))
of_mask("rot90", lambda m: masks.rot90(m, 1), px.counts("SELECT id, y AS x, 7 - x AS y FROM e"))
of_mask("rot180", lambda m: masks.rot90(m, 2), px.counts("SELECT id, 7 - x AS x, 7 - y AS y FROM e"))
of_mask("rot270", lambda m: masks.rot90(m, 3), px.counts("SELECT id, 7 - y AS x, x AS y FROM e"))
of_mask("tile", lambda m: masks.tile(m, 2, 3), px.counts("SELECT id, x + 8 * i AS x, y + 8 * j AS y FROM e, (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 2)) AS j)", extent(16, 24)))
of_mask("repeat", lambda m: masks.repeat(m, 2, 3), px.counts("SELECT id, x * 3 + i AS x, y * 2 + j AS y FROM e, (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 2)) AS j)", extent(16, 24)))
add("hconcat", lambda s, d: emb8_pairs(s, d).select("id", masks.counts_string(masks.hconcat(["mask", "mask2"])).alias("counts")), px.counts("SELECT id, x, y FROM e WHERE id IN (SELECT id FROM b2) UNION ALL SELECT id, x + 8, y FROM e2", "SELECT id, 8 AS h, 16 AS w FROM b2", px.EMB8 + px.PAIR))
add("vconcat", lambda s, d: emb8_pairs(s, d).select("id", masks.counts_string(masks.vconcat(["mask", "mask2"])).alias("counts")), px.counts("SELECT id, x, y FROM e WHERE id IN (SELECT id FROM b2) UNION ALL SELECT id, x, y + 8 FROM e2", "SELECT id, 16 AS h, 8 AS w FROM b2", px.EMB8 + px.PAIR))
add("hconcat_agg", lambda s, d: overlap.hconcat_groups(quads(s, d), ["grp"], "ord").select(F.col("grp").alias("id"), masks.counts_string("mask").alias("counts")), px.counts("SELECT id // 4 AS id, x + 8 * (id % 4) AS x, y FROM e WHERE id // 4 IN (SELECT id // 4 FROM b GROUP BY 1 HAVING count(*) = 4)", "SELECT id // 4 AS id, 8 AS h, 32 AS w FROM b GROUP BY 1 HAVING count(*) = 4"))
of_mask("slice_stride", lambda m: masks.part(m, slice(1, 8, 3), slice(0, 7, 2)), px.counts("SELECT id, x // 2 AS x, (y - 1) // 3 AS y FROM e WHERE x < 7 AND x % 2 = 0 AND y >= 1 AND (y - 1) % 3 = 0", extent(3, 4)))
of_mask("slice_negative", lambda m: masks.part(m, slice(None, None, -1), slice(6, 1, -2)), px.counts("SELECT id, (6 - x) // 2 AS x, 7 - y AS y FROM e WHERE x IN (6, 4, 2)", extent(8, 3)))
of_mask("put_pixel", lambda m: masks.put(m, 3, -1, 1), px.counts("SELECT id, x, y FROM e UNION SELECT id, 7, 3 FROM b"))
of_mask("set_region", lambda m: masks.put_part(m, slice(2, 6), slice(1, 4), 1), px.counts("SELECT id, x, y FROM e UNION SELECT id, x, y FROM b, g WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 3"))
add("set_region_mask", lambda s, d: emb8_pairs(s, d).select("id", masks.counts_string(masks.put_part("mask", slice(2, 6), slice(1, 4), masks.crop("mask2", 0, 0, 3, 4))).alias("counts")), px.counts("SELECT id, x, y FROM e WHERE id IN (SELECT id FROM b2) AND NOT (y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 3) UNION SELECT id, x + 1, y + 2 FROM e2 WHERE x < 3 AND y < 4", "SELECT id, 8 AS h, 8 AS w FROM b2", px.EMB8 + px.PAIR))
of_mask("fill_rectangle", lambda m: masks.fill_rectangle(m, 2, 3, 4, 2, 1), px.counts("SELECT id, x, y FROM e UNION SELECT id, x, y FROM b, g WHERE x BETWEEN 2 AND 5 AND y BETWEEN 3 AND 4"))
of_mask("fill_circle", lambda m: masks.fill_circle(m, 3.5, 4.0, 2.6, 0), px.counts("SELECT id, x, y FROM e WHERE (x - 3.5) ** 2 + (y - 4.0) ** 2 >= 2.6 * 2.6"))

# -- resampling and pooling

of_mask("resize_up", lambda m: masks.resize(m, (20, 12)), px.counts(px.remapped((2.5, 0, 20), (1.5, 0, 12)), extent(20, 12)))
of_mask("resize_down", lambda m: masks.resize(m, (5, 3)), px.counts(px.remapped((0.625, 0, 5), (0.375, 0, 3)), extent(5, 3)))
of_mask("resize_factors", lambda m: masks.resize(m, None, 1.5, 0.5), px.counts(px.remapped((0.5, 0, 4), (1.5, 0, 12)), extent(4, 12)))
of_mask("warp_translate", lambda m: masks.warp_affine(m, [1, 0, 2, 0, 1, -1], 8, 10), px.counts("SELECT id, x + 2 AS x, y - 1 AS y FROM e WHERE y >= 1", extent(8, 10)))
of_mask("warp_scale", lambda m: masks.warp_affine(m, [2, 0, 1, 0, 3, -2], 20, 18), px.counts(px.remapped((3, -2, 20), (2, 1, 18)), extent(20, 18)))
of_mask("warp_rotate", lambda m: masks.warp_affine(m, [0, 1, 0, -1, 0, 8], 8, 8), px.counts("SELECT id, y AS x, 7 - x AS y FROM e"))
of_mask("warp_perspective_scale", lambda m: masks.warp_perspective(m, [4, 0, 0, 0, 4, 0, 0, 0, 2], 16, 16), px.counts("SELECT id, 2 * x + i AS x, 2 * y + j AS y FROM e, (VALUES (0), (1)) AS i(i), (VALUES (0), (1)) AS j(j)", extent(16, 16)))


def sampled_back(x: str, y: str, h: int, w: int) -> str:
    """Destination pixels whose middle (u, v) lies, mapped back by x and y, in a foreground pixel."""
    return px.counts(f"SELECT e.id, d.dx AS x, d.dy AS y FROM (SELECT *, ceil({x}) - 1 AS sx, ceil({y}) - 1 AS sy FROM (SELECT *, dx + 0.5::DOUBLE AS u, dy + 0.5::DOUBLE AS v FROM (SELECT unnest(range(0, {w})) AS dx), (SELECT unnest(range(0, {h})) AS dy))) AS d JOIN e ON e.x = d.sx AND e.y = d.sy", extent(h, w))


HOMOGRAPHY = [1.2, 0.1, 0.3, 0.05, 1.1, 0.2, 0.01, 0.02, 1.0]
_i = [f"({v!r}::DOUBLE)" for v in np.linalg.inv(np.reshape(HOMOGRAPHY, (3, 3))).ravel().tolist()]
_row = lambda r: f"({_i[3 * r]} * u + {_i[3 * r + 1]} * v + {_i[3 * r + 2]})"
of_mask("warp_perspective", lambda m: masks.warp_perspective(m, HOMOGRAPHY, 10, 10), sampled_back(f"{_row(0)} / {_row(2)}", f"{_row(1)} / {_row(2)}", 10, 10))
_det = "(0.9::DOUBLE * 0.9::DOUBLE + 0.4::DOUBLE * 0.4::DOUBLE)"
of_mask("warp_affine_shear", lambda m: masks.warp_affine(m, [0.9, -0.4, 3.0, 0.4, 0.9, 0.0], 12, 12), sampled_back(f"(0.9::DOUBLE * (u - 3) + 0.4::DOUBLE * v) / {_det}", f"(0.9::DOUBLE * v - 0.4::DOUBLE * (u - 3)) / {_det}", 12, 12))
EYE = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
of_mask("warp_distorted", lambda m: masks.warp_distorted(m, EYE, EYE, [8.0, 0, 4, 0, 8, 4, 0, 0, 1], [8.0, 0, 4, 0, 8, 4, 0, 0, 1], [-0.2, 0.05] + [0.0] * 10, [0.0] * 12, 8, 8))
of_mask("max_pool", masks.max_pool2x2, px.counts(px.blocks(1), extent(4, 4)))
of_mask("min_pool", masks.min_pool2x2, px.counts(px.blocks(4), extent(4, 4)))
of_mask("avg_pool", masks.avg_pool2x2, px.counts(px.blocks(2), extent(4, 4)))
of_mask("avg_pool_valid", lambda m: masks.avg_pool2d_valid(m, 3, 2, 2, 1), px.counts(px.blocks(3, 3, 2, 2, 1), extent(3, 7)))
of_mask("conv_valid", lambda m: masks.conv2d_valid(m, [[-1.0, 0.0, 1.0], [0.5, 2.0, -0.5]], 1, 1, 1.0), px.counts("SELECT id, ox AS x, oy AS y FROM e JOIN (VALUES (0, 0, -2), (2, 0, 2), (0, 1, 1), (1, 1, 4), (2, 1, -1)) AS k(dx, dy, v) ON true JOIN g AS o(ox, oy) ON e.x = ox + dx AND e.y = oy + dy AND ox <= 5 AND oy <= 6 GROUP BY id, ox, oy HAVING sum(v) >= 2", extent(7, 6)))

# -- morphology

FOUR = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
EIGHT = list(product((-1, 0, 1), repeat=2))
ROUND5 = [(x, y) for x, y in product(range(-2, 3), repeat=2) if abs(x) + abs(y) < 4]
of_mask("dilate_vertical", lambda m: masks.dilate_vertical(m, 2, 1), px.counts(px.dilated("e", [(0, d) for d in (-2, -1, 0, 1)])))
of_mask("dilate4", lambda m: masks.dilate3x3(m, 4), px.counts(px.dilated("e", FOUR)))
of_mask("dilate8", lambda m: masks.dilate3x3(m, 8), px.counts(px.dilated("e", EIGHT)))
of_mask("erode4", lambda m: masks.erode3x3(m, 4), px.counts(px.eroded("n", FOUR)))
of_mask("erode8", lambda m: masks.erode3x3(m, 8), px.counts(px.eroded("n", EIGHT)))
of_mask("dilate5x5", masks.dilate5x5, px.counts(px.dilated("e", ROUND5)))
of_mask("erode5x5", masks.erode5x5, px.counts(px.eroded("n", ROUND5)))
for _shape in ("circle", "square", "diamond", "cross"):
    _inside = {"circle": lambda x, y: x * x + y * y <= 4, "square": lambda x, y: True, "diamond": lambda x, y: abs(x) + abs(y) <= 2, "cross": lambda x, y: x == 0 or y == 0}[_shape]
    _offsets = [(x, y) for x, y in product(range(-2, 3), repeat=2) if _inside(x, y)]
    of_mask(f"dilate_{_shape}", lambda m, s=_shape: masks.dilate(m, s, 5), px.counts(px.dilated("e", _offsets)))
    of_mask(f"erode_{_shape}", lambda m, s=_shape: masks.erode(m, s, 5), px.counts(px.eroded("n", _offsets)))


def two_steps(first: str, second_background: bool, offsets: list[tuple[int, int]]) -> str:
    """Opening (erode, then dilate) or closing (dilate, then erode)."""
    if not second_background:
        return px.counts(px.dilated("f", offsets), base=px.EMB8 + f", f AS ({first})")
    return px.counts(px.eroded("f2", offsets), base=px.EMB8 + f", f AS ({first}), f2 AS (SELECT id, x, y FROM b, g EXCEPT SELECT id, x, y FROM f)")


of_mask("opening", masks.opening, two_steps(px.eroded("n", FOUR), False, FOUR))
of_mask("closing", masks.closing, two_steps(px.dilated("e", FOUR), True, FOUR))
of_mask("opening2", masks.opening2, two_steps(px.eroded("n", ROUND5), False, ROUND5))
of_mask("closing2", masks.closing2, two_steps(px.dilated("e", ROUND5), True, ROUND5))
of_mask("contours", masks.contours, px.counts(EDGE))

# -- overlap

add("overlap_pair", lambda s, d: emb8_pairs(s, d).select("id", masks.overlap("mask", "mask2").alias("common"), F.round(masks.iou("mask", "mask2"), 6).alias("iou")), f"WITH {px.EMB8}{px.PAIR} SELECT id, sum(a * c)::BIGINT AS common, round(coalesce(sum(a * c) / nullif(sum(greatest(a, c)), 0), 0), 6)::DOUBLE AS iou FROM i GROUP BY id")
add("iou_nway", lambda s, d: sweep.iou_groups(quads(s, d), ["grp"]).select(F.col("grp").alias("id"), F.round("iou", 6).alias("iou")), f"WITH {px.EMB8}, v AS (SELECT id // 4 AS id FROM b GROUP BY 1 HAVING count(*) = 4), c AS (SELECT id // 4 AS id, x, y, count(*) AS k FROM e GROUP BY ALL) SELECT v.id, round(coalesce(count(*) FILTER (k = 4) / nullif(count(c.k), 0), 0), 6)::DOUBLE AS iou FROM v LEFT JOIN c USING (id) GROUP BY v.id")
#: Orders whose lines are the boxes of one image, so images are as many as the table is long.
ORDERS = 10
BOX_PAIRS = f"WITH {px.box(ORDERS)}, m AS (SELECT p.image, p.id AS a, q.id AS b, count(*) AS common FROM e AS p JOIN e AS q ON p.image = q.image AND p.x = q.x AND p.y = q.y AND p.id < q.id GROUP BY ALL), s AS (SELECT id, count(*) AS area FROM e GROUP BY id)"


def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = datasets.box(spark, sf_dir, ORDERS)
    return overlap.iou_pairs(boxes, boxes, ["image"], ("id", "id"), same=True, cell=16).select("image", "a", "b", "common", F.round("iou", 6).alias("iou"))


add("iou_pairs", box_pairs, BOX_PAIRS + " SELECT image, a, b, common, round(common / (s.area + t.area - common), 6)::DOUBLE AS iou FROM m JOIN s ON s.id = a JOIN s AS t ON t.id = b")


def crowd_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = datasets.box(spark, sf_dir, ORDERS)
    left, right = boxes.filter("depth % 2 = 1"), boxes.filter("depth % 2 = 0").withColumn("crowd", F.col("depth") == 2)
    return overlap.iou_pairs(left, right, ["image"], ("id", "id"), crowd="crowd", cell=16).select("image", "a", "b", F.round("iou", 6).alias("iou"))


add("iou_crowd", crowd_pairs, f"WITH {px.box(ORDERS)}, m AS (SELECT p.image, p.id AS a, q.id AS b, q.depth AS d, count(*) AS common FROM e AS p JOIN e AS q ON p.image = q.image AND p.x = q.x AND p.y = q.y AND p.depth % 2 = 1 AND q.depth % 2 = 0 GROUP BY ALL), s AS (SELECT id, count(*) AS area FROM e GROUP BY id) SELECT image, a, b, round(common / CASE WHEN d = 2 THEN s.area ELSE s.area + t.area - common END, 6)::DOUBLE AS iou FROM m JOIN s ON s.id = a JOIN s AS t ON t.id = b")
add(
    "bbox_iou",
    lambda s, d: emb8_pairs(s, d).select("id", masks.bbox("mask").alias("a"), masks.bbox(masks.crop("mask2", 0, 0, 5, 5)).alias("b")).select("id", F.round(masks.bbox_iou("a", "b"), 6).alias("iou")),
    f"WITH {px.EMB8}{px.PAIR}, p AS (SELECT id, min(x) AS x, min(y) AS y, max(x) + 1 AS u, max(y) + 1 AS v FROM e GROUP BY id), q AS (SELECT id, min(x) AS x, min(y) AS y, max(x) + 1 AS u, max(y) + 1 AS v FROM e2 WHERE x < 5 AND y < 5 GROUP BY id), t AS (SELECT id, (least(p.u, q.u) - greatest(p.x, q.x)) AS w, (least(p.v, q.v) - greatest(p.y, q.y)) AS h, (p.u - p.x) * (p.v - p.y) + (q.u - q.x) * (q.v - q.y) AS s FROM b2 LEFT JOIN p USING (id) LEFT JOIN q USING (id)) SELECT id, round(CASE WHEN w > 0 AND h > 0 THEN w * h / (s - w * h) ELSE 0 END, 6)::DOUBLE AS iou FROM t",
)


def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = datasets.box(spark, sf_dir, ORDERS)
    pairs = overlap.iou_pairs(boxes, boxes, ["image"], ("id", "id"), same=True, cell=16)
    return overlap.nms(boxes.select("id"), pairs, 0.2)


add("nms", suppressed, px.recursive(BOX_PAIRS + ", h AS (SELECT b AS id, list(a) AS earlier FROM m JOIN s ON s.id = a JOIN s AS t ON t.id = b WHERE common / (s.area + t.area - common) > 0.2 GROUP BY b), o AS (SELECT image, id, row_number() OVER (PARTITION BY image ORDER BY id) AS k, coalesce(earlier, []) AS earlier FROM b LEFT JOIN h USING (id)), r AS (SELECT image, k, [id] AS kept FROM o WHERE k = 1 UNION ALL SELECT o.image, o.k, CASE WHEN list_has_any(r.kept, o.earlier) THEN r.kept ELSE list_append(r.kept, o.id) END FROM r JOIN o ON o.image = r.image AND o.k = r.k + 1), f AS (SELECT image, arg_max(kept, k) AS kept FROM r GROUP BY image) SELECT o.id, list_contains(f.kept, o.id) AS kept FROM o JOIN f USING (image)"))
add("occlusion_visible", lambda s, d: overlap.visible(datasets.box(s, d, ORDERS), ["image"], "id", F.col("depth")).select("image", "id", masks.area("mask").alias("area"), masks.counts_string("mask").alias("counts")), None)
ORACLES["occlusion_visible"] = px.counts("SELECT id, x, y FROM f", "SELECT DISTINCT id, 48 AS h, 64 AS w FROM f", px.box(ORDERS) + ", f AS (SELECT image, x, y, arg_min(id, struct_pack(a := depth, b := id)) AS id FROM e GROUP BY image, x, y)").replace("SELECT id, CASE WHEN size", "SELECT b.image, id, (SELECT count(*) FROM f WHERE f.id = y.id) AS area, CASE WHEN size").replace("AS counts FROM y", "AS counts FROM y JOIN b USING (id)")
add("label_map_merge", lambda s, d: overlap.merge_to_label_map(datasets.box(s, d, ORDERS, with_id=False), ["image"], "depth").select("image", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "label"), f"WITH {px.box(ORDERS)} SELECT image, x, y, (max(depth) + 1)::INT AS label FROM e GROUP BY image, x, y")
add(
    "label_map_split",
    lambda s, d: overlap.from_label_map(s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: F.when(v > 0.5, 2).when(v > 0, 1).otherwise(0)).alias("labels")), ["id"], "labels", 8, 8).select((F.col("id") * 10 + F.col("label")).alias("id"), masks.counts_string("mask").alias("counts")),
    px.counts("SELECT id * 10 + label AS id, x, y FROM f", "SELECT DISTINCT id * 10 + label AS id, 8 AS h, 8 AS w FROM f", px.EMB8 + ", f AS (SELECT vec_id AS id, x, y, CASE WHEN embedding[x * 8 + y + 1] > 0.5 THEN 2 ELSE 1 END AS label FROM embeddings, g WHERE embedding[x * 8 + y + 1] > 0)"),
)

# -- components

for _c in (4, 8):
    add(f"cc_count{_c}", lambda s, d, c=_c: datasets.emb8(s, d).select("id", masks.count_components("mask", c).cast("bigint").alias("n")), px.recursive(f"WITH {px.EMB8}{px.reach('e', _c)} SELECT b.id, count(a.root) AS n FROM b LEFT JOIN a USING (id) GROUP BY b.id"))
add("cc_stats", lambda s, d: overlap.component_stats(datasets.emb8(s, d), ["id"], min_size=2).select("id", "area", *[F.col(c).cast("bigint").alias(c) for c in "xywh"], F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy")), px.recursive(f"WITH {px.EMB8}{px.reach('e', 4)} SELECT id, area, x, y, w, h, round(cx, 6) AS cx, round(cy, 6) AS cy FROM a WHERE area >= 2"))
add("cc_masks", lambda s, d: overlap.components(datasets.emb8(s, d), ["id"], connectivity=8).select((F.col("id") * 64 + F.col("comp")).alias("id"), masks.counts_string("mask").alias("counts")), px.recursive(px.counts("SELECT id * 64 + comp AS id, x, y FROM c JOIN (SELECT id, root, row_number() OVER (PARTITION BY id ORDER BY root) - 1 AS comp FROM a) AS k USING (id, root)", "SELECT id * 64 + row_number() OVER (PARTITION BY id ORDER BY root) - 1 AS id, 8 AS h, 8 AS w FROM a", px.EMB8 + px.reach("e", 8))))
add("cc_filtered", lambda s, d: overlap.components(datasets.emb8(s, d), ["id"], where="area >= 3 AND w > h").select("id", F.col("area"), masks.counts_string("mask").alias("counts")).groupBy("id").agg(F.count("*").alias("n"), F.sum("area").alias("area")), px.recursive(f"WITH {px.EMB8}{px.reach('e', 4)} SELECT id, count(*) AS n, sum(area)::BIGINT AS area FROM a WHERE area >= 3 AND w > h GROUP BY id"))
of_mask("largest_component", masks.largest_component, px.recursive(px.counts("SELECT c.id, c.x, c.y FROM c JOIN (SELECT id, arg_min(root, -area * 1000 + root) AS root FROM a GROUP BY id) AS t USING (id, root)", base=px.EMB8 + px.reach("e", 4))))
of_mask("remove_small", lambda m: masks.remove_small(m, 3), px.recursive(px.counts("SELECT c.id, c.x, c.y FROM c JOIN a USING (id, root) WHERE a.area >= 3", base=px.EMB8 + px.reach("e", 4))))
of_mask("fill_holes", lambda m: masks.fill_holes(m, 3, 8), px.recursive(px.counts("SELECT id, x, y FROM b, g EXCEPT SELECT c.id, c.x, c.y FROM c JOIN a USING (id, root) WHERE a.area >= 3", base=px.EMB8 + px.reach("n", 8))))

# -- rectangles and polygons

RECTANGLES = "r AS (SELECT x0, x1, y0, y1 FROM (SELECT unnest(range(0, 8)) AS x0), (SELECT unnest(range(1, 9)) AS x1), (SELECT unnest(range(0, 8)) AS y0), (SELECT unnest(range(1, 9)) AS y1) WHERE x1 > x0 AND y1 > y0)"
add("lir_area", lambda s, d: datasets.emb8(s, d).select("id", masks.largest_rectangle("mask").alias("r")).select("id", (F.col("r.w") * F.col("r.h")).alias("area")), f"WITH {px.EMB8}, {RECTANGLES}, v AS (SELECT e.id, x0, x1, y0, y1 FROM e JOIN r ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY e.id, x0, x1, y0, y1 HAVING count(*) = (x1 - x0) * (y1 - y0)) SELECT b.id, coalesce(max((x1 - x0) * (y1 - y0)), 0)::DOUBLE AS area FROM b LEFT JOIN v USING (id) GROUP BY b.id")
add("lir_aspect", lambda s, d: datasets.emb8(s, d).select("id", masks.largest_rectangle("mask", 1.5).alias("r")).select("id", F.round(F.col("r.w") * F.col("r.h"), 6).alias("area")), f"WITH {px.EMB8}, {RECTANGLES}, v AS (SELECT e.id, x0, x1, y0, y1 FROM e JOIN r ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY e.id, x0, x1, y0, y1 HAVING count(*) = (x1 - x0) * (y1 - y0)) SELECT b.id, round(coalesce(max(least((x1 - x0) ** 2 / 1.5, (y1 - y0) ** 2 * 1.5)), 0), 6)::DOUBLE AS area FROM b LEFT JOIN v USING (id) GROUP BY b.id")
add("lir_around", lambda s, d: datasets.emb8(s, d).select("id", masks.largest_rectangle_around("mask", 3.0, 4.0).alias("r")).select("id", (F.col("r.w") * F.col("r.h")).alias("area")), f"WITH {px.EMB8}, {RECTANGLES}, v AS (SELECT e.id, x0, x1, y0, y1 FROM e JOIN r ON x0 + x1 = 7 AND y0 + y1 = 9 AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY e.id, x0, x1, y0, y1 HAVING count(*) = (x1 - x0) * (y1 - y0)) SELECT b.id, coalesce(max((x1 - x0) * (y1 - y0)), 0)::DOUBLE AS area FROM b LEFT JOIN v USING (id) GROUP BY b.id")
#: The corners lie on whole pixels, so on multiples of five on the fine grid; a column's middle is between the fine places 5c + 2 and 5c + 3.
POLYGON = """
k1 AS (SELECT p_partkey AS id, [[10, 5], [70, 15], [5 * (p_partkey % 12 + 3), 65], [15, 5 * (p_size % 9 + 5)]] AS k FROM part),
k2 AS (SELECT id, k[i] AS a, k[1 + i % 4] AS b FROM k1, (SELECT unnest(range(1, 5)) AS i)),
k3 AS (SELECT id, least(a, b) AS l, greatest(a, b) AS r FROM k2),
k4 AS (SELECT id, c, 5 * c + 2 AS u, l[1] AS x, l[2] AS y, r[1] - l[1] AS dx, r[2] - l[2] AS dy FROM k3, (SELECT unnest(range(0, 20)) AS c) WHERE 5 * c + 2 >= l[1] AND 5 * c + 3 <= r[1]),
k5 AS (SELECT id, c, CASE WHEN dx >= abs(dy) THEN least(floor(y + dy * (u - x) / dx::DOUBLE + 0.5), floor(y + dy * (u + 1 - x) / dx::DOUBLE + 0.5))
  WHEN dy > 0 THEN list_max(list_filter(range(0, 200), lambda v: v BETWEEN y AND y + dy AND floor(x + dx * (v - y) / dy::DOUBLE + 0.5) <= u))
  ELSE list_max(list_filter(range(0, 200), lambda v: v BETWEEN y + dy AND y AND floor(x + dx + dx * (v - y - dy) / dy::DOUBLE + 0.5) > u)) END AS v FROM k4),
k6 AS (SELECT id, c, ceil((v - 2) / 5.0)::BIGINT AS r FROM k5),
f AS (SELECT id, c AS x, y FROM k6, (SELECT unnest(range(0, 16)) AS y) WHERE r <= y GROUP BY id, c, y HAVING count(*) % 2 = 1)
"""


def quadrangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = [F.lit(float(v)) for v in (2, 1, 14, 3)] + [(F.col("p_partkey") % 12 + 3).cast("double"), F.lit(13.0), F.lit(3.0), (F.col("p_size") % 9 + 5).cast("double")]
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), masks.counts_string(masks.from_polygon(F.array(*corners), (16, 20))).alias("counts"))


add("from_polygon", quadrangles, px.counts("SELECT id, x, y FROM f", "SELECT p_partkey AS id, 16 AS h, 20 AS w FROM part", POLYGON))


def label_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: per label the union of its masks, and how much of it a mask covers on average."""
    rows = datasets.emb8(spark, sf_dir)
    whole = sweep.union_groups(rows, ["label"]).select("label", masks.area("mask").alias("union_area"))
    per = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(masks.area("mask")).alias("total"))
    return per.join(whole, "label").select(F.col("label").cast("bigint").alias("label"), "n", "union_area", F.round(F.col("total") / F.col("n") / F.col("union_area"), 6).alias("avg_iou"))


add("label_unions", label_unions, f"WITH {px.EMB8}, u AS (SELECT label, count(*) AS union_area FROM (SELECT DISTINCT label, x, y FROM e JOIN b USING (id)) GROUP BY label), t AS (SELECT label, count(DISTINCT b.id) AS n, count(e.x) AS total FROM b LEFT JOIN e USING (id) GROUP BY label) SELECT label::BIGINT AS label, n, union_area, round(total / n / union_area, 6)::DOUBLE AS avg_iou FROM t JOIN u USING (label)")
