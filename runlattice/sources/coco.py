"""Masks in JSON lines of the COCO format: {"id": ..., "size": [h, w], "counts": "..." or [...]}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.functions import masks


def read_coco(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """id, mask of each line; counts is a COCO string or an array of runs; a broken string gives a null mask."""
    rows = spark.read.schema(f"id {id_type}, size array<int>, counts string").json(path)
    size = F.col("size")
    listed = F.col("counts").startswith("[")
    plain = F.when(listed, F.from_json("counts", "array<int>"))
    return rows.select("id", F.coalesce(masks.from_counts(plain, size[0], size[1]), masks.from_coco(F.when(~listed, F.col("counts")), size[0], size[1])).alias("mask"))


def write_coco(df: DataFrame, path: str, id_column: str = "id", mask: str = "mask") -> None:
    """One JSON line per mask with its COCO string."""
    d = masks.to_dict(mask)
    df.select(F.col(id_column).alias("id"), d["size"].alias("size"), d["counts"].alias("counts")).write.json(path)


def coco_masks(boxes: str | None = None, polygons: str | None = None, counts: str | None = None, strings: str | None = None, imshape: tuple[int, int] = (0, 0)) -> object:
    """A mask column from whichever of the given columns isn't null: box struct, polygon, runs, COCO string."""
    h, w = imshape
    parts = []
    if boxes:
        b = F.col(boxes)
        parts.append(F.when(b.isNotNull(), masks.from_bbox(b["x"], b["y"], b["w"], b["h"], imshape)))
    if polygons:
        parts.append(masks.from_polygon(polygons, imshape))
    if counts:
        parts.append(masks.from_counts(counts, h, w))
    if strings:
        parts.append(masks.from_coco(strings, h, w))
    return F.coalesce(*parts)
