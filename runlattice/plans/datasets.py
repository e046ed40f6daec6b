"""Mask sets over the driver's tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.functions import masks
from runlattice.operators import sweep


def emb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, mask: the signs of each embedding's 64 numbers as an 8 by 8 mask."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), "label", masks.from_bits(F.transform("embedding", lambda v: v > 0), 8, 8).alias("mask"))


def act(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, mask: hours (rows) and weekdays (columns, Sunday first) in which a user has events."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id IS NOT NULL AND ts IS NOT NULL")
    at = ((F.dayofweek("ts") - 1) * 24 + F.hour("ts")).alias("at")
    return sweep.from_positions(rows.select(F.col("user_id").alias("id"), F.lit(24).alias("h"), F.lit(7).alias("w"), at), ["id"], "h", "w", "at")


def line_id(rows: DataFrame) -> Column:
    """One number of a line item's keys and quantity: a bigint, but a decimal(38,0) of the same value if the table's keys reach beyond 64 bits."""
    order, line, item, supplier, quantity = (F.col(c).cast("bigint") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    # (((order * 10 + line) * 1000000 + item) * 10000 + supplier) * 51 + quantity
    high, low, step = order * 10 + line, (item * 10000 + supplier) * 51 + quantity, 1000000 * 10000 * 51
    ends = rows.agg(*(f(c) for f in (F.min, F.max) for c in (high, low))).first()
    if all(h is None or l is None or -(1 << 63) <= h * step + l < 1 << 63 for h, l in (ends[:2], ends[2:])):
        return high * step + low
    return (high.cast("decimal(20,0)") * F.lit(Decimal(step)) + low.cast("decimal(20,0)")).cast("decimal(38,0)")


def box(spark: SparkSession, sf_dir: str, orders: int = 10, with_id: bool = True) -> DataFrame:
    """image, id, depth, mask: a rectangle for each line item in a frame of 48 rows and 64 columns."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x, y, w, h = F.col("l_partkey") % 40, F.col("l_suppkey") % 30, 1 + F.col("l_linenumber"), (1 + F.col("l_quantity").cast("bigint") % 12)
    image = F.floor(F.col("l_orderkey") / orders).alias("image")
    return rows.select(image, *([line_id(rows).alias("id")] if with_id else []), F.col("l_linenumber").alias("depth"), masks.from_bbox(x, y, w, h, (48, 64)).alias("mask"))
