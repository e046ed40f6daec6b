"""Streams of masks: running aggregates per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.functions import masks


def covered_positions(stream: DataFrame, keys: Sequence[str], mask: str = "mask") -> DataFrame:
    """keys, h, w, at, n: how many masks of the stream so far cover each pixel; the state of a key is bounded by its extent.

    Run it in update or complete mode; ``sweep.from_positions`` over the rows with n >= 1 is the running union.
    """
    rows = stream.select(*keys, F.col(mask)["h"].alias("h"), F.col(mask)["w"].alias("w"), F.explode(masks.positions(mask)).alias("at"))
    return rows.groupBy(*keys, "h", "w", "at").agg(F.count("*").alias("n"))


def windowed_area(stream: DataFrame, time: str, window: str, late: str, keys: Sequence[str], mask: str = "mask") -> DataFrame:
    """Masks and their areas per window of event time; rows later than late are dropped."""
    rows = stream.withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("window"), *keys).agg(F.count("*").alias("n_masks"), F.sum(masks.area(mask)).alias("area"))
