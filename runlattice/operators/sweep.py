"""Aggregates over groups of masks by a sweep over linear positions.

Each foreground interval adds its weight where it starts and takes it back where it ends. Sums per (group, position) are combined before the
shuffle, which bounds a group to its extent's positions, however many masks it has; the rest is a running sum over these.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlattice.functions import kernels, masks

Decide = Callable[[Column, Column], Column]


def states(df: DataFrame, keys: Sequence[str], mask: str = "mask", weight: Column | int | float = 1) -> tuple[DataFrame, Window]:
    """Per group and position where a run starts or ends: __total (weights of the masks set from there on), __n and __all (masks of the group, sum of all weights), extent; and the window of a group.

    Counts travel with the positions, so null keys are groups like others and nothing is joined.
    """
    m = F.col(mask)
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    rows = df.select(*keys, m["h"].alias("__h"), m["w"].alias("__w"), weight.alias("__k"), masks.runs(mask).alias("__runs")).filter("__h IS NOT NULL")
    nothing = F.col("__k") * 0
    mark = lambda at, by, n, k: F.struct(at.alias("at"), by.alias("by"), n.alias("n"), k.alias("k"))
    marks = F.flatten(F.transform("__runs", lambda r: F.array(mark(r["s"], F.col("__k"), F.lit(0), nothing), mark(r["e"], -F.col("__k"), F.lit(0), nothing))))
    marked = rows.select(*keys, "__h", "__w", F.explode(F.concat(F.array(mark(F.lit(0), nothing, F.lit(1), F.col("__k"))), marks)).alias("__m"))
    one = F.assert_true((F.min("__h") == F.max("__h")) & (F.min("__w") == F.max("__w")), F.lit("masks differ in extent"))
    sums = marked.groupBy(*keys, F.col("__m.at").alias("__at")).agg(F.sum("__m.by").alias("__by"), F.sum("__m.n").alias("__n"), F.sum("__m.k").alias("__all"), F.when(one.isNull(), F.max("__h")).alias("__h"), F.max("__w").alias("__w"))
    order = Window.partitionBy(*keys).orderBy("__at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)  # the count stands at position 0, the first of each group
    return sums.withColumns({"__total": F.sum("__by").over(upto), "__n": F.sum("__n").over(upto), "__all": F.sum("__all").over(upto)}), order


def merge_groups(df: DataFrame, keys: Sequence[str], mask: str = "mask", weight: Column | int | float = 1, decide: Decide = lambda total, n: total >= 1, out: str = "mask", whole: tuple[int, int] | None = None) -> DataFrame:
    """One mask per group: foreground where decide(sum of the weights of the masks set there, masks of the group).

    Masks of a group must have one extent. A group of masks without foreground gives decide(0, n) everywhere. Null masks don't count. whole: the number of masks and
    sum of weights that every group must have, else an error is raised.
    """
    keys = list(keys)
    rows, order = states(df, keys, mask, weight)
    if whole:
        right = F.assert_true((F.col("__n") == whole[0]) & (F.col("__all") == whole[1]), F.lit(f"a group must have {whole[0]} masks with ordinals from 0 on"))
        rows = rows.withColumn("__total", F.when(right.isNull(), F.col("__total")))
    state = rows.withColumn("__on", decide(F.col("__total"), F.col("__n")) & (F.col("__at") < F.col("__h") * F.col("__w")))
    turned = state.withColumn("__turn", F.col("__on") != F.lag("__on", 1, False).over(order))
    ends = turned.groupBy(*keys).agg(F.max("__h").alias("__h"), F.max("__w").alias("__w"), F.array_sort(F.collect_list(F.when(F.col("__turn"), F.col("__at")))).alias("__ends"))
    return ends.select(*keys, from_turns("__h", "__w", "__ends").alias(out))


def from_turns(h: str, w: str, turns: str) -> Column:
    """A mask from the sorted positions where the state changes, background before the first."""
    n = F.col(h) * F.col(w)
    inside = F.filter(turns, lambda p: p < n)
    counts = F.zip_with(F.concat(inside, F.array(n)), F.concat(F.array(F.lit(0)), inside), lambda e, s: e - s)
    return masks.make(F.col(h), F.col(w), F.when(n > 0, counts).otherwise(F.array()))


def from_positions(df: DataFrame, keys: Sequence[str], h: str, w: str, at: str, out: str = "mask") -> DataFrame:
    """One mask per group of foreground positions (at); groups without any don't appear."""
    got = df.groupBy(*keys).agg(F.max(h).alias("__h"), F.max(w).alias("__w"), F.array_sort(F.collect_set(at)).alias("__p"))
    p = F.col("__p")
    starts = F.filter(p, lambda v, i: (i == 0) | (F.get(p, i - 1) != v - 1))
    ends = F.transform(F.filter(p, lambda v, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != v + 1)), lambda v: v + 1)
    return got.withColumn("__t", F.flatten(F.zip_with(starts, ends, lambda s, e: F.array(s, e)))).select(*keys, from_turns("__h", "__w", "__t").alias(out))


def union_groups(df: DataFrame, keys: Sequence[str], mask: str = "mask") -> DataFrame:
    return merge_groups(df, keys, mask)


def intersection_groups(df: DataFrame, keys: Sequence[str], mask: str = "mask") -> DataFrame:
    return merge_groups(df, keys, mask, decide=lambda total, n: total == n)


def xor_groups(df: DataFrame, keys: Sequence[str], mask: str = "mask") -> DataFrame:
    return merge_groups(df, keys, mask, decide=lambda total, n: total % 2 == 1)


def count_groups(df: DataFrame, keys: Sequence[str], threshold: int, mask: str = "mask") -> DataFrame:
    """Foreground where at least threshold masks are set."""
    return merge_groups(df, keys, mask, decide=lambda total, n: total >= threshold)


def weighted_groups(df: DataFrame, keys: Sequence[str], weight: Column, threshold: float, mask: str = "mask") -> DataFrame:
    """Foreground where the weights of the set masks reach threshold; weights of integers or decimals add up exactly."""
    return merge_groups(df, keys, mask, weight=weight, decide=lambda total, n: total >= threshold)


def custom_groups(df: DataFrame, keys: Sequence[str], ordinal: str, function: Callable[..., object], arity: int, mask: str = "mask") -> DataFrame:
    """Any function of the arity masks of a group, told apart by ordinal 0 to arity - 1; tabulated here, looked up by Spark. Groups with other ordinals raise."""
    table = F.array(*[F.lit(bool(v)) for v in kernels.truth_table(function, arity)])
    weight = F.expr(f"shiftleft(1L, {ordinal})")
    return merge_groups(df, keys, mask, weight=weight, decide=lambda total, n: F.get(table, total.cast("int")), whole=(arity, (1 << arity) - 1))


def iou_groups(df: DataFrame, keys: Sequence[str], mask: str = "mask") -> DataFrame:
    """Per group: pixels set in all masks over pixels set in any; 0 where none is set in all."""
    rows, order = states(df, keys, mask)
    length = F.coalesce(F.lead("__at").over(order), F.col("__h") * F.col("__w")) - F.col("__at")
    over = rows.withColumn("__length", length).groupBy(*keys).agg(F.sum(F.when(F.col("__total") == F.col("__n"), F.col("__length"))).alias("__all"), F.sum(F.when(F.col("__total") > 0, F.col("__length"))).alias("__any"))
    return over.select(*keys, F.when(F.col("__all") > 0, F.col("__all") / F.col("__any")).otherwise(0.0).alias("iou"))


def fold_groups(df: DataFrame, keys: Sequence[str], ordinal: str, functions: Sequence[str | int], arity: int, mask: str = "mask") -> DataFrame:
    """Left fold of the arity masks of a group in order of ordinal (0 to arity - 1), compiled to one truth table."""
    tables = [kernels.BOOL_FUNCS[f] if isinstance(f, str) else f & 15 for f in functions]
    steps = tables * (arity - 1) if len(tables) == 1 else tables

    def fold(*bits: bool) -> bool:
        value = bits[0]
        for b, t in zip(bits[1:], steps):
            value = bool(t >> (2 * value + b) & 1)
        return value

    return custom_groups(df, keys, ordinal, fold, arity, mask)
