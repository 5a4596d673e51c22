"""Running sums, ranks and exact quantiles over any number of values without one task over all of them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelens.staging import stage


def _cuts(grouped: DataFrame, value: str) -> list[float]:
    """Approximate quantiles of all values, at least as many as there are shuffle partitions."""
    n = max(32, int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = F.array(*(F.lit(i / n) for i in range(1, n)))
    row = grouped.agg(F.percentile_approx(value, probs, F.lit(50 * n))).first()
    return sorted(set(row[0] or []))


def _place(value: Column, cuts: Sequence[float], first: int) -> Column:
    """How many cuts lie below the value, by bisection, counted from ``first``."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    upper = _place(value, cuts[half + 1 :], first + half + 1)
    return F.when(value > F.lit(cuts[half]), upper).otherwise(_place(value, cuts[:half], first))


def running(grouped: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """``grouped`` with, for each column of ``sums``, its running sum cum_* in the order of ``value`` and its whole all_*.

    ``grouped`` has each value once (in each group of ``by``). Values are cut at approximate quantiles over all groups, so that
    no task gets more than about 1/n of them, however skewed they are and however large a group is; the cuts are a few numbers
    and are worked out first, so that every use sees the same ones. A range's sums begin with the totals of the ranges before it.
    """
    cuts = _cuts(grouped, value)
    below = _place(F.col(value), cuts, 0)
    celled = grouped.withColumn("_cell", -below if descending else below)
    totals = celled.groupBy(*by, "_cell").agg(*(F.sum(c).alias(c) for c in sums))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = totals.select(
        *(F.col(b).alias(f"_by{i}") for i, b in enumerate(by)),
        F.col("_cell").alias("_at"),
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums),
        *(F.sum(c).over(whole).alias(f"all_{c}") for c in sums),
    )
    order = F.desc(value) if descending else F.asc(value)
    inside = Window.partitionBy(*by, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col("_cell") == F.col("_at"), *(F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by))]
    summed = [(F.col(f"_before_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in sums]
    return celled.join(offsets, same).select(*grouped.columns, *summed, *(f"all_{c}" for c in sums))


#: Relative rank error of the brackets around exact quantiles.
_ERROR = 1e-5


def _brackets(df: DataFrame, probs: Sequence[float], by: Sequence[str]) -> list[tuple]:
    """(by..., place, share, low, high, below): for each group and quantile the position to find, and bounds that hold it.

    The bounds are approximate quantiles a little to either side; they are checked by counting, and opened where they miss.
    """
    spread = [min(1.0, max(0.0, p + d * _ERROR)) for p in probs for d in (-3, 3)]
    near = F.percentile_approx("v", F.array(*map(F.lit, spread)), F.lit(int(1 / _ERROR)))
    groups = df.groupBy(*by).agg(F.count("*").alias("n"), near.alias("near")).collect()
    guesses = [(*(g[b] for b in by), i, g["near"][2 * i], g["near"][2 * i + 1], g["n"]) for g in groups if g["n"] for i in range(len(probs))]
    if not guesses:
        return []
    found = []
    types = [df.schema[b] for b in by]
    schema = T.StructType([*(T.StructField(f"_by{j}", t.dataType) for j, t in enumerate(types)), *(T.StructField(c, T.DoubleType() if c in ("low", "high") else T.LongType()) for c in ("i", "low", "high", "n"))])
    local = df.sparkSession.createDataFrame(guesses, schema)
    same = [F.col(b).eqNullSafe(F.col(f"_by{j}")) for j, b in enumerate(by)]
    met = df.join(F.broadcast(local), same) if by else df.crossJoin(F.broadcast(local))  # a row a group and quantile
    counted = met.groupBy(*(f"_by{j}" for j in range(len(by))), "i").agg(
        F.count_if(F.col("v") < F.col("low")).alias("below"), F.count_if(F.col("v") <= F.col("high")).alias("upto")
    ).collect()
    held = {tuple(c[f"_by{j}"] for j in range(len(by))) + (c["i"],): (c["below"], c["upto"]) for c in counted}
    for *group, i, low, high, n in guesses:
        at = probs[i] * (n - 1)
        below, upto = held[(*group, i)]
        if not (below <= math.floor(at) and math.ceil(at) < upto):
            low, high, below = -math.inf, math.inf, 0
        found.append((*group, i, math.floor(at) - below, at - math.floor(at), low, high))
    return found


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q array<double>): exact quantiles with linear interpolation; nulls don't count.

    For few groups, such as columns or classes, whose brackets pass through the driver; a group without values has no row, and
    without ``by`` no values give one row of nulls. Only values near a quantile are sorted, about 6e-5 of all.
    """
    long = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    rows = _brackets(long, probs, by)
    types = [T.StructField(f"_by{j}", long.schema[b].dataType) for j, b in enumerate(by)]
    kinds = [("i", T.LongType()), ("place", T.LongType()), ("share", T.DoubleType()), ("low", T.DoubleType()), ("high", T.DoubleType())]
    local = df.sparkSession.createDataFrame(rows, T.StructType([*types, *(T.StructField(n, k) for n, k in kinds)]))
    same = [F.col(b).eqNullSafe(F.col(f"_by{j}")) for j, b in enumerate(by)]
    met = (long.join(F.broadcast(local), same) if by else long.crossJoin(F.broadcast(local))).where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
    counts = met.groupBy(*by, "i", "place", "share", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by, "i").orderBy("v"))
    placed = counts.withColumn("upto", upto)
    first, second = (F.min(F.when(F.col("upto") > F.col("place") + d, F.col("v"))) for d in (0, 1))
    each = placed.groupBy(*by, "i").agg(first.alias("a"), second.alias("b"), F.first("share").alias("share"))
    exact = F.col("a") + F.when(F.col("share") > 0, (F.col("b") - F.col("a")) * F.col("share")).otherwise(0.0)
    each = each.withColumn("exact", exact)
    return each.groupBy(*by).agg(F.array(*(F.max(F.when(F.col("i") == i, F.col("exact"))) for i in range(len(probs)))).alias("q"))


def quantiles_of(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(name, q array<double>): the same for several columns in one pass; a column without values has no row."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], list(columns), "name", "value")
    return quantiles(long, "value", probs, ["name"])


def positions(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with the position from 0 of each row in an order that must be total; sorted in ranges, one offset a range."""
    ranged = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranks")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    placed = ranged.withColumn("_at", within).join(F.broadcast(offsets), "_part")
    return placed.select(*df.columns, (F.col("_before") + F.col("_at")).alias(name))
