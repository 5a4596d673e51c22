"""Relational building blocks that are generic over keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelens.operators.ranges import quantiles_of
from citelens.staging import stage

Keys = Sequence[str]


def mark_join(df: DataFrame, keys: DataFrame, on: Keys, name: str) -> DataFrame:
    """``df`` with 1 where its key is among ``keys`` and 0 elsewhere; a null key is never among them."""
    marked = keys.select(*on).distinct().withColumn("_mark", F.lit(1))
    return df.join(marked, list(on), "left").withColumn(name, F.coalesce("_mark", F.lit(0))).drop("_mark")


def keep_first(df: DataFrame, key: Keys, order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in an order that must be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_k(df: DataFrame, group: Keys, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark limits each partition's groups before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def quota(df: DataFrame, group: Keys, order: Sequence[Column], exempt: Column, n: int) -> DataFrame:
    """All exempt rows, and the first n others of each group; exempt rows take nothing from the quota.

    The others are cut to n in each partition before they are shuffled, so that no group is gathered.
    """
    others = top_k(df.where(~F.coalesce(exempt, F.lit(False))), group, order, n).drop("position")
    return df.where(exempt).unionByName(others)


def position_in_group(df: DataFrame, group: Keys, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with the positions from 0 of its rows in their groups, in an order that must be total.

    The rows are sorted in ranges of (group, order); a group that spans several ranges goes on where the earlier ones ended,
    so that a group of any size is never in one task.
    """
    ranged = stage(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "positions")
    held = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_part", *group).orderBy(*order)
    placed = ranged.withColumn("_at", F.row_number().over(here) - 1)
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = placed.join(before, same).withColumn(name, (F.col("_before") + F.col("_at")).cast("int"))
    return joined.select(*df.columns, name)


def impute_median(df: DataFrame, columns: Keys, zero: Keys = (), scope: Column | None = None) -> DataFrame:
    """Nulls of ``columns`` become the exact median over ``scope`` (all rows by default), or 0 if there is none.

    Nulls of ``zero`` become 0. The medians are one row, joined by broadcast.
    """
    base = df if scope is None else df.where(scope)
    known = quantiles_of(base, columns, [0.5])
    medians = known.agg(*(F.max(F.when(F.col("name") == c, F.get("q", 0))).alias(f"_median_{c}") for c in columns))
    filled = {c: F.coalesce(F.col(c).cast("double"), f"_median_{c}", F.lit(0.0)) for c in columns}
    filled |= {c: F.coalesce(c, F.lit(0)) for c in zero}
    return df.crossJoin(F.broadcast(medians)).withColumns(filled).drop(*(f"_median_{c}" for c in columns))


def out_of_group_mean(df: DataFrame, key: str, fold: str, target: str, m: float = 10.0) -> DataFrame:
    """(key, fold, encoded): the smoothed mean of the key's target outside the fold.

    The prior is the mean of all rows; a key that only stands in the fold gets the prior. Both sums are aggregates by key and
    fold, so that a hot key is reduced before any shuffle.
    """
    prior = df.agg(F.avg(target).alias("prior"))
    own = df.groupBy(key, fold).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    total = own.groupBy(key).agg(F.sum("s").alias("t"), F.sum("n").alias("all_n"))
    folds = df.select(fold).distinct()
    grid = total.crossJoin(F.broadcast(folds)).join(own, [key, fold], "left").crossJoin(F.broadcast(prior))
    rest_s = F.col("t") - F.coalesce("s", F.lit(0))
    rest_n = F.col("all_n") - F.coalesce("n", F.lit(0))
    return grid.select(key, fold, ((rest_s + F.col("prior") * m) / (rest_n + m)).alias("encoded"))


def concentration(df: DataFrame, key: str, ks: Sequence[int]) -> DataFrame:
    """The share of all rows that the k most frequent keys have, for each k."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("keys"))
    most = counts.orderBy(F.desc("n"), key).limit(max(ks))  # a report of the top k
    ranked = most.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), key)))
    shares = ranked.crossJoin(F.broadcast(total)).groupBy("total", "keys")
    parts = [F.sum(F.when(F.col("r") <= k, F.col("n"))).alias(f"top_{k}") for k in ks]
    return shares.agg(*parts).select("keys", *((F.col(f"top_{k}") / F.col("total")).alias(f"top_{k}_share") for k in ks))


def flag_audit(df: DataFrame, flags: Keys, target: str, restricted: Column) -> DataFrame:
    """(flag, rate_all, lift_all, rate_restricted, lift_restricted, distorted), in one pass.

    A lift is against its own population's mean; it is distorted where the two differ by more than 0.3 or lie on different
    sides of 1.
    """
    aggregates = [F.avg(target).alias("base"), F.avg(F.when(restricted, F.col(target))).alias("base_r")]
    for f in flags:
        on = F.col(f) == 1
        aggregates += [
            F.avg(F.when(on, F.col(target))).alias(f"{f}_a"),
            F.avg(F.when(on & restricted, F.col(target))).alias(f"{f}_r"),
        ]
    wide = df.agg(*aggregates)
    stacked = wide.select(
        "base",
        "base_r",
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(f).alias("flag"), F.col(f"{f}_a").alias("rate_all"), F.col(f"{f}_r").alias("rate_restricted"))
                    for f in flags
                )
            )
        ),
    )
    lifts = stacked.withColumn("lift_all", F.col("rate_all") / F.col("base")).withColumn(
        "lift_restricted", F.col("rate_restricted") / F.col("base_r")
    )
    far = F.abs(F.col("lift_all") - F.col("lift_restricted")) > 0.3
    sides = (F.col("lift_all") > 1) != (F.col("lift_restricted") > 1)
    return lifts.select("flag", "rate_all", "lift_all", "rate_restricted", "lift_restricted", (far | sides).cast("int").alias("distorted"))
