"""Folds, splits and resampling. All randomness is a hash of (key, seed), so that results don't depend on partitions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelens.operators.ranges import positions
from citelens.operators.relational import position_in_group
from citelens.staging import stage


def hash_unit(*keys: Column | str | int) -> Column:
    """A number in [0, 1) from the keys."""
    cols = [F.lit(k) if isinstance(k, int) else k for k in keys]
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)).cast("double") / float(1 << 40)


def dense_ranks(df: DataFrame, column: str) -> DataFrame:
    """(column, rank): the distinct values by their rank in sorted order, from 0."""
    return positions(df.select(column).where(F.col(column).isNotNull()).distinct(), [column])


def rank_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): the groups dealt out in turn, in sorted order."""
    return dense_ranks(df, group).select(group, F.pmod("rank", F.lit(k)).cast("int").alias("fold"))


def _turns(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, list[int]]]:
    """(first, last, folds): how the greedy choice of the lightest fold goes over groups by falling size.

    ``sizes`` are (size, number of groups), largest first. Groups of one size go to the folds in turns; a stretch of equal turns is
    one row, so that there are at most a few rows a size however many groups it has. Group i of the order (from 0) within
    first <= i < last goes to folds[(i - first) % len(folds)].
    """
    loads = [0] * k
    out, at = [], 0
    for size, left in sizes:
        while left:
            trial, turn = loads.copy(), []
            while len(turn) < left and (f := trial.index(min(trial))) not in turn:
                turn.append(f)
                trial[f] += size
            times = left // len(turn)
            for f in set(range(k)) - set(turn):  # the turns end before a fold outside is the lightest
                room = loads[f] - loads[turn[0]]
                times = min(times, room // size if room % size or f > turn[0] else room // size - 1)
            times = max(1, times)
            n = times * len(turn)
            out.append((at, at + n, turn))
            for f in turn:
                loads[f] += times * size
            at, left = at + n, left - n
    return out


def balanced_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): groups by falling size, then in their order, each to the lightest fold; the first of equals.

    The driver sees how many groups each size has: N rows have fewer than sqrt(2 N) sizes. Groups find their turn by their
    position in the order, which is sorted in ranges. Null groups have no fold.
    """
    sizes = stage(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_size")), "fold-sizes")
    known = sizes.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("_size")).collect()
    starts, at = {}, 0
    for row in known:
        starts[row["_size"]] = at
        at += row["n"]
    turns = _turns([(r["_size"], r["n"]) for r in known], k)
    ends = sorted(starts.items(), key=lambda x: x[1])
    rows, i = [], 0
    for first, last, folds in turns:
        while i + 1 < len(ends) and ends[i + 1][1] <= first:
            i += 1
        rows.append((ends[i][0], first, last, folds))
    turns_ = df.sparkSession.createDataFrame(rows, "_size bigint, _first bigint, _last bigint, _folds array<int>")
    placed = positions(sizes, [F.desc("_size"), F.col(group)]).join(turns_, "_size")
    mine = placed.where((F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_last")))
    turn = F.pmod(F.col("rank") - F.col("_first"), F.size("_folds")).cast("int")
    return mine.select(group, F.get("_folds", turn).alias("fold"))


def group_holdout(df: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """``df`` with ``held`` 1 for the rows of about ``share`` of the groups."""
    return df.withColumn("held", (hash_unit(group, seed) < share).cast("int"))


def double_blocked(df: DataFrame, a: str, b: str, k: int, seed: int) -> DataFrame:
    """``df`` with fold_a and fold_b: fold f tests the rows with both equal f and trains on those with neither equal."""
    return df.withColumn("fold_a", F.floor(hash_unit(a, seed) * k).cast("int")).withColumn(
        "fold_b", F.floor(hash_unit(b, seed + 1) * k).cast("int")
    )


def shuffle_within(df: DataFrame, group: Sequence[str], key: str, value: str, seed: int, salt: Column | None = None) -> DataFrame:
    """``df`` with ``value`` permuted among the rows of each group; keys must be unique in a group, and groups not null."""
    order = F.xxhash64(key, F.lit(seed)) if salt is None else F.xxhash64(key, F.lit(seed), salt)
    here = position_in_group(df, group, [F.col(key)], "_p")
    there = position_in_group(df.select(*group, key, F.col(value).alias("_v")), group, [order, F.col(key)], "_p")
    return here.join(there.drop(key), [*group, "_p"]).drop(value, "_p").withColumnRenamed("_v", value)


def _poisson_steps() -> list[float]:
    """The cumulative probabilities of Poisson(1) up to 7."""
    p, total, steps = 0.36787944117144233, 0.0, []
    for i in range(1, 9):
        total += p
        steps.append(total)
        p /= i
    return steps


def _xxhash_int(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int with the hash so far as the seed."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (h + (p5 + np.uint64(4))) ^ (value * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    for shift, factor in ((33, p2), (29, p3)):
        h ^= h >> np.uint64(shift)
        h *= factor
    h ^= h >> np.uint64(32)
    return h


def times_drawn(hashes: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """groups x replicates: the counts of ``bootstrap_counts``; ``hashes`` are the groups' xxhash64."""
    reps, last = np.arange(replicates, dtype=np.uint64)[None, :], np.array(seed & 0xFFFFFFFF, np.uint64)
    u = _xxhash_int(_xxhash_int(hashes.view(np.uint64)[:, None], reps), last) & np.uint64((1 << 40) - 1)
    out = np.zeros(u.shape, np.uint8)
    for step in _poisson_steps():
        out += u >= np.uint64(math.ceil(step * (1 << 40)))
    return out


def bootstrap_counts(groups: DataFrame, group: str, replicates: int, seed: int) -> DataFrame:
    """(rep, group, times): how often each replicate draws each group; Poisson(1), from a hash."""
    reps = groups.select(group).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u, steps = hash_unit(group, "rep", seed), _poisson_steps()
    times = sum(((u >= s).cast("int") for s in steps[1:]), (u >= steps[0]).cast("int"))
    return reps.withColumn("times", times).where("times > 0")


def stratified_sample(df: DataFrame, strata: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum in the order of md5(key || seed): a sampling operator."""
    w = Window.partitionBy(strata).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
