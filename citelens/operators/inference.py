"""Hypothesis tests. What is distributed is the reduction to counts; the kernels see a few numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelens.functions.stats import fisher_exact, mann_whitney_p, normal_tail
from citelens.operators.metrics import running_counts


def mann_whitney(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, n1, n0, u, tie_sum, effect): U of the positives, sum of t**3 - t over ties, rank-biserial 1 - 2U/(n1 n0).

    Mid-ranks follow from the counts at and below each distinct value, so that ties never need a sort of all rows.
    """
    long = df.select(F.col(label).alias("y"), *(F.col(x).cast("double") for x in features)).unpivot(["y"], list(features), "feature", "v")
    c = running_counts(long.where("v is not null and not isnan(v)"), "v", "y", ["feature"])
    below = (F.col("total") - F.col("positives")) - (F.col("cum_n") - F.col("cum_tp"))
    at = F.col("n") - F.col("tp")
    won = F.sum(F.col("tp") * (below + at / 2))
    ties = F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n"))
    out = c.groupBy("feature").agg(
        F.max("positives").alias("n1"),
        F.max(F.col("total") - F.col("positives")).alias("n0"),
        won.alias("u"),
        ties.alias("tie_sum"),
    )
    return out.withColumn("effect", 1 - 2 * F.col("u") / F.nullif(F.col("n1") * F.col("n0"), F.lit(0)))


def hypothesis_tests(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Mann-Whitney with two-sided p, by falling size of the effect. One row for each feature reaches the kernel."""

    def p(u, n1, n0, ties):
        return u.combine(n1, lambda a, b: (a, b)).to_frame("a").assign(n0=n0, t=ties).apply(
            lambda r: mann_whitney_p(r["a"][0], int(r["a"][1]), int(r["n0"]), r["t"]), axis=1
        )

    kernel = F.pandas_udf(p, T.DoubleType())
    tested = mann_whitney(df, features, label).withColumn("p", kernel("u", "n1", "n0", "tie_sum"))
    return tested.orderBy(F.desc(F.abs("effect")), "feature")


def contingency(df: DataFrame, flags: Sequence[str], label: str) -> DataFrame:
    """(flag, a, b, c, d, odds): counts of flag and label both 1, flag only, label only, neither; odds NULL if b*c = 0."""
    def counts(f: str) -> list[Column]:
        on, off = F.col(f) == 1, F.col(f) == 0
        y, n = F.col(label) == 1, F.col(label) == 0
        return [F.count_if(x & z).alias(f"{f}__{k}") for k, x, z in (("a", on, y), ("b", on, n), ("c", off, y), ("d", off, n))]

    wide = df.agg(*(x for f in flags for x in counts(f)))
    rows = [F.struct(F.lit(f).alias("flag"), *(F.col(f"{f}__{k}").alias(k) for k in "abcd")) for f in flags]
    long = wide.select(F.inline(F.array(*rows)))
    return long.withColumn("odds", F.col("a") * F.col("d") / F.nullif(F.col("b") * F.col("c"), F.lit(0)))


def fisher(table: DataFrame) -> DataFrame:
    """The exact two-sided p of each row of ``contingency``."""

    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher_exact(*map(int, x))[1] for x in zip(a, b, c, d)], dtype=float)

    kernel = F.pandas_udf(p, T.DoubleType())
    return table.withColumn("p", kernel("a", "b", "c", "d"))


def holm(df: DataFrame, p: str, family: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``holm``: step-down adjusted p of a family of tests (few rows)."""
    w = Window.partitionBy(*family)
    ordered = w.orderBy(p)
    r = F.row_number().over(ordered)
    stepped = df.withColumn("_step", (F.count("*").over(w) - r + 1) * F.col(p))
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return stepped.withColumn("holm", F.least(F.lit(1.0), F.max("_step").over(upto))).drop("_step")


def clustered_logit(df: DataFrame, flag: str, label: str, clusters: Sequence[str], steps: int = 25) -> dict[str, float]:
    """Odds ratio of a 0/1 flag in an unregularised logit, with naive p and p clustered by each of ``clusters``.

    The likelihood depends only on the four cell counts, so that the fit needs one aggregate; the sandwich needs the sums of
    scores by cluster, which are again four counts a cluster and are summed before they reach the driver.
    """
    cells = {(r["x"], r["y"]): r["n"] for r in df.groupBy(F.col(flag).alias("x"), F.col(label).alias("y")).agg(F.count("*").alias("n")).collect() if r["x"] is not None and r["y"] is not None}
    n = np.array([[cells.get((x, y), 0) for y in (0, 1)] for x in (0, 1)], float)
    beta = np.zeros(2)
    design = np.array([[1.0, 0.0], [1.0, 1.0]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (n[:, 1] - n.sum(1) * p)
        information = design.T @ (design * (n.sum(1) * p * (1 - p))[:, None])
        change = np.linalg.solve(information, gradient)
        beta = beta + change
        if np.abs(change).max() < 1e-12:
            break
    bread = np.linalg.inv(information)
    out = {"odds_ratio": float(np.exp(beta[1])), "p_naive": 2 * normal_tail(abs(beta[1]) / bread[1, 1] ** 0.5)}
    p0, p1 = (float(x) for x in p)
    total = n.sum()
    for cluster in clusters:
        residual = F.col(label) - F.when(F.col(flag) == 1, p1).otherwise(p0)
        sums = (
            df.where(F.col(flag).isNotNull() & F.col(label).isNotNull())
            .groupBy(cluster)
            .agg(F.sum(residual).alias("s0"), F.sum(residual * F.col(flag)).alias("s1"))
            .agg(F.sum(F.col("s0") ** 2).alias("a"), F.sum(F.col("s0") * F.col("s1")).alias("b"), F.sum(F.col("s1") ** 2).alias("c"), F.count("*").alias("g"))
            .first()
        )
        meat = np.array([[sums["a"], sums["b"]], [sums["b"], sums["c"]]])
        g = sums["g"]
        scale = g / max(1, g - 1) * (total - 1) / max(1, total - 2)
        variance = scale * (bread @ meat @ bread)
        out[f"p_{cluster}"] = 2 * normal_tail(abs(beta[1]) / variance[1, 1] ** 0.5)
    return out
