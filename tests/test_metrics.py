"""Metrics and resampling against small plain implementations."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citelens.operators import inference, metrics, ranges, relational, validation


def plain_ap(y, s):
    total, ap, tp, n = sum(y), 0.0, 0, 0
    for t in sorted(set(s), reverse=True):
        at = [a for a, b in zip(y, s) if b == t]
        tp, n = tp + sum(at), n + len(at)
        ap += sum(at) / total * tp / n
    return ap


def plain_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(-3, 3)), min_size=2, max_size=40))
def test_ap_and_auc(spark, rows):
    y, s = [a for a, _ in rows], [float(b) for _, b in rows]
    df = spark.createDataFrame([(a, b) for a, b in zip(y, s)], "y int, s double")
    ap = metrics.average_precision(df, "s", "y").first()["ap"]
    auc = metrics.roc_auc(df, "s", "y").first()["auc"]
    if sum(y):
        assert ap == pytest.approx(plain_ap(y, s)) and 0 <= ap <= 1 + 1e-12
    else:
        assert ap is None
    assert auc is None if sum(y) in (0, len(y)) else auc == pytest.approx(plain_auc(y, s))


def test_many_scores_in_ranges(spark):
    r = np.random.default_rng(1)
    y, s = r.integers(0, 2, 3000), r.normal(size=3000)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    assert metrics.average_precision(df, "s", "y").first()["ap"] == pytest.approx(plain_ap(list(y), list(s)))
    by = df.withColumn("g", F.pmod(F.xxhash64("s"), F.lit(3)))
    assert metrics.average_precision(by, "s", "y", ["g"]).count() == 3


def test_per_query_and_top_k(spark):
    rows = [("a", 1, 3.0, 1), ("a", 0, 2.0, 2), ("a", 1, 1.0, 3), ("b", 0, 1.0, 4), ("b", 0, 1.0, 5), ("c", 1, 1.0, 6), ("d", 0, 1.0, 7), ("d", 1, 1.0, 8)]
    df = spark.createDataFrame(rows, "q string, y int, s double, id int")
    got = metrics.per_query_ap(df, "s", "y", "q").first()
    assert got["queries"] == 2 and got["mean_ap"] == pytest.approx((5 / 6 + 0.5) / 2)
    order = [F.desc("s"), F.col("id")]
    assert metrics.precision_at_k(df, "y", "q", order, 3).first()["precision"] == pytest.approx(2 / 3)
    assert metrics.precision_at_true_k(df, "y", "q", order).first()["precision"] == pytest.approx((0.5 + 1 + 0) / 3)


def test_best_f1_and_calibration(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (0, 0.1)], "y int, s double")
    best = metrics.best_f1(df, "s", "y").first()
    assert best["threshold"] == 0.8 and best["f1"] == 1.0
    ties = spark.createDataFrame([(1, 0.5)] * 20 + [(0, 0.5)] * 20, "y int, s double")
    one = metrics.calibration(ties, "s", "y").collect()
    assert len(one) == 1 and one[0]["n"] == 40 and one[0]["gap"] == pytest.approx(0)


def test_mann_whitney_and_holm(spark):
    r = np.random.default_rng(2)
    y, v = r.integers(0, 2, 200), r.integers(0, 20, 200)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, v)], "y int, v int")
    got = inference.mann_whitney(df, ["v"], "y").first()
    u = sum((p > q) + (p == q) / 2 for p in v[y == 1] for q in v[y == 0])
    assert got["u"] == pytest.approx(u) and got["effect"] == pytest.approx(1 - 2 * u / (got["n1"] * got["n0"]))
    ps = [0.001, 0.02, 0.04, 0.04, 0.3]
    h = inference.holm(spark.createDataFrame([(p,) for p in ps], "p double"), "p").orderBy("p", "holm").collect()
    assert [round(x["holm"], 6) for x in h] == [0.005, 0.08, 0.12, 0.12, 0.3]


def test_clustered_logit(spark):
    rows = [(1, 1, i % 7) for i in range(40)] + [(1, 0, i % 5) for i in range(20)] + [(0, 1, i % 7) for i in range(30)] + [(0, 0, i % 9) for i in range(50)]
    fit = inference.clustered_logit(spark.createDataFrame(rows, "x int, y int, c int"), "x", "y", ["c"])
    assert fit["odds_ratio"] == pytest.approx(40 * 50 / (20 * 30), rel=1e-6) and 0 < fit["p_naive"] < 0.01 and 0 < fit["p_c"] < 1


def test_folds(spark):
    rows = [(f"g{i % 37}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, id int")
    for folds in (validation.rank_folds(df, "g", 5), validation.balanced_folds(df, "g", 5)):
        f = {r["g"]: r["fold"] for r in folds.collect()}
        assert len(f) == 37 and set(f.values()) <= set(range(5))
    ranks = {r["g"]: r["rank"] for r in validation.dense_ranks(df, "g").collect()}
    assert [ranks[g] for g in sorted(ranks)] == list(range(37))
    blocked = validation.double_blocked(df.withColumn("h", F.pmod("id", F.lit(11)).cast("string")), "g", "h", 3, 1)
    for k in range(3):
        test = blocked.where((F.col("fold_a") == k) & (F.col("fold_b") == k))
        train = blocked.where((F.col("fold_a") != k) & (F.col("fold_b") != k))
        assert test.join(train.select("g"), "g", "left_semi").isEmpty() and test.join(train.select("h"), "h", "left_semi").isEmpty()


@pytest.mark.parametrize("seed", range(40))
def test_turns_are_the_greedy_choice(seed):
    import random

    r = random.Random(seed)
    k = r.randrange(1, 7)
    sizes = sorted({r.choice([1, 2, 3, 5, 7, 40, 500]): r.choice([1, 2, 3, 30, 200]) for _ in range(5)}.items(), reverse=True)
    loads, expected = [0] * k, []
    for size, n in sizes:
        for _ in range(n):
            f = loads.index(min(loads))
            loads[f] += size
            expected.append(f)
    turns = validation._turns(sizes, k)
    got = [folds[(i - first) % len(folds)] for first, last, folds in turns for i in range(first, last)]
    assert got == expected and len(turns) <= 3 * k * len(sizes)


def test_many_groups_of_one_size_take_few_turns():
    assert len(validation._turns([(10**9, 1), (1, 10**10)], 5)) <= 10


def test_balanced_folds_against_the_greedy_choice(spark):
    rows = [(f"g{i:03}",) for i in range(60) for _ in range(1 + i % 4 + (i == 7) * 50)] + [(None,)]
    got = {r["g"]: r["fold"] for r in validation.balanced_folds(spark.createDataFrame(rows, "g string"), "g", 4).collect()}
    sizes, loads, expected = Counter(g for (g,) in rows if g), [0] * 4, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        expected[g] = loads.index(min(loads))
        loads[expected[g]] += sizes[g]
    assert got == expected
    assert validation.balanced_folds(spark.createDataFrame([], "g string"), "g", 4).count() == 0


def test_quantiles_and_running_sums(spark):
    r = np.random.default_rng(5)
    values = np.concatenate([r.normal(size=500) ** 9, [0.0] * 200]).tolist()
    rows = [(i % 3, v) for i, v in enumerate(values)] + [(7, None), (8, 2.5)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {x["g"]: x["q"] for x in ranges.quantiles(df, "v", [0.0, 0.1, 0.5, 0.75, 1.0], ["g"]).collect()}
    for g in (0, 1, 2, 8):
        own = [v for h, v in rows if h == g]
        assert got[g] == pytest.approx(np.quantile(own, [0.0, 0.1, 0.5, 0.75, 1.0]).tolist())
    assert 7 not in got
    counts = df.where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    rows_ = sorted(ranges.running(counts, "v", ["n"]).collect(), key=lambda x: x["v"])
    assert [x["cum_n"] for x in rows_] == np.cumsum([x["n"] for x in rows_]).tolist() and {x["all_n"] for x in rows_} == {701}
    assert ranges.running(counts.limit(0), "v", ["n"]).count() == 0


def test_shuffle_keeps_counts(spark):
    df = spark.createDataFrame([(f"g{i % 5}", i, int(i % 3 == 0)) for i in range(100)], "g string, id int, y int")
    a = {r["g"]: r["s"] for r in df.groupBy("g").agg(F.sum("y").alias("s")).collect()}
    mixed = validation.shuffle_within(df, ["g"], "id", "y", 1)
    assert {r["g"]: r["s"] for r in mixed.groupBy("g").agg(F.sum("y").alias("s")).collect()} == a and mixed.count() == 100


def test_bootstrap_mean(spark):
    df = spark.createDataFrame([(f"g{i}",) for i in range(200)], "g string")
    n = validation.bootstrap_counts(df, "g", 50, 1).agg(F.sum("times")).first()[0]
    assert 0.95 < n / (200 * 50) < 1.05


def test_relational_edges(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 4.0), (3, None, 2.0)], "id int, k string, v double")
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    marked = {r["id"]: r["m"] for r in relational.mark_join(df, keys, ["k"], "m").collect()}
    assert marked == {1: 1, 2: 1, 3: 0}
    assert relational.keep_first(df, ["k"], [F.col("id")]).count() == 2
    filled = {r["id"]: r["v"] for r in relational.impute_median(df, ["v"]).collect()}
    assert filled == {1: 3.0, 2: 4.0, 3: 2.0}
    assert relational.impute_median(df.where("v is null"), ["v"]).first()["v"] == 0.0
    quota = relational.quota(spark.createDataFrame([("q", i, int(i == 5)) for i in range(6)], "q string, r int, c int"), ["q"], [F.col("r")], F.col("c") == 1, 2)
    assert sorted(r["r"] for r in quota.collect()) == [0, 1, 5]


def test_resampled_ap_draws_as_the_table_of_counts_does(spark):
    r = np.random.default_rng(4)
    rows = [(m, f"g{i % 31}", int(y), float(s)) for m, s_ in (("a", r.integers(0, 4, 3000)), ("b", r.normal(size=3000))) for i, (y, s) in enumerate(zip(r.integers(0, 2, 3000), s_))]
    rows += [("a", None, 1, 9.0), ("b", "g1", 1, None), ("c", "g1", 0, 1.0)]
    df = spark.createDataFrame(rows, "model string, g string, y int, s double").repartition(5)
    got = {(x["model"], x["rep"]): x["ap"] for x in metrics.resampled_ap(df, "g", "s", "y", "model", 20, -7).collect()}
    groups = spark.createDataFrame([(f"g{i}",) for i in range(31)], "g string")
    times = {(x["rep"], x["g"]): x["times"] for x in validation.bootstrap_counts(groups, "g", 20, -7).collect()}
    for m in "ab":
        for rep in range(20):
            own = [(y, s) for k, g, y, s in rows if k == m and g and s is not None for _ in range(times.get((rep, g), 0))]
            assert got[m, rep] == pytest.approx(plain_ap([y for y, _ in own], [s for _, s in own]))
    assert got["c", 0] is None


def test_bootstrap_makes_no_table_of_groups_times_replicates(spark, tmp_path):
    from citelens.plans.metric_queries import bootstrap_ap_difference

    rows = [(i, f"q{i % 50}", i % 3 % 2, i % 29 + 1, i % 7 / 7) for i in range(1000)]
    spark.createDataFrame(rows, "row_id int, query_id string, cited int, organic_rank int, passage_match_score double").write.parquet(f"{tmp_path}/candidates.parquet")
    df = bootstrap_ap_difference(spark, str(tmp_path))
    assert "explode" not in df._jdf.queryExecution().toString() and df.first()["low"] <= df.first()["mean_gap"] <= df.first()["high"]
