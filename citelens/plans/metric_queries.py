"""Queries of ranking metrics and tests, over candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.operators import inference, metrics, validation
from citelens.plans.candidate_queries import domain, ranked
from citelens.plans.registry import query
from citelens.plans.tables import C, candidates

SCORE = "1.0::double / greatest(organic_rank, 1)"
_SCORED = f"SELECT row_id, query_id, cited AS y, {SCORE} AS s, passage_match_score AS m FROM candidates"


def scored(spark: SparkSession, folder: str) -> DataFrame:
    df = candidates(spark, folder)
    rank = (1 / F.greatest("organic_rank", F.lit(1))).alias("s")
    return df.select("row_id", "query_id", F.col("cited").alias("y"), rank, F.col("passage_match_score").alias("m"))


def _r(c):
    return F.round(c, 6)


def _ap_sql(score: str, by: str = "", source: str = "x") -> str:
    part, partition = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return (
        f"SELECT {part}sum(tp / p * ctp / cn) AS ap, max(p) AS positives, max(t) AS total FROM (SELECT {part}tp, "
        f"sum(tp) OVER ({partition}ORDER BY s DESC ROWS UNBOUNDED PRECEDING)::double AS ctp, "
        f"sum(n) OVER ({partition}ORDER BY s DESC ROWS UNBOUNDED PRECEDING)::double AS cn, "
        f"nullif(sum(tp) OVER ({partition}), 0)::double AS p, sum(n) OVER ({partition}) AS t FROM (SELECT {part}{score} AS s, sum(y) AS tp, "
        f"count(*) AS n FROM {source} WHERE {score} IS NOT NULL GROUP BY {part}{score}))" + (f" GROUP BY {by}" if by else "")
    )


@query(
    "average_precision",
    f"WITH x AS ({_SCORED}) SELECT 'rank' AS score, round(ap, 6) AS ap, CAST(positives AS BIGINT) AS positives FROM ({_ap_sql('s')}) "
    f"UNION ALL SELECT 'passage', round(ap, 6), CAST(positives AS BIGINT) FROM ({_ap_sql('m')})",
)
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    x = scored(spark, folder)
    parts = [
        metrics.average_precision(x, c, "y").select(F.lit(name).alias("score"), _r("ap").alias("ap"), "positives")
        for name, c in (("rank", "s"), ("passage", "m"))
    ]
    return parts[0].unionByName(parts[1])


def _auc_sql(score: str, source: str = "x") -> str:
    return (
        f"SELECT (sum(CASE WHEN y = 1 THEN mr END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))::double AS auc FROM "
        f"(SELECT y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS mr FROM {source} WHERE {score} IS NOT NULL)"
    )


@query(
    "roc_auc",
    f"WITH x AS ({_SCORED}) SELECT 'rank' AS score, round(auc, 6) AS auc FROM ({_auc_sql('s')}) UNION ALL "
    f"SELECT 'passage', round(auc, 6) FROM ({_auc_sql('m')})",
)
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    x = scored(spark, folder)
    parts = [
        metrics.roc_auc(x, c, "y").select(F.lit(name).alias("score"), _r("auc").alias("auc"))
        for name, c in (("rank", "s"), ("passage", "m"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "per_query_ap",
    f"WITH x AS ({_SCORED}) SELECT round(avg(ap), 6) AS mean_ap, count(*) AS queries FROM ({_ap_sql('s', 'query_id')}) "
    "WHERE positives > 0 AND positives < total",
)
def per_query_ap(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.per_query_ap(scored(spark, folder), "s", "y", "query_id").withColumn("mean_ap", _r("mean_ap"))


_RANKED = (
    "SELECT query_id, y, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS r, sum(y) OVER (PARTITION BY query_id) AS k, "
    "count(*) OVER (PARTITION BY query_id) AS n FROM x"
)


@query(
    "precision_at_3",
    f"WITH x AS ({_SCORED}) SELECT CAST(sum(y) AS BIGINT) AS hits, count(*) AS places, round(avg(y), 6) AS precision FROM ({_RANKED}) "
    "WHERE n >= 3 AND k > 0 AND r <= 3",
)
def precision_at_3(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.desc("s"), F.col("row_id")]
    return metrics.precision_at_k(scored(spark, folder), "y", "query_id", order, 3).withColumn("precision", _r("precision"))


@query(
    "precision_at_true_k",
    f"WITH x AS ({_SCORED}) SELECT round(avg(p), 6) AS precision, count(*) AS queries FROM (SELECT query_id, avg(y) AS p FROM ({_RANKED}) "
    "WHERE k > 0 AND r <= k GROUP BY query_id)",
)
def precision_at_true_k(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.desc("s"), F.col("row_id")]
    return metrics.precision_at_true_k(scored(spark, folder), "y", "query_id", order).withColumn("precision", _r("precision"))


@query(
    "best_f1_threshold",
    f"WITH x AS ({_SCORED}), c AS (SELECT s, sum(tp) OVER (ORDER BY s DESC) AS ctp, sum(n) OVER (ORDER BY s DESC) AS cn, sum(tp) OVER () AS p "
    "FROM (SELECT m AS s, sum(y) AS tp, count(*) AS n FROM x WHERE m IS NOT NULL GROUP BY m)), f AS (SELECT s, round(2 * ctp / (p + cn)::double, 12) AS f1 FROM c) "
    "SELECT round(arg_min(s, struct_pack(a := -f1, b := s)), 6) AS threshold, round(max(f1), 6) AS f1 FROM f",
)
def best_f1_threshold(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.best_f1(scored(spark, folder), "m", "y")
    return out.select(_r("threshold").alias("threshold"), _r("f1").alias("f1"))


@query(
    "confusion_at_threshold",
    f"WITH x AS ({_SCORED}) SELECT y AS label, CAST(m >= 0.5 AS INTEGER) AS predicted, count(*) AS n FROM x GROUP BY 1, 2",
)
def confusion_at_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion(scored(spark, folder), "m", "y", 0.5)


_EDGES = ", ".join(f"{i / 10}" for i in range(1, 10))


@query(
    "calibration_quantile_bins",
    f"WITH x AS ({_SCORED}), e AS (SELECT quantile_cont(m, [{_EDGES}]) AS edges FROM x) SELECT CAST(len(list_filter(edges, lambda q: q < m)) AS INTEGER) AS bin, "
    "count(*) AS n, round(avg(m), 6) AS mean_score, round(avg(y), 6) AS mean_label, round(abs(avg(m) - avg(y)), 6) AS gap FROM x, e "
    "WHERE m IS NOT NULL GROUP BY 1",
)
def calibration_quantile_bins(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.calibration(scored(spark, folder).where("m is not null"), "m", "y")
    return out.withColumns({c: _r(c) for c in ("mean_score", "mean_label", "gap")})


@query(
    "compare_scores_per_fold",
    f"WITH f AS (SELECT query_id, CAST((dense_rank() OVER (ORDER BY query_id) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT query_id FROM candidates)), "
    f"x AS (SELECT fold, y, s, m FROM ({_SCORED}) JOIN f USING (query_id)) "
    f"SELECT 'rank' AS model, round(avg(ap), 4) AS mean_ap, round(stddev_pop(ap), 4) AS std_ap, count(*) AS folds FROM ({_ap_sql('s', 'fold')}) "
    f"UNION ALL SELECT 'passage', round(avg(ap), 4), round(stddev_pop(ap), 4), count(*) FROM ({_ap_sql('m', 'fold')}) "
    "UNION ALL SELECT 'prevalence', round(avg(a), 4), round(stddev_pop(a), 4), count(*) FROM (SELECT avg(y) AS a FROM x GROUP BY fold)",
)
def compare_scores_per_fold(spark: SparkSession, folder: str) -> DataFrame:
    x = scored(spark, folder)
    folded = x.join(validation.rank_folds(x, "query_id", 5), "query_id")
    long = folded.unpivot(["fold", "y"], ["s", "m"], "model", "score")
    names = F.when(F.col("model") == "s", "rank").otherwise("passage")
    each = metrics.average_precision(long, "score", "y", ["model", "fold"]).select(names.alias("model"), "ap")
    base = folded.groupBy("fold").agg(F.avg("y").alias("ap")).select(F.lit("prevalence").alias("model"), "ap")
    return each.unionByName(base).groupBy("model").agg(
        F.round(F.avg("ap"), 4).alias("mean_ap"), F.round(F.stddev_pop("ap"), 4).alias("std_ap"), F.count("*").alias("folds")
    )


_TESTED = ["word_count", "num_lists_tables", "query_url_similarity", "passage_match_score", "organic_rank"]


def _mw_sql(f: str) -> str:
    return (
        f"SELECT '{f}' AS feature, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, round(u, 3) AS u, round(1 - 2 * u / (n1 * n0), 6) AS effect FROM (SELECT sum(cited)::double AS n1, "
        f"(count(*) - sum(cited))::double AS n0, sum(CASE WHEN cited = 1 THEN mr END) - sum(cited) * (sum(cited) + 1) / 2.0 AS u FROM (SELECT cited, rank() OVER "
        f"(ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS mr FROM candidates WHERE {f} IS NOT NULL))"
    )


@query("mann_whitney_u", " UNION ALL ".join(map(_mw_sql, _TESTED)))
def mann_whitney_u(spark: SparkSession, folder: str) -> DataFrame:
    out = inference.mann_whitney(candidates(spark, folder), _TESTED, "cited")
    return out.select("feature", "n1", "n0", F.round("u", 3).alias("u"), _r("effect").alias("effect"))


@query("hypothesis_tests")
def hypothesis_tests(spark: SparkSession, folder: str) -> DataFrame:
    return inference.hypothesis_tests(candidates(spark, folder), _TESTED, "cited")


_FLAGS = ["has_schema", "has_faq", "is_https", "is_forum", "is_video"]


@query(
    "contingency_odds",
    " UNION ALL ".join(
        f"SELECT '{f}' AS flag, a, b, c, d, round(a * d / nullif(b * c, 0)::double, 6) AS odds FROM (SELECT count_if({f} = 1 AND cited = 1) AS a, "
        f"count_if({f} = 1 AND cited = 0) AS b, count_if({f} = 0 AND cited = 1) AS c, count_if({f} = 0 AND cited = 0) AS d FROM candidates WHERE organic_rank <> 101)"
        for f in _FLAGS
    ),
)
def contingency_odds(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder).where(ranked())
    return inference.contingency(rows, _FLAGS, "cited").withColumn("odds", _r("odds"))


@query(
    "fisher_holm",
    "WITH t AS ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS flag, CAST(count_if({f} = 1 AND cited = 1) AS BIGINT) AS a, CAST(count_if({f} = 1 AND cited = 0) AS BIGINT) AS b, CAST(count_if({f} = 0 AND cited = 1) AS BIGINT) AS c, CAST(count_if({f} = 0 AND cited = 0) AS BIGINT) AS d FROM candidates WHERE organic_rank <> 101"
        for f in _FLAGS
    )
    + "), h AS (SELECT *, unnest(range(CAST(greatest(0, a - d) AS BIGINT), CAST(least(a + b, a + c) + 1 AS BIGINT))) AS x FROM t), "
    "l AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS q FROM h), "
    "p AS (SELECT flag, a, b, c, d, least(1, sum(exp(q)) FILTER (q <= o + 1e-7)) AS p FROM (SELECT *, max(q) FILTER (x = a) OVER (PARTITION BY flag) AS o FROM l) GROUP BY flag, a, b, c, d), "
    "r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p) "
    "SELECT flag, a, b, c, d, round(a * d / nullif(b * c, 0)::double, 6) AS odds, round(p, 8) AS p, round(least(1.0, max((m - r + 1) * p) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING)), 8) AS holm FROM r",
)
def fisher_holm(spark: SparkSession, folder: str) -> DataFrame:
    """Fisher's exact p of each flag, adjusted by Holm."""
    tested = inference.holm(inference.fisher(contingency_odds(spark, folder)), "p")
    return tested.withColumns({c: F.round(c, 8) for c in ("p", "holm")})


@query(
    "holm_adjust",
    "WITH t AS (SELECT content_type, round(avg(cited) / 10, 6) AS p FROM candidates GROUP BY content_type UNION ALL SELECT 'all', round(avg(cited) / 50, 6) FROM candidates), "
    "r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM t) "
    "SELECT content_type, p, round(least(1.0, max((m - r + 1) * p) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING)), 6) AS holm FROM r",
)
def holm_adjust(spark: SparkSession, folder: str) -> DataFrame:
    df = candidates(spark, folder)
    each = df.groupBy("content_type").agg(_r(F.avg("cited") / 10).alias("p"))
    whole = df.agg(_r(F.avg("cited") / 50).alias("p")).select(F.lit("all").alias("content_type"), "p")
    return inference.holm(each.unionByName(whole), "p").withColumn("holm", _r("holm"))


@query("clustered_logit")
def clustered_logit(spark: SparkSession, folder: str) -> DataFrame:
    """Odds of has_schema and has_faq among the queries with a citation; p naive, by url and by domain."""
    rows_ranked = candidates(spark, folder).where(ranked()).withColumn("domain", domain())
    having = rows_ranked.where("cited > 0").select("query_id").distinct()
    population = rows_ranked.join(having, "query_id", "left_semi")
    rows = []
    for flag in ("has_schema", "has_faq"):
        fit = inference.clustered_logit(population, flag, "cited", ["url", "domain"])
        rows.append((flag, fit["odds_ratio"], fit["p_naive"], fit["p_url"], fit["p_domain"]))
    return spark.createDataFrame(rows, "flag string, odds_ratio double, p_naive double, p_url double, p_domain double")


@query(
    "double_blocked_folds",
    None,
)
def double_blocked_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each fold's train and test side, blocked by query and by domain at once."""
    df = validation.double_blocked(
        candidates(spark, folder).where(ranked()).select("row_id", "query_id", "cited", domain().alias("domain")).where("domain is not null"),
        "query_id", "domain", 5, 42,
    )
    folds = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    a, b = F.col("fold_a") == F.col("fold"), F.col("fold_b") == F.col("fold")
    return folds.groupBy("fold").agg(
        F.count_if(a & b).alias("n_test"),
        F.count_if(~a & ~b).alias("n_train"),
        _r(F.avg(F.when(a & b, F.col("cited")))).alias("test_rate"),
    )


@query("permutation_null_rank_ap")
def permutation_null_rank_ap(spark: SparkSession, folder: str) -> DataFrame:
    """AP of the rank score against labels shuffled within each query, 20 times."""
    x = scored(spark, folder)
    reps = x.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(20))))
    shuffled = validation.shuffle_within(reps, ["rep", "query_id"], "row_id", "y", 7, F.col("rep"))
    each = metrics.average_precision(shuffled, "s", "y", ["rep"])
    seen = metrics.average_precision(x, "s", "y").select(F.col("ap").alias("observed"))
    return (
        each.crossJoin(F.broadcast(seen))
        .agg(F.max("observed").alias("observed"), F.avg("ap").alias("null_mean"), F.stddev_pop("ap").alias("null_std"), F.count_if(F.col("ap") >= F.col("observed")).alias("at_least"), F.count("*").alias("reps"))
        .withColumn("p", (F.col("at_least") + 1) / (F.col("reps") + 1))
    )


@query("bootstrap_ap_difference")
def bootstrap_ap_difference(spark: SparkSession, folder: str) -> DataFrame:
    """AP of passage score minus rank score over 400 resamples of the queries: mean, 95 % range, share above 0."""
    x = scored(spark, folder)
    long = x.unpivot(["query_id", "y"], ["s", "m"], "model", "score")
    ap = metrics.resampled_ap(long, "query_id", "score", "y", "model", 400, 11)
    wide = ap.groupBy("rep").pivot("model", ["s", "m"]).agg(F.first("ap"))
    gap = F.col("m") - F.col("s")
    return wide.agg(
        F.avg(gap).alias("mean_gap"),
        F.percentile(gap, F.lit(0.025)).alias("low"),
        F.percentile(gap, F.lit(0.975)).alias("high"),
        F.avg((gap > 0).cast("double")).alias("share_above"),
    )


@query("group_holdout_ap")
def group_holdout_ap(spark: SparkSession, folder: str) -> DataFrame:
    """AP of the passage score on 50 holdouts of a fifth of the queries."""
    x = scored(spark, folder).where("m is not null")
    reps = x.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(50))))
    held = reps.where(validation.hash_unit("query_id", "rep", 5) < 0.2)
    each = metrics.average_precision(held, "m", "y", ["rep"])
    return each.agg(
        F.avg("ap").alias("mean_ap"), F.stddev_pop("ap").alias("std_ap"), F.min("ap").alias("low"), F.max("ap").alias("high")
    )


def _true_k_sql(score: str) -> str:
    return (
        f"SELECT avg(p) AS p FROM (SELECT query_id, avg(y) AS p FROM (SELECT query_id, y, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, row_id) AS r, "
        "sum(y) OVER (PARTITION BY query_id) AS k FROM x) WHERE k > 0 AND r <= k GROUP BY query_id)"
    )


_BEST_F1 = (
    "SELECT arg_min(s, struct_pack(a := -f1, b := s)) AS threshold, max(f1) AS f1 FROM (SELECT s, round(2 * ctp / (p + cn)::double, 12) AS f1 FROM (SELECT s, sum(tp) OVER (ORDER BY s DESC) AS ctp, "
    "sum(n) OVER (ORDER BY s DESC) AS cn, sum(tp) OVER () AS p FROM (SELECT m AS s, sum(y) AS tp, count(*) AS n FROM x GROUP BY m)))"
)


@query(
    "evaluation_summary",
    f"WITH x AS (SELECT * FROM ({_SCORED}) WHERE m IS NOT NULL), b AS (SELECT count(*) AS n, count(DISTINCT query_id) AS q, avg(y) AS rate FROM x), f AS ({_BEST_F1}) "
    f"SELECT n AS n_rows, q AS n_queries, round(rate, 6) AS positive_rate, round(mp.ap, 6) AS model_pr_auc, round(ma.auc, 6) AS model_roc_auc, round(rp.ap, 6) AS rank_only_pr_auc, "
    "round(ra.auc, 6) AS rank_only_roc_auc, round(mp.ap - rp.ap, 6) AS lift_over_rank, round(mp.ap - rate, 6) AS lift_over_prevalence, round(mk.p, 6) AS precision_at_true_k_model, "
    "round(rk.p, 6) AS precision_at_true_k_rank, round(threshold, 6) AS best_f1_threshold, round(f1, 6) AS best_f1 "
    f"FROM b, f, ({_ap_sql('m')}) mp, ({_auc_sql('m')}) ma, ({_ap_sql('s')}) rp, ({_auc_sql('s')}) ra, ({_true_k_sql('m')}) mk, ({_true_k_sql('s')}) rk",
)
def evaluation_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The thirteen figures of a model's scores against rank and prevalence; the stored passage score stands for the model's."""
    return summary(scored(spark, folder).where("m is not null"), "m", "s")


def summary(x: DataFrame, model: str, rank: str) -> DataFrame:
    """One row from (row_id, query_id, y) and two scores."""
    out = x.agg(F.count("*").alias("n_rows"), F.countDistinct("query_id").alias("n_queries"), F.avg("y").alias("rate"))
    for name, score in (("model", model), ("rank_only", rank)):
        out = out.crossJoin(F.broadcast(metrics.average_precision(x, score, "y").select(F.col("ap").alias(f"{name}_pr"))))
        out = out.crossJoin(F.broadcast(metrics.roc_auc(x, score, "y").select(F.col("auc").alias(f"{name}_roc"))))
        at_k = metrics.precision_at_true_k(x, "y", "query_id", [F.desc(score), F.col("row_id")])
        out = out.crossJoin(F.broadcast(at_k.select(F.col("precision").alias(f"{name}_k"))))
    out = out.crossJoin(F.broadcast(metrics.best_f1(x, model, "y")))
    return out.select(
        "n_rows", "n_queries", _r("rate").alias("positive_rate"), _r("model_pr").alias("model_pr_auc"), _r("model_roc").alias("model_roc_auc"),
        _r("rank_only_pr").alias("rank_only_pr_auc"), _r("rank_only_roc").alias("rank_only_roc_auc"), _r(F.col("model_pr") - F.col("rank_only_pr")).alias("lift_over_rank"),
        _r(F.col("model_pr") - F.col("rate")).alias("lift_over_prevalence"), _r("model_k").alias("precision_at_true_k_model"),
        _r("rank_only_k").alias("precision_at_true_k_rank"), _r("threshold").alias("best_f1_threshold"), _r("f1").alias("best_f1"),
    )


@query(
    "population_comparison",
    f"WITH x AS (SELECT *, max(y) OVER (PARTITION BY query_id) AS any_cited FROM ({_SCORED})), p AS (SELECT 'all' AS population, y, m FROM x UNION ALL SELECT 'with_citation', y, m FROM x WHERE any_cited > 0) "
    f"SELECT population, round(ap, 6) AS pr_auc, round(ap / (positives / total::double), 6) AS lift FROM ({_ap_sql('m', 'population', 'p')})",
)
def population_comparison(spark: SparkSession, folder: str) -> DataFrame:
    x = scored(spark, folder)
    having = x.where("y > 0").select("query_id").distinct()
    both = x.withColumn("population", F.lit("all")).unionByName(
        x.join(having, "query_id", "left_semi").withColumn("population", F.lit("with_citation"))
    )
    ap = metrics.average_precision(both, "m", "y", ["population"])
    return ap.select("population", _r("ap").alias("pr_auc"), _r(F.col("ap") / (F.col("positives") / F.col("total"))).alias("lift"))
