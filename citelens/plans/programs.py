"""Analyses that combine models, metrics and resampling into one long table each: (section, setting, metric, value).

Fits that repeat are grown over shared rows (``many_fits``) or submitted together, and what they score is written and
evaluated in one pass. The numbers of repeats are
those of the analyses; the trees of definitive_analysis are ``models.ORIGINAL``, the boosting rounds of other repeated fits
``models.REPEATED_TREES``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citelens.operators import inference, metrics, models, ranges, relational, validation
from citelens.operators.many_fits import Fit, fit_and_score
from citelens.plans.candidate_queries import ranked
from citelens.plans.model_queries import ALL_FEATURES, folded, training_rows
from citelens.plans.registry import query
from citelens.plans.tables import candidates
from citelens.schemas import CONTENT_FEATURES
from citelens.staging import gather, stage

QUERY_DEPENDENT = ["query_url_similarity", "passage_match_score", "num_entities_matched"]
PAGE_CONSTANT = [c for c in CONTENT_FEATURES if c not in QUERY_DEPENDENT]
PERMUTATIONS, HOLDOUTS, HOLDOUTS_LONG, RESAMPLES, SHUFFLES = 5, 30, 50, 400, 10
_KEYS = ["row_id", "group", "label"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _make(numeric: list[str], weight: str | None = None):
    return lambda: models.gbt(numeric, ["content_type"], weight=weight)


def _held_out(rows: DataFrame, by: str, numeric: list[str], seed: int) -> DataFrame:
    split = validation.group_holdout(rows, by, 0.2, seed)
    return models.positive_score(_make(numeric)().fit(split.where("held = 0")), split.where("held = 1"), *_KEYS)


def _tagged(job: Callable[[], DataFrame], **tags: str | int) -> Callable[[], DataFrame]:
    return lambda: job().select(*(F.lit(v).alias(k) for k, v in tags.items()), *_KEYS, "score")


def _long(df: DataFrame, section: str, setting: Column | str, **values: Column) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()))
    return df.select(F.lit(section).alias("section"), (F.col(setting) if isinstance(setting, str) else setting).alias("setting"), F.inline(pairs))


def _fit(section: str, setting: str, rep: int, train: Column, test: Column, label: str = "label", numeric: list[str] = ALL_FEATURES, **other) -> Fit:
    return Fit({"section": section, "setting": setting, "rep": rep}, train, test, label, numeric, **other)


def _fold_fits(section: str, setting: str, rep: int, fold: str, population: Column | None = None, **other) -> list[Fit]:
    """A fit for each of five folds, on the rows of the others; rows without a fold are in none."""
    own = F.lit(True) if population is None else population
    return [_fit(section, setting, rep, own & (F.col(fold) != k), own & (F.col(fold) == k), **other) for k in range(5)]


def _blocked_fits(section: str, setting: str, rep: int, **other) -> list[Fit]:
    a, b = F.col("fold_a"), F.col("fold_b")
    return [_fit(section, setting, rep, (a != k) & (b != k), (a == k) & (b == k), least=20, **other) for k in range(5)]


def _holdout_fits(columns: dict[str, str], repeats: int) -> list[Fit]:
    """Repeated holdouts of a fifth of the groups, each with its own fit."""
    out = []
    for name, column in columns.items():
        for seed in range(repeats):
            held = validation.hash_unit(column, seed) < 0.2
            out.append(_fit("holdout", name, seed, ~held, held))
    return out


def _with_folds(rows: DataFrame, name: str, by: str, population: DataFrame | None = None) -> DataFrame:
    """``rows`` with the balanced folds of the groups of ``population`` in the column ``name``."""
    folds = validation.balanced_folds(rows if population is None else population, by, 5).withColumnRenamed("fold", name)
    return rows.join(folds, by, "left")


def _floor(scores: DataFrame) -> DataFrame:
    """AP of each grouping's model (rep 0) against the same pipeline on labels shuffled within each query."""
    ap = metrics.average_precision(scores, "score", "label", ["setting", "rep"])
    null = F.when(F.col("rep") > 0, F.col("ap"))
    each = ap.groupBy("setting").agg(
        F.max(F.when(F.col("rep") == 0, F.col("ap"))).alias("model"), F.avg(null).alias("mean"), F.stddev_pop(null).alias("sd")
    )
    margin = F.col("model") - F.col("mean")
    return _long(
        each, "floor", "setting", model_ap=F.col("model"), null_mean=F.col("mean"), null_sd=F.col("sd"), margin=margin,
        above_null=(margin > 2 * F.col("sd")).cast("int"),
    )


def _predictors(rows: DataFrame, by_query: DataFrame, fitted: DataFrame) -> DataFrame:
    """(setting, row_id, group, label, score) of chance, rank, out-of-fold domain means, and trees under each grouping."""
    encoded = relational.out_of_group_mean(by_query, "domain", "fold", "label")
    means = by_query.join(encoded, ["domain", "fold"], "left").crossJoin(F.broadcast(rows.agg(F.avg("label").alias("prior"))))
    jobs = [
        _tagged(lambda: rows.withColumn("score", validation.hash_unit("row_id", 42)), setting="random"),
        _tagged(lambda: rows.withColumn("score", F.col("rank_reciprocal")), setting="rank"),
        _tagged(lambda: means.withColumn("score", F.coalesce("encoded", "prior")), setting="domain"),
    ]
    trees = fitted.where("section = 'content_rank' or section = 'floor' and rep = 0")
    setting = F.when(F.col("section") == "floor", F.concat(F.lit("content_by_"), "setting")).otherwise(F.col("setting"))
    return gather(jobs, "predictor-scores").unionByName(trees.select(setting.alias("setting"), *_KEYS, "score"))


def _ranking(scores: DataFrame) -> DataFrame:
    """Pooled AP, mean AP of a query, and precision at 3, of each predictor, with the share of rows that it scores."""
    pooled = metrics.average_precision(scores, "score", "label", ["setting"])
    each = metrics.average_precision(scores, "score", "label", ["setting", "group"])
    mixed = each.where("positives > 0 and positives < total").groupBy("setting").agg(F.avg("ap").alias("per_query"))
    top = relational.top_k(scores, ["setting", "group"], [F.desc("score"), F.col("row_id")], 3)
    enough = each.where("positives > 0 and total >= 3").select("setting", "group")
    at3 = top.join(enough, ["setting", "group"], "left_semi").groupBy("setting").agg(F.avg("label").alias("at3"))
    wide = pooled.join(mixed, "setting", "left").join(at3, "setting", "left")
    return _long(wide, "ranking", "setting", pooled_ap=F.col("ap"), per_query_ap=F.col("per_query"), precision_at_3=F.col("at3"), rows=F.col("total"))


def _calibrated(scores: dict[str, DataFrame], section: str = "calibration") -> DataFrame:
    """Mean gap over ten quantile bins, mean score and mean label, of each scored frame."""
    parts = []
    for name, own in scores.items():
        gap = metrics.calibration(own, "score", "label").agg(F.avg("gap").alias("gap"))
        both = gap.crossJoin(own.agg(F.avg("score").alias("score"), F.avg("label").alias("label")))
        parts.append(_long(both, section, F.lit(name), error=F.col("gap"), mean_score=F.col("score"), mean_label=F.col("label")))
    return _union(parts)


def _holdouts(scores: DataFrame) -> DataFrame:
    """AP over repeated holdouts of a fifth of the groups."""
    ap = metrics.average_precision(scores, "score", "label", ["setting", "rep"]).where("positives > 0 and positives < total")
    each = ap.groupBy("setting").agg(F.avg("ap").alias("m"), F.stddev_pop("ap").alias("s"), F.min("ap").alias("lo"), F.max("ap").alias("hi"), F.count("*").alias("n"))
    return _long(each, "holdout", "setting", mean_ap=F.col("m"), sd=F.col("s"), low=F.col("lo"), high=F.col("hi"), splits=F.col("n"))


def _clustered(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Odds of each flag among queries with a citation; p naive, by page and by domain."""
    having = rows.where("label > 0").select("group").distinct()
    population = stage(rows.join(having, "group", "left_semi"), "clustered-rows")
    found = []
    for flag in ("has_schema", "has_faq"):
        fit = inference.clustered_logit(population, flag, "label", ["page", "domain"])
        found += [("inference", flag, k, float(fit[k])) for k in ("odds_ratio", "p_naive", "p_page", "p_domain")]
    return spark.createDataFrame(found, "section string, setting string, metric string, value double")


@query("definitive_analysis")
def definitive_analysis(spark: SparkSession, folder: str, permutations: int = PERMUTATIONS, holdouts: int = HOLDOUTS) -> DataFrame:
    """Floor by refits on shuffled labels, ranking metrics of all predictors, calibration, holdouts and clustered inference."""
    rows = training_rows(spark, folder)
    wide = _with_folds(_with_folds(rows, "fold_query", "group"), "fold_domain", "domain")
    wide = validation.double_blocked(wide, "group", "domain", 5, 42)
    for rep in range(1, permutations + 1):
        shuffled = validation.shuffle_within(rows, ["group"], "row_id", "label", rep)
        wide = wide.join(shuffled.select("row_id", F.col("label").alias(f"label_{rep}")), "row_id", "left")
    wide = stage(wide, "definitive-rows")
    fits = _blocked_fits("content_rank", "content_rank_double_blocked", 0)
    for rep in range(permutations + 1):
        own = {"label": f"label_{rep}" if rep else "label", "numeric": CONTENT_FEATURES}
        fits += _blocked_fits("floor", "double_blocked", rep, **own)
        for name in ("query", "domain"):
            fits += _fold_fits("floor", name, rep, f"fold_{name}", **own)
    for name in ("query", "domain"):
        fits += _fold_fits("calibration", name, 0, f"fold_{name}")
    fits += _holdout_fits({"query": "group", "domain": "domain"}, holdouts)
    scores = stage(fit_and_score(wide, fits, **models.ORIGINAL), "definitive-scores")
    full = scores.where("section = 'calibration'")
    by_query = wide.where("fold_query is not null").withColumn("fold", F.col("fold_query"))
    return _union(
        [
            _floor(scores.where("section = 'floor'")),
            _ranking(_predictors(rows, by_query, scores)),
            _calibrated({name: full.where(F.col("setting") == name) for name in ("query", "domain")}),
            _holdouts(scores.where("section = 'holdout'")),
            _clustered(spark, rows),
        ]
    )


@query("generalisation_matrix")
def generalisation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """(features, grouping, mean_ap, sd_ap, roc_auc): four sets of features when folds keep queries, domains or pages together."""
    rows = training_rows(spark, folder)
    sets = {"content": CONTENT_FEATURES, "content_rank": ALL_FEATURES, "page_constant": PAGE_CONSTANT, "query_dependent": QUERY_DEPENDENT}
    jobs = []
    for grouping, column in (("query", "group"), ("domain", "domain"), ("page", "page")):
        own = folded(rows, column)
        for name, features in sets.items():
            for k in range(5):

                def job(own: DataFrame = own, features: list[str] = features, k: int = k) -> DataFrame:
                    return models.positive_score(_make(features)().fit(own.where(F.col("fold") != k)), own.where(F.col("fold") == k), *_KEYS)

                jobs.append(_tagged(job, features=name, grouping=grouping, fold=k))
    scores = gather(jobs, "matrix-scores")
    by = ["features", "grouping", "fold"]
    each = metrics.average_precision(scores, "score", "label", by).join(metrics.roc_auc(scores, "score", "label", by), by)
    return each.groupBy("features", "grouping").agg(
        F.round(F.avg("ap"), 4).alias("mean_ap"), F.round(F.stddev_pop("ap"), 4).alias("sd_ap"), F.round(F.avg("auc"), 4).alias("roc_auc")
    )


def bootstrap_difference(scores: DataFrame, a: str, b: str, replicates: int, seed: int) -> DataFrame:
    """(mean, low, high, share_above): AP of model ``b`` minus that of ``a`` over resamples of the groups.

    ``scores`` are (setting, group, label, score).
    """
    own = scores.where(F.col("setting").isin(a, b))
    ap = metrics.resampled_ap(own, "group", "score", "label", "setting", replicates, seed)
    gap = ap.groupBy("rep").agg((F.max(F.when(F.col("setting") == b, F.col("ap"))) - F.max(F.when(F.col("setting") == a, F.col("ap")))).alias("gap"))
    return gap.agg(  # one row a replicate
        F.avg("gap").alias("mean"), F.percentile("gap", F.lit(0.025)).alias("low"), F.percentile("gap", F.lit(0.975)).alias("high"),
        F.avg((F.col("gap") > 0).cast("double")).alias("share_above"),
    )


@query("final_analysis")
def final_analysis(spark: SparkSession, folder: str, holdouts: int = HOLDOUTS_LONG, resamples: int = RESAMPLES) -> DataFrame:
    """Population, calibration with and without class weights, holdouts, paired bootstrap, failed crawls and sparse features.

    The first section, generalisation, is ``generalisation_matrix``.
    """
    rows = training_rows(spark, folder)
    having = rows.where("label > 0").select("group").distinct()
    crawled = F.col("crawl_ok") == 1
    wide = _with_folds(rows, "fold_all", "group")
    wide = wide.join(validation.balanced_folds(rows.join(having, "group", "left_semi"), "group", 5).withColumnRenamed("fold", "fold_with_citation"), "group", "left")
    wide = wide.join(validation.balanced_folds(rows.where(crawled), "group", 5).withColumnRenamed("fold", "fold_crawl_ok"), "group", "left")
    wide = stage(wide, "final-rows")
    n, positive = wide.where("fold_all is not null").agg(F.count("*"), F.sum("label")).first()
    balanced = tuple(n / (2 * max(1, x)) for x in (n - (positive or 0), positive or 0))
    fits = []
    for name, own in (("all", None), ("with_citation", None), ("crawl_ok", crawled)):
        fits += _fold_fits("final", name, 0, f"fold_{name}", own, numeric=CONTENT_FEATURES)
    fits += _fold_fits("final", "unweighted", 0, "fold_all") + _fold_fits("final", "weighted", 0, "fold_all", weights=balanced)
    fits += _holdout_fits({"query": "group"}, holdouts)
    fitted = stage(fit_and_score(wide, fits, trees=models.REPEATED_TREES), "final-scores")
    scores = fitted.where("section = 'final'")
    ap = metrics.average_precision(scores, "score", "label", ["setting"])
    rate = F.col("positives") / F.col("total")
    population = _long(ap.where("setting in ('all', 'with_citation', 'crawl_ok')"), "population", "setting", pr_auc=F.col("ap"), prevalence=rate, lift=F.col("ap") / rate, rows=F.col("total"))
    calibration = _calibrated({name: scores.where(F.col("setting") == name) for name in ("unweighted", "weighted")})
    difference = bootstrap_difference(scores, "all", "unweighted", resamples, 11)
    bootstrap = _long(
        difference, "bootstrap", F.lit("content_rank minus content"), mean=F.col("mean"), low=F.col("low"), high=F.col("high"),
        share_above=F.col("share_above"), real=(F.col("low") > 0).cast("int"),
    )
    crawls = rows.agg(
        F.count_if(F.col("crawl_ok") == 0).alias("n"), F.avg(F.when(F.col("crawl_ok") == 0, F.col("label"))).alias("failed"),
        F.avg(F.when(F.col("crawl_ok") == 1, F.col("label"))).alias("ok"),
    )
    robustness = _long(crawls, "crawl", F.lit("failed"), rows=F.col("n"), rate_failed=F.col("failed"), rate_ok=F.col("ok"))
    flags = ["is_forum", "is_video", "has_faq", "has_schema"]
    counts = rows.unpivot([], flags, "flag", "v").groupBy("flag").agg(F.count_if(F.col("v") == 1).alias("n"))
    sparse = _long(counts, "sparse", "flag", positive=F.col("n"), too_few=(F.col("n") < 150).cast("int"))
    return _union([population, calibration, _holdouts(fitted.where("section = 'holdout'")), bootstrap, robustness, sparse])


def shuffled_column(df: DataFrame, key: str, value: str, seed: int) -> DataFrame:
    """``df`` with ``value`` permuted over all rows: the row at each rank of the keys gets the value at that rank of a hash.

    Keys must be unique. Both orders are sorted in ranges; no task sees all rows.
    """
    own = ranges.positions(df, [key])
    there = ranges.positions(df.select(F.xxhash64(key, F.lit(seed)).alias("_h"), F.col(key).alias("_k"), F.col(value).alias("_v")), ["_h", "_k"])
    return own.drop(value).join(there.select("rank", F.col("_v").alias(value)), "rank").drop("rank")


@query("permutation_importance")
def permutation_importance(spark: SparkSession, folder: str, shuffles: int = SHUFFLES) -> DataFrame:
    """(feature, drop, sd): loss of AP on a held-out fifth of the queries when a feature's values are shuffled, over repeats."""
    rows = folded(training_rows(spark, folder))
    train, test = rows.where("fold <> 4"), stage(rows.where("fold = 4"), "held-rows")
    fitted = models.gbt(CONTENT_FEATURES, ["content_type"], trees=models.TREES).fit(train)

    def scored(feature: str, rep: int) -> DataFrame:
        return models.positive_score(fitted, shuffled_column(test, "row_id", feature, rep) if feature else test, *_KEYS)

    jobs = [_tagged(partial(scored, "", 0), feature="", rep=0)]
    jobs += [_tagged(partial(scored, f, rep), feature=f, rep=rep) for f in CONTENT_FEATURES for rep in range(shuffles)]
    ap = metrics.average_precision(gather(jobs, "shuffled-scores"), "score", "label", ["feature", "rep"])
    whole = ap.where("feature = ''").select(F.col("ap").alias("whole"))
    loss = F.col("whole") - F.col("ap")
    return ap.where("feature <> ''").crossJoin(F.broadcast(whole)).groupBy("feature").agg(F.avg(loss).alias("drop"), F.stddev_pop(loss).alias("sd"))


@query("shap_stability")
def shap_stability(spark: SparkSession, folder: str) -> DataFrame:
    """(feature, mean, std, cv, in_top_4, first): importance over five models, each fitted and explained without one fold."""
    rows = folded(training_rows(spark, folder))
    index = F.coalesce(F.col("type_code"), F.lit(-1.0))
    codes = validation.dense_ranks(rows, "content_type").select("content_type", F.col("rank").cast("double").alias("type_code"))
    rows = stage(rows.join(codes, "content_type", "left").withColumn("content_type_code", index), "coded-rows")
    features = [*CONTENT_FEATURES, "content_type_code"]

    def one(k: int) -> DataFrame:
        train = rows.where(F.col("fold") != k)
        fitted = models.gbt(features, trees=models.TREES).fit(train)
        own = models.explained(fitted.stages[-1], fitted.stages[0].transform(train), "row_id")
        return models.mean_importance(own, features).withColumn("fold", F.lit(k))

    parts = gather([partial(one, k) for k in range(5)], "importances")
    w = Window.partitionBy("fold").orderBy(F.desc("importance"), "feature")  # one row a feature
    placed = parts.withColumn("r", F.row_number().over(w))
    return placed.groupBy("feature").agg(
        F.avg("importance").alias("mean"),
        F.stddev_samp("importance").alias("std"),
        (F.stddev_samp("importance") / F.nullif(F.avg("importance"), F.lit(0.0))).alias("cv"),
        F.count_if(F.col("r") <= 4).alias("in_top_4"),
        F.count_if(F.col("r") == 1).alias("first"),
    )


@query("hardening")
def hardening(spark: SparkSession, folder: str) -> DataFrame:
    """One holdout of a fifth of the queries: its scores against prevalence, and its calibration."""
    rows = training_rows(spark, folder)
    held = stage(_held_out(rows, "group", ALL_FEATURES, 42), "hardening-scores")
    auc = metrics.roc_auc(held, "score", "label")
    ap = metrics.average_precision(held, "score", "label").crossJoin(auc).crossJoin(held.agg(F.countDistinct("group").alias("queries")))
    rate = F.col("positives") / F.col("total")
    tested = _long(ap, "holdout", F.lit("query"), pr_auc=F.col("ap"), roc_auc=F.col("auc"), prevalence=rate, lift=F.col("ap") / rate, rows=F.col("total"), queries=F.col("queries"))
    return tested.unionByName(_calibrated({"query": held}))


@query(
    "stored_checks",
    "WITH r AS (SELECT avg(cited) FILTER (organic_rank <> 101) AS rate, count(*) FILTER (organic_rank = 101) AS sentinel, avg(cited) FILTER (organic_rank = 101) AS cited, "
    "avg(cited) FILTER (organic_rank <> 101 AND is_video = 1) AS video, count(*) - count(DISTINCT row_id) AS repeated FROM candidates) "
    "SELECT 'citation rate of ranked pages' AS name, round(rate, 6) AS value, rate BETWEEN 0.05 AND 0.95 AS passed FROM r UNION ALL "
    "SELECT 'sentinel rows', sentinel::DOUBLE, sentinel > 0 FROM r UNION ALL SELECT 'citation rate of sentinel rows', round(cited, 6), cited = 1 FROM r UNION ALL "
    "SELECT 'citation rate of ranked video pages', round(video, 6), video < rate FROM r UNION ALL SELECT 'repeated row ids', repeated::DOUBLE, repeated = 0 FROM r",
)
def stored_checks(spark: SparkSession, folder: str) -> DataFrame:
    """(name, value, passed): consistency checks over the stored candidates, recorded as rows."""
    on = ranked()
    r = candidates(spark, folder).agg(
        F.avg(F.when(on, F.col("cited"))).alias("rate"), F.count_if(~on).alias("sentinel"), F.avg(F.when(~on, F.col("cited"))).alias("cited"),
        F.avg(F.when(on & (F.col("is_video") == 1), F.col("cited"))).alias("video"), (F.count("*") - F.countDistinct("row_id")).alias("repeated"),
    )
    checks = {
        "citation rate of ranked pages": (F.round("rate", 6), F.col("rate").between(0.05, 0.95)),
        "sentinel rows": (F.col("sentinel"), F.col("sentinel") > 0),
        "citation rate of sentinel rows": (F.round("cited", 6), F.col("cited") == 1),
        "citation rate of ranked video pages": (F.round("video", 6), F.col("video") < F.col("rate")),
        "repeated row ids": (F.col("repeated"), F.col("repeated") == 0),
    }
    return r.select(F.inline(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("double").alias("value"), p.alias("passed")) for k, (v, p) in checks.items()))))
