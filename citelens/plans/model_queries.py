"""Queries that fit models, over candidates with a true rank or over a variant's rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.operators import metrics, models, relational, validation
from citelens.plans import serp_queries
from citelens.plans.candidate_queries import domain, engineer, ranked, variant
from citelens.plans.registry import query
from citelens.plans.tables import candidates
from citelens.schemas import CANDIDATES, CONTENT_FEATURES, RANK_FEATURES
from citelens.staging import stage

IMPUTED = [c for c in CONTENT_FEATURES if c not in ("has_schema", "has_faq", "structure_score")]
ALL_FEATURES = [*RANK_FEATURES, *CONTENT_FEATURES]


def training_rows(spark: SparkSession, folder: str, name: str = "A") -> DataFrame:
    """A variant's rows: (row_id, domain, page, crawl_ok, group, label, features); missing numbers are the median.

    Variant A has the rows with a true rank, B all rows. The table is written once, since every fit and every score reads it
    again.
    """
    picked, _, categorical = variant(candidates(spark, folder), name)
    filled = relational.impute_median(picked, IMPUTED, ["has_schema", "has_faq"])
    rows = engineer(filled).withColumn("domain", F.coalesce(domain(), F.lit(""))).withColumn("page", F.coalesce("url", F.lit("")))
    made = models.feature_frame(rows, "cited", "query_id", ALL_FEATURES, categorical, ["row_id", "domain", "page", "crawl_ok"])
    return stage(made, "training-rows")


def folded(rows: DataFrame, by: str = "group", k: int = 5) -> DataFrame:
    return stage(rows.join(validation.balanced_folds(rows, by, k), by), "folded-rows")


def trees(numeric: list[str]) -> Callable[[int], Pipeline]:
    return lambda n: models.gbt(numeric, ["content_type"], trees=n)


def _stopped(rows: DataFrame, numeric: list[str], *keep: str) -> tuple[DataFrame, list[int]]:
    return models.out_of_fold_stopped(rows, "fold", 5, trees(numeric), *keep)


def _logreg(rows: DataFrame, numeric: list[str], *keep: str) -> DataFrame:
    weighted = models.balanced(rows)
    n = rows.count()
    return models.out_of_fold(weighted, "fold", 5, lambda: models.logreg(numeric, ["content_type"], n), *keep)


@query("gbt_oof")
def gbt_oof(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold scores of boosted trees on content features, grouped by query, with nested early stopping."""
    return _stopped(folded(training_rows(spark, folder)), CONTENT_FEATURES, "row_id", "group", "label")[0]


@query("gbt_oof_by_domain")
def gbt_oof_by_domain(spark: SparkSession, folder: str) -> DataFrame:
    return _stopped(folded(training_rows(spark, folder), "domain"), CONTENT_FEATURES, "row_id", "domain", "label")[0]


@query("gbt_rounds")
def gbt_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """(fold, rounds): the boosting rounds that early stopping chose; fold NULL: the final model's, their mean."""
    _, rounds = _stopped(folded(training_rows(spark, folder)), CONTENT_FEATURES, "row_id")
    rows = [*enumerate(rounds), (None, sum(rounds) // len(rounds))]
    return spark.createDataFrame(rows, "fold int, rounds int")


@query("logreg_oof")
def logreg_oof(spark: SparkSession, folder: str) -> DataFrame:
    return _logreg(folded(training_rows(spark, folder)), ALL_FEATURES, "row_id", "group", "label")


@query("double_blocked_cv")
def double_blocked_cv(spark: SparkSession, folder: str) -> DataFrame:
    rows = stage(validation.double_blocked(training_rows(spark, folder), "group", "domain", 5, 42), "blocked-rows")
    return models.double_blocked_scores(rows, 5, lambda: trees(CONTENT_FEATURES)(models.TREES), "row_id", "label")


def _compared(scores: dict[str, DataFrame]) -> DataFrame:
    """(model, pr_auc, roc_auc, positives, total) of frames with label and score."""
    long = reduce(DataFrame.unionByName, (s.select("label", "score", F.lit(name).alias("model")) for name, s in scores.items()))
    long = stage(long, "compared-scores")
    ap = metrics.average_precision(long, "score", "label", ["model"])
    return ap.join(metrics.roc_auc(long, "score", "label", ["model"]), "model").select(
        "model", F.round("ap", 4).alias("pr_auc"), F.round("auc", 4).alias("roc_auc"), "positives", "total"
    )


@query("headline_comparison")
def headline_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Pooled AP and ROC-AUC of rank alone, logistic regression, and trees without and with rank."""
    rows = folded(training_rows(spark, folder))
    return _compared(
        {
            "rank": rows.select("label", F.col("rank_reciprocal").alias("score")),
            "logreg": _logreg(rows, ALL_FEATURES, "label"),
            "gbt_content": _stopped(rows, CONTENT_FEATURES, "label")[0],
            "gbt_content_rank": _stopped(rows, ALL_FEATURES, "label")[0],
        }
    )


@query("variant_comparison")
def variant_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """(variant, model, mean_ap, std_ap): both variants end to end, the mean and spread over folds of each model's AP."""
    parts = []
    for name, numeric in (("A", ALL_FEATURES), ("B", CONTENT_FEATURES)):
        rows = folded(training_rows(spark, folder, name))
        scores = {"gbt": _stopped(rows, numeric, "label")[0], "logreg": _logreg(rows, numeric, "label")}
        if name == "A":
            scores["rank"] = rows.select("label", "fold", F.col("rank_reciprocal").alias("score"))
        parts += [s.select("label", "score", "fold", F.lit(m).alias("model"), F.lit(name).alias("variant")) for m, s in scores.items()]
    long = stage(reduce(DataFrame.unionByName, parts), "variant-scores")
    each = metrics.average_precision(long, "score", "label", ["variant", "model", "fold"])
    floor = long.groupBy("variant", "fold", "model").agg(F.avg("label").alias("ap")).where("model = 'gbt'").withColumn("model", F.lit("prevalence"))
    both = each.select("variant", "fold", "model", "ap").unionByName(floor)
    return both.groupBy("variant", "model").agg(F.round(F.avg("ap"), 4).alias("mean_ap"), F.round(F.stddev_pop("ap"), 4).alias("std_ap"))


def _final(rows: DataFrame, numeric: list[str]) -> tuple[DataFrame, DataFrame]:
    """(explained rows, out-of-fold scores): the final model of all rows has the mean of the folds' rounds."""
    scores, rounds = _stopped(folded(rows), numeric, "row_id", "group", "label")
    fitted = models.gbt(numeric, trees=sum(rounds) // len(rounds)).fit(rows)
    return models.explained(fitted.stages[-1], fitted.stages[0].transform(rows), "row_id", "label"), scores


@query("shap_top_driver")
def shap_top_driver(spark: SparkSession, folder: str) -> DataFrame:
    return models.top_driver(_final(training_rows(spark, folder), ALL_FEATURES)[0], ALL_FEATURES, "row_id")


@query("shap_importance")
def shap_importance(spark: SparkSession, folder: str) -> DataFrame:
    return models.mean_importance(_final(training_rows(spark, folder), ALL_FEATURES)[0], ALL_FEATURES)


@query("gap_extract")
def gap_extract(spark: SparkSession, folder: str) -> DataFrame:
    """The flat scored extract: the contractual columns, both models' out-of-fold scores, the prediction at the best F1, uncited
    rows that are predicted, and each row's strongest driver with its attribution."""
    rows = training_rows(spark, folder)
    explained, scores = _final(rows, ALL_FEATURES)
    scores = stage(scores, "gap-scores")
    best = metrics.best_f1(scores, "score", "label").select("threshold")
    linear = _logreg(folded(rows), ALL_FEATURES, "row_id").select("row_id", F.round("score", 4).alias("probability_logreg"))
    drivers = models.top_driver(explained, ALL_FEATURES, "row_id")
    contract = [x.split()[0] for x in CANDIDATES.split(", ")]
    predicted = (F.col("score") >= F.col("threshold")).cast("int")
    return (
        candidates(spark, folder).where(ranked()).select("row_id", *contract)
        .join(scores.select("row_id", "score"), "row_id").join(linear, "row_id").join(drivers, "row_id").crossJoin(F.broadcast(best))
        .select(
            "row_id", *contract,
            F.round("score", 4).alias("probability"), "probability_logreg", predicted.alias("predicted"),
            ((predicted == 1) & (F.col("cited") == 0)).cast("int").alias("gap"), "driver", "effect", F.round("threshold", 4).alias("threshold"),
        )
    )


@query("question_themes")
def question_themes(spark: SparkSession, folder: str) -> DataFrame:
    out, labels = models.question_themes(serp_queries.paa_questions(spark, folder), "question")
    return out.join(labels, "cluster")
