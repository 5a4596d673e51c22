"""Models with pyspark.ml: gradient-boosted trees, logistic regression, out-of-fold scores, tree attributions, themes."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    NGram,
    Normalizer,
    OneHotEncoder,
    RegexTokenizer,
    StandardScaler,
    StopWordsRemover,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelens.functions.text import QUESTION_STOP_WORDS
from citelens.operators import validation
from citelens.staging import stage


def feature_frame(
    df: DataFrame, label: str, group: str, numeric: Sequence[str] | None, categorical: Sequence[str] | None, keep: Sequence[str] = ()
) -> DataFrame:
    """(keep, group, label as double, numeric as double, categorical); at least one list of features must be given."""
    if numeric is None and categorical is None:
        raise ValueError("give the numeric or the categorical features")
    return df.select(
        *keep,
        F.col(group).alias("group"),
        F.col(label).cast("double").alias("label"),
        *(F.col(c).cast("double").alias(c) for c in numeric or ()),
        *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in categorical or ()),
    )


#: Boosting rounds of single fits, and of each fit of an analysis that repeats them; both are parameters everywhere.
TREES, REPEATED_TREES = 40, 10
#: Rounds, step, leaves, rows a leaf, bins and features of a tree in the original's repeated fits; each round has all rows.
ORIGINAL = {"trees": 300, "step": 0.05, "depth": None, "leaves": 31, "least_rows": 20, "bins": 255, "columns": 0.9, "share": 1.0}
#: Rounds without a better held-out loss after which a fit with early stopping ends.
PATIENCE = 10


def gbt(
    numeric: Sequence[str], categorical: Sequence[str] = (), trees: int = REPEATED_TREES, depth: int = 4, step: float = 0.1, seed: int = 42,
    weight: str | None = None,
) -> Pipeline:
    """Boosted trees; categories as indices by frequency, unknown ones as one more."""
    index = [StringIndexer(inputCol=c, outputCol=f"_{c}", handleInvalid="keep") for c in categorical]
    assemble = VectorAssembler(inputCols=[*numeric, *(f"_{c}" for c in categorical)], outputCol="features", handleInvalid="keep")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, subsamplingRate=0.8, minInstancesPerNode=10)
    if weight:
        model.setWeightCol(weight)
    return Pipeline(stages=[*index, assemble, model])


def best_iteration(losses: Sequence[float], patience: int) -> int:
    """The number of rounds with the smallest loss, looking no further than ``patience`` rounds past the best so far."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_stopped(
    train: DataFrame, make: Callable[[int], Pipeline], trees: int = TREES, patience: int = PATIENCE, share: float = 0.2, seed: int = 42
) -> tuple[PipelineModel, int]:
    """(model, rounds): the held-out ``share`` of the training groups chooses the rounds; they are never fitted on.

    A fit of fewer rounds has the same first trees, so the shorter model is the longer one cut off.
    """
    split = validation.group_holdout(train, "group", share, seed)
    inner, held = split.where("held = 0"), split.where("held = 1")
    whole = make(trees).fit(inner)
    if held.isEmpty():
        return whole, trees
    losses = whole.stages[-1].evaluateEachIteration(PipelineModel(whole.stages[:-1]).transform(held))
    rounds = best_iteration(losses, patience)
    return (whole if rounds == trees else make(rounds).fit(inner)), rounds


def out_of_fold_stopped(
    df: DataFrame, fold: str, k: int, make: Callable[[int], Pipeline], *keep: str, trees: int = TREES, patience: int = PATIENCE, threads: int = 8
) -> tuple[DataFrame, list[int]]:
    """((keep, fold, score), rounds of each fold): as ``out_of_fold``, each fit with early stopping within its training folds."""

    def one(f: int) -> tuple[DataFrame, int]:
        model, rounds = fit_stopped(df.where(F.col(fold) != f), make, trees, patience)
        return positive_score(model, df.where(F.col(fold) == f), *keep, fold), rounds

    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(one, range(k)))
    return reduce(DataFrame.unionByName, (p for p, _ in parts)), [n for _, n in parts]


def logreg(numeric: Sequence[str], categorical: Sequence[str], rows: int) -> Pipeline:
    """Standardised numbers, one-hot categories, balanced class weights in the column ``weight``, L2 of 1/rows."""
    index = [StringIndexer(inputCol=c, outputCol=f"_{c}", handleInvalid="keep") for c in categorical]
    hot = [OneHotEncoder(inputCols=[f"_{c}" for c in categorical], outputCols=[f"_h_{c}" for c in categorical], dropLast=False)] if categorical else []
    numbers = VectorAssembler(inputCols=list(numeric), outputCol="_numbers", handleInvalid="keep")
    scale = StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)
    assemble = VectorAssembler(inputCols=["_scaled", *(f"_h_{c}" for c in categorical)], outputCol="features")
    model = LogisticRegression(weightCol="weight", regParam=1 / max(1, rows), standardization=False, maxIter=1000)
    return Pipeline(stages=[*index, *hot, numbers, scale, assemble, model])


def balanced(df: DataFrame) -> DataFrame:
    """``df`` with ``weight``: rows / (2 * rows of the class)."""
    totals = df.agg(F.count("*").alias("_n"), F.sum("label").alias("_p"))
    own = F.when(F.col("label") == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p"))
    return df.crossJoin(F.broadcast(totals)).withColumn("weight", F.col("_n") / (2 * own)).drop("_n", "_p")


def positive_score(model: Model, df: DataFrame, *keep: str) -> DataFrame:
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("score"))


def out_of_fold(df: DataFrame, fold: str, k: int, make: Callable[[], Estimator], *keep: str, threads: int = 4) -> DataFrame:
    """(keep, fold, score): each fold scored by a model of the other folds; independent fits are submitted together."""

    def one(f: int) -> DataFrame:
        train, test = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
        return positive_score(make().fit(train), test, *keep, fold)

    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(one, range(k)))
    return reduce(DataFrame.unionByName, parts)


def double_blocked_scores(df: DataFrame, k: int, make: Callable[[], Estimator], *keep: str, least: int = 20) -> DataFrame:
    """(keep, fold, score): fold f scores rows whose both folds are f with a model of rows that have neither; others are unscored.

    A fold with fewer than ``least`` test rows, or with one class only to train on, is left out.
    """
    out = None
    for f in range(k):
        test = df.where((F.col("fold_a") == f) & (F.col("fold_b") == f))
        train = df.where((F.col("fold_a") != f) & (F.col("fold_b") != f))
        classes = train.agg(F.min("label"), F.max("label")).first()
        if test.count() < least or classes[0] == classes[1]:
            continue
        part = positive_score(make().fit(train), test.withColumn("fold", F.lit(f)), *keep, "fold")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.select(*keep, F.lit(0).alias("fold"), F.lit(None).cast("double").alias("score")).limit(0)
    return out


# --- attributions -----------------------------------------------------------------------------------------------------

#: A leaf: value times the tree's weight, and for each feature on its path (low, high, share of rows that go this way).
Leaf = tuple[float, dict[int, tuple[float, float, float]]]


def leaves(model: Model) -> list[Leaf]:
    """The leaves of all trees of a boosted model, with continuous splits."""
    out: list[Leaf] = []

    def walk(node, weight: float, path: dict[int, tuple[float, float, float]]) -> None:
        if node.subtreeDepth() == 0:
            out.append((weight * node.prediction(), path))
            return
        split = node.split()
        feature, threshold = split.featureIndex(), split.threshold()
        whole = float(node.impurityStats().count())
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            low, high, share = path.get(feature, (-math.inf, math.inf, 1.0))
            part = float(child.impurityStats().count()) / whole if whole else 0.5
            bounds = (low, min(high, threshold)) if left else (max(low, threshold), high)
            walk(child, weight, path | {feature: (*bounds, share * part)})

    for tree, weight in zip(model.trees, model.treeWeights):
        walk(tree._java_obj.rootNode(), weight, {})
    return out


def shap_values(matrix: np.ndarray, all_leaves: list[Leaf]) -> tuple[np.ndarray, float]:
    """(attributions rows x features, base value) of the margin, path-dependent.

    For one leaf the value of a known set of features is the leaf's value times, over its path, whether a known feature lets
    the row through, or the share of rows that go this way for an unknown one. Shapley values of such products are summed over
    the subsets of the path's features, of which there are few.
    """
    phi, base = np.zeros(matrix.shape), 0.0
    for value, path in all_leaves:
        features = list(path)
        d = len(features)
        shares = [path[f][2] for f in features]
        base += value * math.prod(shares)
        passes = [((matrix[:, f] > path[f][0]) & (matrix[:, f] <= path[f][1])).astype(float) for f in features]
        for i, f in enumerate(features):
            others = [j for j in range(d) if j != i]
            total = np.zeros(len(matrix))
            for size in range(d):
                w = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
                for known in combinations(others, size):
                    term = np.full(len(matrix), w)
                    for j in others:
                        term = term * (passes[j] if j in known else shares[j])
                    total += term
            phi[:, f] += value * total * (passes[i] - shares[i])
    return phi, base


def explained(model: Model, assembled: DataFrame, *keep: str) -> DataFrame:
    """(keep, phi array<double>, base, margin) of rows that have ``features``."""
    own = leaves(model)
    spark = assembled.sparkSession
    shared = spark.sparkContext.broadcast(own)  # bounded by trees * 2**depth
    kind = T.StructType(
        [T.StructField("phi", T.ArrayType(T.DoubleType())), T.StructField("base", T.DoubleType()), T.StructField("margin", T.DoubleType())]
    )

    def run(features):
        import pandas as pd

        matrix = np.array(features.tolist(), float)
        phi, base = shap_values(matrix, shared.value)
        margin = np.zeros(len(matrix))
        for value, path in shared.value:
            through = np.ones(len(matrix), bool)
            for f, (low, high, _) in path.items():
                through &= (matrix[:, f] > low) & (matrix[:, f] <= high)
            margin += value * through
        return pd.DataFrame({"phi": list(phi), "base": base, "margin": margin})

    kernel = F.pandas_udf(run, kind)
    return assembled.select(*keep, kernel(vector_to_array("features")).alias("x")).select(*keep, "x.phi", "x.base", "x.margin")


def top_driver(explained_rows: DataFrame, names: Sequence[str], *keep: str) -> DataFrame:
    """(keep, driver, effect): the feature with the largest attribution, and that; ties go to the first feature."""
    pairs = F.transform("phi", lambda v, i: F.struct(F.abs(v).alias("size"), (-i).alias("neg"), v.alias("v")))
    best = F.array_max(pairs)
    label = F.element_at(F.array(*map(F.lit, names)), (1 - best["neg"]).cast("int"))
    return explained_rows.select(*keep, label.alias("driver"), F.round(best["v"], 4).alias("effect"))


def mean_importance(explained_rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, importance): mean absolute attribution."""
    each = explained_rows.select(F.posexplode("phi").alias("i", "v")).groupBy("i").agg(F.avg(F.abs("v")).alias("importance"))
    label = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    return each.select(label.alias("feature"), "importance").orderBy(F.desc("importance"), "feature")


# --- themes -----------------------------------------------------------------------------------------------------------


def question_themes(questions: DataFrame, column: str, seed: int = 42, starts: int = 10) -> tuple[DataFrame, DataFrame]:
    """((question, cluster), (cluster, terms, n)): k-means over TF-IDF of words and pairs of words, the best of several starts.

    k = min(10, max(2, questions // 40)); a term must stand in two questions, and all such terms count; a cluster's label is
    its four heaviest terms.
    """
    distinct = questions.select(F.col(column).alias("question")).where("question is not null").distinct()
    n = distinct.count()
    k = min(10, max(2, n // 40))
    words = RegexTokenizer(inputCol="question", outputCol="_all", pattern="[a-zäöüß0-9]{2,}", gaps=False)
    stop = StopWordsRemover(inputCol="_all", outputCol="_words", stopWords=QUESTION_STOP_WORDS)
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    prepared = Pipeline(stages=[words, stop, pairs]).fit(distinct).transform(distinct).withColumn("_terms", F.concat("_words", "_pairs"))
    counts = CountVectorizer(inputCol="_terms", outputCol="_tf", minDF=2.0, vocabSize=2**31 - 1)
    weights, unit = IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="features")
    vectors = Pipeline(stages=[counts, weights, unit]).fit(prepared)
    ready = stage(vectors.transform(prepared).select("question", "features"), "theme-vectors")
    with ThreadPoolExecutor(starts) as pool:
        models = list(pool.map(lambda i: KMeans(k=k, seed=seed + i, maxIter=300).fit(ready), range(starts)))
    best = min(models, key=lambda m: m.summary.trainingCost)
    out = best.transform(ready).select("question", F.col("prediction").alias("cluster"))
    vocabulary = vectors.stages[0].vocabulary
    named = [(i, ", ".join(vocabulary[j] for j in np.argsort(-c, kind="stable")[:4])) for i, c in enumerate(best.clusterCenters())]
    labels = questions.sparkSession.createDataFrame(named, "cluster int, terms string")
    sizes = out.groupBy("cluster").agg(F.count("*").alias("n"))
    return out, labels.join(sizes, "cluster")
