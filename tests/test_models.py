"""Models on invented rows: order of quality and local accuracy of attributions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelens.operators import metrics, models, similarity, validation, windows
from citelens.sources.readers import synthetic_candidates

NUMERIC = ["organic_rank", "word_count", "query_url_similarity", "passage_match_score", "has_schema"]


@pytest.fixture(scope="module")
def rows(spark):
    df = synthetic_candidates(spark, 60, 3).withColumn("id", F.xxhash64("url"))
    made = models.feature_frame(df, "cited", "query_id", NUMERIC, ["content_type"], ["id"])
    return made.join(validation.balanced_folds(made, "group", 3), "group").cache()


def test_guard(rows):
    with pytest.raises(ValueError):
        models.feature_frame(rows, "label", "group", None, None)


def test_scores_beat_prevalence(rows):
    base = rows.agg(F.avg("label")).first()[0]
    for make in (lambda: models.gbt(NUMERIC, ["content_type"], trees=5), lambda: models.logreg(NUMERIC, ["content_type"], 1000)):
        scored = models.out_of_fold(models.balanced(rows), "fold", 3, make, "id", "label")
        assert scored.count() == rows.count()
        assert metrics.average_precision(scored, "score", "label").first()["ap"] > base


def test_best_iteration():
    assert models.best_iteration([3, 2, 2, 1, 5, 0], 2) == 6 and models.best_iteration([3, 2, 2, 2, 0], 2) == 2
    assert models.best_iteration([1.0], 5) == 1


def test_early_stopping_keeps_to_the_training_folds(rows):
    make = lambda n: models.gbt(NUMERIC, ["content_type"], trees=n, depth=3)
    model, rounds = models.fit_stopped(rows.where("fold <> 0"), make, 8, 2)
    assert 1 <= rounds <= 8 and len(model.stages[-1].trees) == rounds
    scores, each = models.out_of_fold_stopped(rows, "fold", 3, make, "id", "label", trees=4, patience=2)
    assert scores.count() == rows.count() and len(each) == 3
    whole, longer = make(4).fit(rows).stages[-1], make(6).fit(rows).stages[-1]
    first = [[t.toDebugString.split("\n", 1)[1] for t in m.trees[:4]] for m in (whole, longer)]
    assert first[0] == first[1]


def test_bootstrap_difference(spark):
    from citelens.plans.programs import bootstrap_difference, shuffled_column

    rows = [(m, f"g{i % 20}", i % 3 == 0, (i % 3 == 0) * (m == "b") + (i * 7 % 11) / 20) for i in range(400) for m in "ab"]
    got = bootstrap_difference(spark.createDataFrame([(m, g, int(y), float(s)) for m, g, y, s in rows], "setting string, group string, label int, score double"), "a", "b", 50, 3).first()
    assert got["mean"] > 0.3 and got["low"] > 0 and got["share_above"] == 1.0 and got["low"] <= got["mean"] <= got["high"]
    df = spark.createDataFrame([(i, i * 10) for i in range(50)], "k int, v int")
    mixed = {r["k"]: r["v"] for r in shuffled_column(df, "k", "v", 1).collect()}
    assert sorted(mixed.values()) == [i * 10 for i in range(50)] and mixed != {i: i * 10 for i in range(50)}


def test_attributions_add_up(rows):
    fitted = models.gbt(NUMERIC, trees=4, depth=3).fit(rows)
    assembled = fitted.stages[0].transform(rows)
    out = models.explained(fitted.stages[-1], assembled, "id")
    own = fitted.stages[-1].transform(assembled).select("id", "rawPrediction")
    for r in out.join(own, "id").limit(200).collect():
        assert sum(r["phi"]) + r["base"] == pytest.approx(r["margin"], abs=1e-9)
        assert r["margin"] == pytest.approx(r["rawPrediction"][1], abs=1e-9)
    assert models.mean_importance(out, NUMERIC).count() == len(NUMERIC)
    assert {r["driver"] for r in models.top_driver(out, NUMERIC, "id").collect()} <= set(NUMERIC)


def test_shap_of_one_split():
    leaves = [(1.0, {0: (-np.inf, 0.5, 0.25)}), (3.0, {0: (0.5, np.inf, 0.75)})]
    phi, base = models.shap_values(np.array([[0.0, 9.0], [1.0, 9.0]]), leaves)
    assert base == 2.5 and phi[:, 0].tolist() == [-1.5, 0.5] and phi[:, 1].tolist() == [0, 0]


def test_nearest_vectors(spark):
    r = np.random.default_rng(0)
    m = r.normal(size=(300, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(3)
    got = similarity.nearest_vectors(df, "id", "v", df.where("id % 50 = 0"), 4, block=2).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        s = unit @ unit[q]
        s[q] = -9
        assert [x["id"] for x in sorted((x for x in got if x["query"] == q), key=lambda x: x["position"])] == list(np.argsort(-s)[:4])


def test_runs_and_windows(spark):
    df = spark.createDataFrame([(["a", "b", "c", "a"], ["x", "b", "c", "a"]), ([], ["a"]), (None, ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(similarity.longest_common_run("a", "b")).collect()] == [3, 0, None]
    snippets = [(0.0, "eins"), (29.0, "zwei"), (31.0, "drei"), (40.0, "vier"), (90.0, "")]
    one = spark.createDataFrame([(1, snippets), (2, [])], "id int, s array<struct<start:double,text:string>>")
    tumbling = one.where("id = 1").select(windows.tumbling_windows(F.col("s"))).first()[0]
    assert [(w["start"], w["text"]) for w in tumbling] == [(0.0, "eins zwei drei"), (31.0, "vier ")]
    sliding = {r["start"]: r["text"] for r in windows.sliding_windows(one, "id", "s").collect()}
    assert sliding[0.0] == "eins zwei drei vier" and sliding[15.0] == "zwei drei vier" and 90.0 not in sliding
    spans = spark.createDataFrame([(1, 0.0, 30.0), (1, 30.0, 50.0)], "id int, a double, b double")
    at = spark.createDataFrame([(1, 29.9), (1, 30.0), (1, 50.0)], "id int, t double")
    assert sorted(r["a"] for r in windows.contained(at, spans, "id", "t", "a", "b", 10.0).collect()) == [0.0, 30.0]


def test_themes(spark):
    q = spark.createDataFrame([(f"was kostet ein gutachten in stadt {i % 3}",) for i in range(30)] + [(f"wie finde ich einen makler {i % 4}",) for i in range(30)], "q string")
    out, labels = models.question_themes(q, "q")
    assert out.count() == 7 and labels.count() == 2


def test_many_fits_grow_the_trees_of_single_ones(rows):
    from citelens.operators import many_fits

    numbered = rows.withColumn("other", 1 - F.col("label")).cache()
    scale = {"organic_rank": 4, "word_count": 600, "query_url_similarity": 0.15, "passage_match_score": 0.15}
    few = numbered.withColumns({c: F.least(F.round(F.col(c) / m), F.lit(9.0)) for c, m in scale.items()})
    fits = [
        many_fits.Fit({"name": n, "fold": k}, F.col("fold") != k, F.col("fold") == k, label, NUMERIC)
        for n, label in (("own", "label"), ("other", "other")) for k in range(3)
    ] + [many_fits.Fit({"name": "none", "fold": 0}, F.col("fold") < 0, F.col("fold") == 0, "label", NUMERIC, least=1)]
    got = many_fits.fit_and_score(few, fits, key="id", trees=5, share=1.0).cache()
    assert {r["name"] for r in got.select("name").distinct().collect()} == {"own", "other"}
    assert got.where("name = 'own'").count() == rows.count()

    def make():
        one = models.gbt(NUMERIC, ["content_type"], trees=5)
        one.getStages()[-1].setSubsamplingRate(1.0).setMaxBins(256)
        return one

    for name, label in (("own", "label"), ("other", "other")):
        expected = models.out_of_fold(few.withColumn("label", F.col(label)), "fold", 3, make, "id")
        both = expected.withColumnRenamed("score", "e").join(got.where(F.col("name") == name), "id")
        assert both.count() == rows.count()
        assert both.where("abs(e - score) > 1e-9").count() == 0


def test_definitive_analysis_grows_the_original_trees(spark, monkeypatch):
    """300 rounds of 31 leaves on all rows, as in the original analysis, not ten small trees."""
    from citelens.plans import programs

    seen = {}

    class Stop(Exception):
        pass

    def record(rows, fits, **how):
        seen.update(how, fits=len(fits))
        raise Stop

    few = spark.createDataFrame([(1, "q", "d", 1.0)], "row_id bigint, group string, domain string, label double")
    monkeypatch.setattr(programs, "training_rows", lambda *_: few)
    monkeypatch.setattr(programs, "_with_folds", lambda rows, name, by: rows.withColumn(name, F.lit(0)))
    monkeypatch.setattr(programs, "stage", lambda df, label: df)
    monkeypatch.setattr(programs, "fit_and_score", record)
    with pytest.raises(Stop):
        programs.definitive_analysis(spark, "")
    assert seen == {"trees": 300, "step": 0.05, "depth": None, "leaves": 31, "least_rows": 20, "bins": 255, "columns": 0.9, "share": 1.0, "fits": 165}


def test_trees_open_leaves_by_gain(monkeypatch):
    from citelens.operators import many_fits

    r = np.random.default_rng(5)
    widths, n = [2, 3, 40, 200, 2, 4], 4000
    bins = np.stack([r.integers(0, w, n) for w in widths]).astype(np.uint8)
    y = r.random(n) < np.where((bins[2] > 20) ^ (bins[3] > 90), 0.8, 0.2) * np.where(bins[5] == 2, 0.5, 1)

    def grown(weights=(1.0, 1.0), bins=bins, y=y, **other):
        how = {"trees": 4, "step": 0.05, "depth": None, "leaves": 31, "least_rows": 20, "share": 1.0, "columns": 1.0, "seed": 1} | other
        blocks = ((bins[:, a : a + 700], y[a : a + 700], np.arange(a, min(a + 700, n)).astype(np.uint64)) for a in range(0, n, 700))
        return many_fits.grow(blocks, n, widths, weights, many_fits.Growth(**how))

    forest = grown()
    for at in range(4):
        sizes = np.unique(forest.values(at, bins), return_counts=True)[1]
        assert (forest.feature[at] >= 0).sum() == 30 and sizes.min() >= 20 and sizes.sum() == n
    assert all(len(grown(leaves=None, depth=d).feature[0]) == 2 ** (d + 1) - 1 for d in (1, 3))
    # the first split, counted plainly
    target, gains = np.where(y, 1.0, -1.0), {}
    ways = [(f, cut, bins[f] <= cut) for f in range(5) for cut in range(widths[f] - 1)]
    ways += [(5, own, np.isin(bins[5], own)) for own in ([0], [1], [2], [3], [0, 1], [0, 2], [0, 3])]
    for f, own, left in ways:
        if min(left.sum(), n - left.sum()) >= 20:
            gains[f, str(own)] = target[left].sum() ** 2 / left.sum() + target[~left].sum() ** 2 / (~left).sum()
    assert max(gains, key=gains.get) == (5, "[2]") and forest.feature[0, 0] == 5 and forest.sets[0, 0].tolist() in ([False, False, True, False], [True, True, False, True])
    numeric = grown(leaves=2, columns=0.5, seed=next(s for s in range(99) if 5 not in np.random.default_rng((s, 0)).permutation(6)[:3]))
    assert numeric.feature[0, 0] < 5 and (numeric.feature[0, 1:] == -1).all()
    # each leaf has its rows' mean target, also where a round draws of the rows, and from files
    for other in ({}, {"share": 0.8}, {"weights": (0.5, 3.0)}):
        own, margin = grown(**other), np.zeros(n)
        w = np.where(y, *other.get("weights", (1.0, 1.0))[::-1])
        if not other.get("share"):
            for at in range(4):
                t = 4 * target / (1 + np.exp(2 * target * margin)) if at else target
                value = own.values(at, bins)
                for v in np.unique(value):
                    assert np.average(t[value == v], weights=w[value == v]) == pytest.approx(v)
                margin += (0.05 if at else 1.0) * value
        monkeypatch.setattr(many_fits, "IN_MEMORY", 0)
        assert (grown(**other).margins(bins, 0.05) == own.margins(bins, 0.05)).all()
        monkeypatch.undo()
    assert (grown(columns=0.5).feature != forest.feature).any()
    mixed = r.permutation(n)
    assert (grown(bins=bins[:, mixed], y=y[mixed], trees=20).margins(bins, 0.05) == grown(trees=20).margins(bins, 0.05)).all()
