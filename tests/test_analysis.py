"""Statistics against numpy on small tables, with empty, constant and missing values."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator

from flowlab.operators import analysis, evaluate, features, ordering, results
from flowlab.sources import staging

FEATURES = ["x", "y", "c"]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    rows = []
    for i in range(800):
        k = int(rng.random() < 0.4)
        x = rng.choice([None, math.nan, math.inf, -math.inf]) if i % 11 == 0 else rng.gauss(k, 1)
        rows.append((x, float(rng.randrange(6)) + k, 3.0, None if i % 97 == 0 else k))
    return rows + [(0.25, 2.0, 3.0, 1)] * 400


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "x double, y double, c double, is_attack int").repartition(5)


def by_class(data, i):
    ok = [(r[i], r[3]) for r in data if r[3] is not None and r[i] is not None and math.isfinite(r[i])]
    return np.array([v for v, k in ok if k == 0]), np.array([v for v, k in ok if k == 1])


def test_separability(df, data):
    got = {r.feature: r for r in analysis.separability(df, FEATURES).collect()}
    for i, f in enumerate(FEATURES):
        normal, attack = by_class(data, i)
        r = got[f]
        assert (r.normal_count, r.attack_count) == (len(normal), len(attack))
        assert r.normal_mean == pytest.approx(normal.mean()) and r.attack_median == pytest.approx(np.median(attack))
        assert r.normal_median == pytest.approx(np.median(normal))
        wins = (attack[:, None] > normal).sum() + (attack[:, None] == normal).sum() / 2
        auc = wins / (len(normal) * len(attack))
        assert r.auc == pytest.approx(auc) and r.separability_auc == pytest.approx(max(auc, 1 - auc))
        n, m = len(normal), len(attack)
        pooled = math.sqrt(((n - 1) * normal.var(ddof=1) + (m - 1) * attack.var(ddof=1)) / (n + m - 2))
        d = abs(normal.mean() - attack.mean()) / pooled if pooled > 1e-9 else 0.0
        assert r.effect_size == pytest.approx(d)
    assert [r.feature for r in analysis.separability_ranking(analysis.separability(df, FEATURES), 1).collect()] == [
        max(got.values(), key=lambda r: r.separability_auc).feature
    ]


def test_one_class_only(df):
    r = analysis.separability(df.where("is_attack = 1"), ["y"]).first()
    assert r.auc is None and r.separability_auc is None and r.normal_median is None
    assert r.normal_count == 0 and r.effect_size == 0.0


@pytest.mark.parametrize("rows", [
    [(1e100, 0.5, None, 1), (2e100, -3.0, None, 1), (0.25, 1e9, None, 0), (0.25, 1e9 + 1, None, 0), (4.0, 1e9, None, 0), (9.0, 9.0, None, None)],
    [(1.0, None, None, 0), (2.0, float("nan"), None, 1), (0.0, float("inf"), None, 1)],
    [(None, None, None, 0), (None, float("nan"), None, 1)],
    [(1.0, 1.0, 1.0, None)],
    [],
])
def test_separability_has_the_class_moments(spark, rows):
    df = spark.createDataFrame(rows, "x double, y double, c double, is_attack int").repartition(3)
    names = ["normal_count", "attack_count", "normal_mean", "attack_mean"]
    want = analysis.class_moments(df, FEATURES).select("feature", *names, analysis.cohens_d().alias("effect_size"))
    got = analysis.separability(df, FEATURES).select("feature", *names, "effect_size")
    want, got = ({r.feature: r[1:] for r in t.collect()} for t in (want, got))
    assert set(got) == set(want)
    for f in want:
        assert got[f] == pytest.approx(want[f], nan_ok=True)


def test_separability_reads_its_input_once_and_ranges_are_drawn_from_written_counts(spark, df, monkeypatch):
    plans = {}

    def recording(table, name):
        plans.setdefault(name, []).append(table._jdf.queryExecution().executedPlan().toString())
        return staging.stage(table, name)

    for module in (analysis, ordering):
        monkeypatch.setattr(module, "stage", recording)
    result = analysis.separability(df, FEATURES)
    assert len(plans["counts"]) == 1 and "RoundRobinPartitioning" in plans["counts"][0]
    assert "HashAggregate" not in plans["slices"][0]
    # df is shuffled round robin, so a second scan of it would show.
    assert "RoundRobinPartitioning" not in result._jdf.queryExecution().executedPlan().toString()


def test_correlation(df, data):
    got = {(r.feature_1, r.feature_2): r.correlation for r in analysis.correlation(df, FEATURES).collect()}
    ok = np.array([r[:3] for r in data if r[0] is not None and math.isfinite(r[0])])
    assert got["x", "y"] == pytest.approx(np.corrcoef(ok[:, 0], ok[:, 1])[0, 1])
    assert got["x", "c"] is None and got["y", "c"] is None
    matrix = {r.feature: r for r in analysis.correlation_matrix(analysis.correlation(df, FEATURES), FEATURES).collect()}
    assert matrix["x"].x == 1.0 and matrix["y"].x == pytest.approx(got["x", "y"]) and matrix["c"].c is None


def test_correlation_survives_a_large_offset(spark):
    rng = random.Random(1)
    rows = [(1e9 + (v := rng.gauss(0, 1)), 1e9 - v) for _ in range(300)]
    pairs = analysis.correlation(spark.createDataFrame(rows, "x double, y double"), ["x", "y"])
    assert analysis.high_correlations(pairs).first().correlation == pytest.approx(-1, abs=1e-6)


@pytest.mark.parametrize("d,band", [(0.0, "very small"), (0.2, "small"), (0.5, "medium"), (0.8, "medium"), (0.81, "large")])
def test_effect_bands(spark, d, band):
    df = spark.createDataFrame([(d,)], "d double")
    assert df.select(analysis.effect_band(df.d)).first()[0] == band


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(3000):
        k = int(rng.random() < 0.3)
        s = round(min(max(rng.gauss(0.4 + 0.2 * k, 0.2), 0.0), 1.0), 2)
        rows.append((k, s, int(s >= 0.5)))
    return spark.createDataFrame(rows + [(1, 0.44, 0)] * 1500, "label int, score double, prediction int").repartition(7)


def test_metrics_equal_the_evaluators(scored):
    got = evaluate.evaluate(scored).first()
    doubles = scored.selectExpr("double(label) label", "score", "double(prediction) prediction")
    for name, metric in {
        "accuracy": "accuracy", "precision_weighted": "weightedPrecision",
        "recall_weighted": "weightedRecall", "f1_weighted": "f1",
    }.items():
        assert got[name] == pytest.approx(MulticlassClassificationEvaluator(metricName=metric).evaluate(doubles), abs=1e-12)
    for name, metric in {"roc_auc": "areaUnderROC", "pr_auc": "areaUnderPR"}.items():
        exact = BinaryClassificationEvaluator(metricName=metric, rawPredictionCol="score", numBins=0)
        assert got[name] == pytest.approx(exact.evaluate(doubles), abs=1e-9)
    attack = MulticlassClassificationEvaluator(metricName="recallByLabel", metricLabel=1.0)
    assert got.recall_attack == pytest.approx(attack.evaluate(doubles))


def test_metrics_without_rows_or_attacks(spark, scored):
    none = evaluate.evaluate(scored.where("label = 0")).first()
    assert none.roc_auc is None and none.f1_attack == 0.0 and none.tp == none.fn == 0
    empty = evaluate.evaluate(scored.limit(0)).first()
    assert (empty.tn, empty.accuracy, empty.roc_auc) == (0, 0.0, None)


@pytest.mark.parametrize("tp,fn,word", [(0, 9, "none"), (4, 6, "limited"), (5, 5, "present")])
def test_verdict(spark, tp, fn, word):
    cells = spark.createDataFrame([(3, 2, fn, tp)], "tn bigint, fp bigint, fn bigint, tp bigint")
    assert evaluate.verdict(cells).first().generalization == word


def test_class_weights_need_both_classes(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "is_attack int")
    got = {r.is_attack: r.class_weight for r in features.class_weights(df).collect()}
    assert got == {0: pytest.approx(4 / 6), 1: 2.0}
    with pytest.raises(Exception, match="no rows of class 1"):
        features.class_weights(df.where("is_attack = 0")).collect()


def test_scaled_constant_is_only_centred(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    assert [tuple(r) for r in features.scale_population(df, df, ["x", "c"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_pivot_rejects_two_runs_for_a_cell(spark):
    rows = [("10%", "A", 1.0, 2.0), ("10%", "A", 1.5, 2.5)]
    df = spark.createDataFrame(rows, "dataset_size string, algorithm string, training_time_sec double, total_ml_time_sec double")
    with pytest.raises(Exception, match="more than one run"):
        results.algorithm_pivot(df, {"A": "a"}).collect()
    assert results.algorithm_pivot(df.limit(1), {"A": "a", "B": "b"}).first().b_total_sec is None


def test_growth_starts_at_the_smallest_run(spark):
    rows = [(0.5, 4.0, 2.0, 80, 20), (0.1, 2.0, 0.0, 8, 2)]
    df = spark.createDataFrame(rows, "fraction double, training_time_sec double, prediction_time_sec double, train_rows bigint, test_rows bigint")
    got = {r.fraction: r for r in results.scalability_growth(df.selectExpr("'s' as s", "*"), ["s"]).collect()}
    assert got[0.5].training_time_growth == 2.0 and got[0.1].training_time_growth == 1.0
    assert got[0.5].prediction_time_growth is None and got[0.5].rows_per_second_training == 20.0


def test_constants_have_no_correlation(spark):
    df = spark.range(1000).selectExpr("id", "0.1e0 a", "0.7e0 b", "2 * id + rand(1) c")
    pairs = analysis.correlation(df, ["id", "a", "b", "c"])
    got = {(r.feature_1, r.feature_2): r.correlation for r in pairs.collect()}
    assert [k for k, v in got.items() if v is not None] == [("id", "c")] and got["id", "c"] > 0.99
    strong = analysis.high_correlations(pairs).collect()
    assert [(r.feature_1, r.n_pairs, r.is_strongest) for r in strong] == [("id", 1, True)]
    assert analysis.correlation_matrix(pairs, ["id", "a", "b", "c"]).where("feature = 'a'").first()["a"] is None
