"""Models that can be checked: Newton steps against Spark ML, node tables against transform, binned curves
against Spark's evaluator."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowlab.operators import evaluate, histogram_trees, models, newton
from flowlab.operators.histogram_trees import Tree
from flowlab.plans import experiments
from flowlab.queries import KEYS, gold
from flowlab.schemas import FEATURES, TARGET
from flowlab.sources.staging import stage
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def table(spark):
    rows = experiments.prepared(gold(spark, SMALL), KEYS)
    learnable = (F.col("Fwd_Packets_Length_Total") > 1500 * F.col("Total_Fwd_Packets")).cast("int")
    return stage(rows.withColumn("learnable", learnable), "checked")


@pytest.mark.parametrize("penalty", [0.0, 1.0])
def test_newton_is_the_minimum(spark, table, penalty):
    fit = newton.fit(table, penalty=penalty, population=penalty > 0)
    assert np.abs(fit.gradient).max() / fit.n_rows < 1e-6
    pipeline = (
        models.stages(models.logistic_l2(fit.n_rows), scale="population", train_rows=fit.n_rows) if penalty
        else models.stages(models.logistic(200), scale="zscore")
    )
    theirs = pipeline.fit(table).stages[-1]
    assert np.allclose(fit.coefficients[1:], theirs.coefficients.toArray(), atol=2e-3)
    assert abs(fit.coefficients[0] - theirs.intercept) < 2e-3


def test_newton_takes_a_constant_feature_and_no_rows(spark, table):
    rows = table.withColumn("Protocol", F.lit(3.0))
    fit = newton.fit(rows)
    assert fit.coefficients[1] == 0 and np.isfinite(fit.coefficients).all()
    assert rows.select(fit.score().alias("s")).where("s is null or s <= 0 or s >= 1").isEmpty()
    with pytest.raises(ValueError):
        newton.fit(table.limit(0))


def test_newton_takes_the_curvature_only_where_a_step_follows(spark, table, monkeypatch):
    sums, taken = newton._sums, []

    def recording(*args, **options):
        result = sums(*args, **options)
        taken.append(result[1] is not None)
        return result

    monkeypatch.setattr(newton, "_sums", recording)
    newton.fit(table, steps=2)
    assert taken == [True, True, False]


def test_node_table_of_a_spark_forest_scores_like_transform(spark, table):
    forest = models.forest(8, 4, target="learnable")
    model = models.stages(forest).fit(table)
    nodes = stage(histogram_trees.ml_nodes(model), "ml-nodes")
    assert nodes.select("tree").distinct().count() == 8
    both = models.score(model, table.withColumn("mine", histogram_trees.forest_score(nodes)), "learnable", keep=["mine"])
    assert both.where(F.abs(F.col("mine") - F.col("score")) > 1e-12).isEmpty()
    mine = {r.feature: r.importance for r in histogram_trees.importances(nodes).collect()}
    theirs = model.stages[-1].featureImportances.toArray()
    assert np.allclose([mine[f] for f in FEATURES], theirs, atol=1e-9)


def test_grown_trees_follow_the_data(spark, table):
    nodes = histogram_trees.grow(table, KEYS, [Tree(), Tree(draw=True, choice=4), Tree(without=(4,))], 5, target="learnable")
    rows = nodes.collect()
    inner = {(r.tree, r.node): r for r in rows if r.feature is not None}
    every = {(r.tree, r.node): r for r in rows}
    assert every[0, 1].n0 + every[0, 1].n1 == table.count()
    for (tree, _), r in inner.items():
        left, right = every[tree, r.left], every[tree, r.right]
        assert left.n0 + right.n0 == r.n0 and left.n1 + right.n1 == r.n1 and r.gain > 0
    assert all(r.feature != 4 for (tree, _), r in inner.items() if tree == 2)
    # Rows counted in the leaves are those that reach them by the expression.
    score = histogram_trees.scores(nodes)[0]
    leaves = {round(r.n1 / (r.n0 + r.n1), 9): 0 for r in rows if r.tree == 0 and r.feature is None}
    counts = {round(r.s, 9): r.n for r in table.groupBy(score.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in rows:
        if r.tree == 0 and r.feature is None:
            leaves[round(r.n1 / (r.n0 + r.n1), 9)] += int(r.n0 + r.n1)
    assert counts == leaves
    right = table.where((score > 0.5).cast("int") == F.col("learnable")).count()
    assert right > 0.9 * table.count()


def test_a_hot_value_and_pure_tables_grow(spark):
    rows = [(i, 0, 0, 0, *[1.0] * 9, float(i % 7), 1) for i in range(200)]
    df = spark.createDataFrame(rows, ", ".join([*(f"{k} bigint" for k in KEYS), *(f"{f} double" for f in FEATURES), f"{TARGET} int"]))
    nodes = histogram_trees.grow(df, KEYS, [Tree()], 3).collect()
    assert [(r.node, r.feature, r.n0, r.n1) for r in nodes] == [(1, None, 0.0, 200.0)]
    assert histogram_trees.grow(df.limit(0), KEYS, [Tree()], 2).count() == 0
    cuts = histogram_trees.thresholds(df)
    assert cuts[0] == [] and cuts[9] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_drawn_rows_have_mean_one(spark, table):
    drawn = table.select(histogram_trees.poisson(KEYS, "tree0").alias("w")).agg(F.avg("w"), F.variance("w")).first()
    assert abs(drawn[0] - 1) < 0.05 and abs(drawn[1] - 1) < 0.1


def test_binned_areas_equal_the_evaluator(spark):
    digest = lambda seed: F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    raw = spark.range(7000).select(digest("a").alias("score"), (digest("b") < digest("a")).cast("int").alias("label"))
    scored = stage(raw.withColumn("prediction", (F.col("score") > 0.5).cast("int")).coalesce(1), "scored")
    ranked = stage(evaluate.ranked_scores(scored), "ranked")
    mine = evaluate.areas(evaluate.binned_scores(ranked)).first()
    rows = scored.select("label", array_to_vector(F.array(1 - F.col("score"), F.col("score"))).alias("raw")).coalesce(1)
    for metric, value in (("areaUnderROC", mine.roc_auc), ("areaUnderPR", mine.pr_auc)):
        evaluator = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="raw", metricName=metric)
        assert abs(evaluator.evaluate(rows) - value) < 1e-9
    exact = evaluate.areas(ranked).first()
    assert 0 < abs(exact.roc_auc - mine.roc_auc) < 1e-3


def test_trees_with_equal_splits_are_counted_once(spark, table):
    trees = [Tree(), Tree(without=(0,)), Tree(draw=True)]
    rows = spark.createDataFrame([(1, [0, 1], [1, 1, 2]), (0, [1, 0], [1, 1, 0])], "y int, bins array<int>, w array<int>")
    counts = histogram_trees._counts(rows, trees, [{}, {}, {}], 0)
    assert {(r.tree, r.node, r.feature, r.bin, r.c0, r.c1) for r in counts.collect()} == {
        *((t, 1, f, b, c0, c1) for t in (0, 1) for f, b, c0, c1 in ((0, 0, 0, 1), (1, 1, 0, 1), (0, 1, 1, 0), (1, 0, 1, 0))),
        (2, 1, 0, 0, 0, 2), (2, 1, 1, 1, 0, 2),
    }
    below = histogram_trees._counts(rows, trees, [{1: (0, 0)}, {}, {}], 1).collect()
    assert {(r.tree, r.node) for r in below} == {(0, 2), (0, 3)}
