"""Forests grown from class histograms: the same model as Spark ML's, with nothing kept per row and tree."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowlab.operators import forests, histogram_trees, models
from flowlab.schemas import TARGET


@pytest.fixture(scope="module")
def rows(spark):
    """Two features that decide, one that does not, one of two values, one constant."""
    noise = lambda seed: F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    df = spark.range(0, 6000, 1, 3).select("id", *(noise(c).alias(c) for c in "abc"))
    df = df.withColumns({"d": (F.col("id") % 50 == 0).cast("double"), "e": F.lit(3.0), TARGET: ((F.col("a") > F.col("b")) | (F.col("id") % 50 == 0)).cast("int")})
    table = VectorAssembler(inputCols=list("abcde"), outputCol="features").transform(df).persist()
    yield table
    table.unpersist()


def nodes_of(model):
    return {(r.tree, r.node): r for r in histogram_trees.ml_nodes(models.PipelineModel([model])).collect()}


def auc(model, df):
    from flowlab.operators import evaluate

    return evaluate.evaluate(models.score(model, df)).first().roc_auc


def test_equals_spark_forests_in_kind(rows):
    train, test = rows.where("id % 7 > 0"), rows.where("id % 7 = 0")
    mine = models.forest(9, 8).fit(train)
    theirs = RandomForestClassifier(labelCol=TARGET, numTrees=9, maxDepth=8, seed=42).fit(train)
    assert isinstance(mine, RandomForestClassificationModel) and mine.getNumTrees == 9 and mine.numClasses == 2
    assert auc(mine, test) == pytest.approx(auc(theirs, test), abs=0.01) and auc(mine, test) > 0.97
    assert np.allclose(mine.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=0.08)
    assert 0.7 < mine.totalNumNodes / theirs.totalNumNodes < 1.4
    assert max(t.depth for t in mine.trees) == 8


def test_nodes_add_up_and_leaves_differ(rows):
    nodes = nodes_of(models.forest(4, 6).fit(rows))
    roots = [r for (_, i), r in nodes.items() if i == 0]
    assert len(roots) == 4 and len({r.n0 for r in roots}) == 4
    assert all(abs(r.n0 + r.n1 - 6000) < 6 * 6000**0.5 for r in roots)
    for (tree, _), r in nodes.items():
        if r.feature is not None:
            left, right = nodes[tree, r.left], nodes[tree, r.right]
            assert (left.n0 + right.n0, left.n1 + right.n1) == (r.n0, r.n1) and r.gain > 0
            if left.feature is None and right.feature is None:
                assert (left.n1 > left.n0) != (right.n1 > right.n0)


def test_all_values_of_a_small_feature_are_thresholds(rows):
    table = rows.select(models.vector_to_array("features").alias("x"), F.col(TARGET).cast("double").alias("y"))
    width, classes, cuts = forests._cuts(table, 32)
    # One row in fifty is under a bin, which quantiles alone would not see.
    assert (width, classes) == (5, 2) and cuts[3] == [0.5] and cuts[4] == [] and len(cuts[0]) == 31


def test_weights_count_as_copies(rows):
    weighted = rows.withColumn("w", F.lit(3.0))
    one, three = nodes_of(models.forest(3, 5).fit(rows)), nodes_of(models.forest(3, 5, weight="w").fit(weighted))
    assert one.keys() == three.keys()
    assert all((3 * r.n0, 3 * r.n1, r.feature) == (three[k].n0, three[k].n1, three[k].feature) for k, r in one.items())


def test_what_a_task_holds_does_not_change_the_forest(rows, monkeypatch):
    fitted = [nodes_of(models.forest(6, 6).fit(rows))]
    monkeypatch.setattr(models, "FOREST_MEMORY_MB", 0)
    fitted.append(nodes_of(models.forest(6, 6).fit(rows)))
    assert fitted[0] == fitted[1]


def test_a_fit_keeps_a_byte_per_feature(spark, rows, monkeypatch):
    """Not a count and a node for each tree, which fill the disk."""
    sizes, grow = {}, forests._grow

    def measured(blocks, shape, trees, *rest):
        size = F.length("bins") + F.length("y") + F.length("w")
        sizes[trees] = blocks.agg(F.sum(size), F.sum("n")).first()
        return grow(blocks, shape, trees, *rest)

    monkeypatch.setattr(forests, "_grow", measured)
    for trees in (2, 12):
        models.forest(trees, 2).fit(rows)
    assert sizes[2] == sizes[12] == (6000 * 6, 6000)


def test_best_split_equals_brute_force():
    counts = np.random.default_rng(1).integers(0, 9, (2, 3, 4, 2)).astype(float)
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum()
    best = forests._splits(counts, np.array([[0, 2], [1, 2], [0, 1]]))
    for node in range(3):
        whole = counts[0, node].sum(axis=0)
        found = []
        for j in range(2):
            # Both features count the same rows; only the first one's total is used for the node itself.
            total = counts[j, node].sum(axis=0)
            for cut in range(3):
                left = counts[j, node, : cut + 1].sum(axis=0)
                right = total - left
                if left.sum() and right.sum():
                    found.append(gini(total) - (left.sum() * gini(left) + right.sum() * gini(right)) / total.sum())
        assert best[node, 2] == pytest.approx(max(found)) and whole.sum() > 0


def test_what_is_not_supported_is_refused(rows):
    with pytest.raises(ValueError):
        models.forest(2, 2).setSubsamplingRate(0.5).fit(rows)
    with pytest.raises(ValueError):
        models.forest(2, 2).fit(rows.limit(0))
    with pytest.raises(Exception, match="finite"):
        odd = rows.withColumn("a", F.when(F.col("id") == 7, float("inf")).otherwise(F.col("a"))).drop("features")
        models.forest(2, 2).fit(VectorAssembler(inputCols=list("abcde"), outputCol="features").transform(odd))
