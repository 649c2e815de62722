"""Cuts of tree features: exact order statistics, of which only the neighbourhood is ranked."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowlab.operators import analysis, histogram_trees
from flowlab.schemas import TARGET


@pytest.fixture(scope="module")
def rows(spark):
    """Values without order, few values, one value; some are missing, some rows have no class."""
    noise = lambda seed: F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    df = spark.range(0, 6000, 1, 3).select("id", *(noise(c).alias(c) for c in "abc"))
    table = df.withColumns({"d": (F.col("id") % 50 == 0).cast("double"), "e": F.lit(3.0), TARGET: (F.col("a") > F.col("b")).cast("int")})
    table = table.withColumn("c", F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 9 < 4, -0.0).otherwise(F.col("c")))
    table = table.withColumn(TARGET, F.when(F.col("id") % 11 > 0, F.col(TARGET))).persist()
    yield table
    table.unpersist()


def by_ranks(df, features, bins):
    """The cuts from all values, each ranked."""
    cuts = [[] for _ in features]
    for position in range(len(features)):
        ranked = [r for r in analysis.ranked_values(df, features).collect() if r.position == position]
        for r in ranked:
            before, n, total = r.n0_before + r.n1_before, r.n0 + r.n1, r.n0_total + r.n1_total
            if min((before + n) * bins // total, bins - 1) > before * bins // total and before + n < total:
                cuts[position].append(float(r.value))
    return [sorted(c) for c in cuts]


@pytest.mark.parametrize("miss", [False, True])
def test_thresholds_rank_only_what_is_near_a_cut(spark, rows, monkeypatch, miss):
    expected = by_ranks(rows, list("abcde"), 32)
    taken, exact = [], histogram_trees._exact_cuts

    def recording(values, brackets, bins):
        taken.append(brackets)
        return exact(values, brackets, bins)

    monkeypatch.setattr(histogram_trees, "_exact_cuts", recording)
    if miss:
        # Brackets beside the cuts.
        merged = histogram_trees._merged
        monkeypatch.setattr(histogram_trees, "_merged", lambda edges: merged(edges[2:4]))
    assert histogram_trees.thresholds(rows, list("abcde")) == expected
    assert len(taken) == 1 + miss
    inside = " or ".join(f"a between {low} and {high}" for low, high in taken[0][0])
    assert rows.where(inside).count() < 0.2 * rows.count()


def test_a_task_sends_counts_not_rows(spark, rows):
    """One row per tree, node, feature and bin, where rows were written out once per tree and feature."""
    binned = rows.select(F.lit(1).alias("y"), F.array((F.col("id") % 4).cast("int"), F.lit(0)).alias("bins"), F.array(F.lit(1), (F.col("id") % 2).cast("int")).alias("w"))
    trees = [histogram_trees.Tree(draw=True)] * 2
    counts = histogram_trees._counts(binned, trees, [{1: (0, 1)}, {}], 1)
    assert "Generate" not in counts.groupBy().count()._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[-1]
    assert {tuple(r) for r in counts.collect()} == {
        (0, 2, 0, 0, 0, 1500), (0, 2, 0, 1, 0, 1500), (0, 2, 1, 0, 0, 3000), (0, 3, 0, 2, 0, 1500), (0, 3, 0, 3, 0, 1500), (0, 3, 1, 0, 0, 3000),
    }
