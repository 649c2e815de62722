"""Every query that has an SQL statement gives the same table, on any partitioning."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from flowlab import fixtures, oracles, queries
from tests.compare import difference, spark_table, sql_table
from tests.conftest import SMALL

SQL = oracles.SQL
QUERIES = queries.REGISTRY
MODELS = {
    "model_stages", "logreg_metrics", "logreg_l2_metrics", "forest_metrics", "ordered_forest",
    "strict_generalization", "weighted_forest_cross_dataset", "weighted_forest_learnable", "batch_scoring", "feature_importance",
    "feature_ablation", "scalability_ladder", "logistic_ladder", "robust_ladder", "exact_size_ladder",
    "sample_detector", "replacement_ladder",
}
# Results that depend on an order, a draw or a cumulative sum.
ORDER_SENSITIVE = [
    "preview", "except_all", "class_stats", "feature_auc", "stratified_sample_n", "sample_with_replacement", "slot_draws",
    "split_exact", "split_stratified", "split_ordered", "split_head_except", "roc_auc", "pr_auc",
    "correlation_matrix", "scale_zscore_pop", "drop_empty_columns",
]


def test_every_query_is_checked():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == MODELS


@pytest.mark.parametrize("name", list(SQL))
def test_equals_sql(spark, duck, name):
    assert difference(spark_table(QUERIES[name](spark, SMALL)), sql_table(duck, SQL[name])) == ""


@pytest.mark.parametrize("parts", [1, 9])
@pytest.mark.parametrize("name", ORDER_SENSITIVE)
def test_any_partitioning(spark, duck, monkeypatch, name, parts):
    plain = fixtures.view

    def spread(session, folder, view):
        df = plain(session, folder, view)
        return df if view in fixtures.VIEWS else df.repartition(parts)

    monkeypatch.setattr(fixtures, "view", spread)
    monkeypatch.setattr(queries, "view", spread)
    assert difference(spark_table(QUERIES[name](spark, SMALL)), sql_table(duck, SQL[name])) == ""


def test_learnable_target_is_learned(spark):
    row = QUERIES["weighted_forest_learnable"](spark, SMALL).first()
    assert row.roc_auc > 0.95 and row.tn + row.fp + row.fn + row.tp == row.test_rows


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["is_attack"] for r in rows] == [0, 1] and sum(r["n_rows"] for r in rows) > 5000
