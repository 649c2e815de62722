"""Plans that would not survive a large table: everything in one task, nested loops, row-wise
Python, filters and columns that do not reach the scan."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlab import oracles, queries
from flowlab.operators import analysis, clean, ordering, split
from flowlab.sources import staging
from tests.conftest import SMALL

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF"]
# A global aggregate or a final top-k ends in one task by nature, on one row per task.
ONE_TASK = "SinglePartition"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def staged(monkeypatch):
    """The plans of all staged tables, beside those of the results."""
    plans = []
    original = staging.stage

    def recording(df, name):
        plans.append(plan(df))
        return original(df, name)

    for module in (staging, ordering):
        monkeypatch.setattr(module, "stage", recording)
    return plans


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_no_forbidden_node(spark, staged, name):
    final = plan(queries.REGISTRY[name](spark, SMALL))
    for text in [*staged, final]:
        assert not [f for f in FORBIDDEN if f in text]


def _windows_in_one_task(text: str) -> bool:
    """A window right over an exchange to a single partition, unless what comes in is one row per slice:
    an aggregate by nothing but the slice."""
    lines = text.splitlines()
    for i, line in enumerate(lines):
        below = lines[i + 1 : i + 4]
        if "Window" in line and any(ONE_TASK in x for x in below):
            at = next(j for j in range(i + 1, i + 4) if ONE_TASK in lines[j]) + 1
            while "Project" in lines[at]:
                at += 1
            if not re.search(r"HashAggregate\(keys=\[_slice#\d+\]", lines[at]):
                return True
    return False


def test_a_window_over_all_rows_is_noticed(spark):
    rows = spark.range(10).withColumn("n", F.row_number().over(W.orderBy("id")))
    assert _windows_in_one_task(plan(rows))


@pytest.mark.parametrize("name", [
    "class_stats", "feature_auc", "roc_auc", "pr_auc", "split_exact", "split_ordered", "sample_with_replacement",
    "slot_draws",
])
def test_no_window_over_all_rows(spark, staged, name):
    final = plan(queries.REGISTRY[name](spark, SMALL))
    assert not any(map(_windows_in_one_task, [*staged, final]))


def test_hash_split_is_a_filter_in_the_scan(spark):
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_tax")
    text = plan(split.hash_split(rows, ["l_orderkey", "l_linenumber"])[0])
    assert "Exchange" not in text and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_tax:double>" in text


def test_not_null_filters_are_pushed(spark):
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    text = plan(clean.features_not_null(rows, ["l_tax", "l_discount"]).select("l_tax"))
    assert "PushedFilters: [IsNotNull(l_tax), IsNotNull(l_discount)]" in text
    assert "ReadSchema: struct<l_discount:double,l_tax:double>" in text


def test_value_counts_merge_before_the_only_shuffle(spark):
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet").selectExpr("l_tax", "l_discount", "int(l_linenumber > 3) is_attack")
    text = plan(analysis.value_counts(rows, ["l_tax", "l_discount"]))
    assert text.count("Exchange") == 1 and text.count("partial_count") >= 1
