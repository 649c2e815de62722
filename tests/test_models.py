"""Models have no exact answer; these are the laws they must keep."""

from __future__ import annotations

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlab.operators import evaluate, features, models, split
from flowlab.plans import experiments
from flowlab.schemas import FEATURES, METRICS
from tests.conftest import SMALL

KEYS = ["k1", "k2", "k3", "k4"]
ORDER = ["flow_ts", *KEYS]


@pytest.fixture(scope="module")
def learnable(spark):
    """Gold-shaped rows whose target follows from two features."""
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet").selectExpr(
        "l_orderkey k1", "l_partkey k2", "l_suppkey k3", "l_linenumber k4", "l_shipdate flow_ts",
        "if(l_linestatus = 'F', 'botnet', 'bruteforce') source_file",
        "l_linenumber Protocol", "l_orderkey Flow_Duration", "l_quantity Total_Fwd_Packets",
        "l_suppkey Total_Backward_Packets", "l_extendedprice Fwd_Packets_Length_Total",
        "l_extendedprice * l_discount Bwd_Packets_Length_Total",
        "if(l_partkey % 50 = 0, double('Infinity'), l_quantity / 2) Flow_Bytes_per_s",
        "l_quantity / l_linenumber Flow_Packets_per_s", "l_discount Packet_Length_Mean",
        "l_tax Packet_Length_Std", "int(l_extendedprice / l_quantity > 1500) is_attack",
    )
    rows.persist()
    yield rows
    rows.unpersist()


def test_forest_learns(learnable, spark):
    run = experiments.random_split(learnable, KEYS, models.stages(models.forest(20)), experiment="e")
    assert run.row["roc_auc"] > 0.95 and run.row["train_rows"] + run.row["test_rows"] == learnable.count()
    importance = models.feature_importance(run.model, spark).collect()
    assert sum(r.importance for r in importance) == pytest.approx(1)
    assert [r.importance for r in importance] == sorted((r.importance for r in importance), reverse=True)
    assert {importance[0].feature, importance[1].feature} & {"Fwd_Packets_Length_Total", "Total_Fwd_Packets"}
    scores = models.score(run.model, experiments.prepared(learnable))
    assert scores.where("prediction != int(score > 0.5)").count() == 0
    assert evaluate.evaluate(scores).first().roc_auc > 0.97


def test_logistic_does_not_depend_on_partitions(learnable):
    table = experiments.prepared(learnable, KEYS)
    fits = [
        models.stages(models.logistic(), scale="std").fit(table.repartition(p)).stages[-1].coefficients.toArray()
        for p in (1, 5)
    ]
    assert fits[0] == pytest.approx(fits[1], abs=1e-6)


def test_penalty_shrinks_and_scales_with_rows(learnable):
    table = experiments.prepared(learnable, KEYS)
    twice = table.unionByName(table)
    n = table.count()
    one = models.stages(models.logistic_l2(n, 200), scale="zscore").fit(table).stages[-1].coefficients.toArray()
    # Twice the rows weigh twice as much against the same penalty.
    two = models.stages(models.logistic_l2(2 * n, 200), scale="zscore").fit(twice).stages[-1].coefficients.toArray()
    assert (two ** 2).sum() >= (one ** 2).sum()


def test_balanced_weights_change_nothing(learnable):
    table = experiments.prepared(learnable.where("is_attack = 1").limit(400).unionByName(learnable.where("is_attack = 0").limit(400)))
    weighted = features.add_class_weights(table)
    assert {r.class_weight for r in weighted.select("class_weight").distinct().collect()} == {1.0}
    auc = [
        evaluate.evaluate(models.score(models.stages(m).fit(weighted), weighted)).first().roc_auc
        for m in (models.forest(10), models.forest(10, weight="class_weight"))
    ]
    assert auc[0] == pytest.approx(auc[1], abs=0.02)


def test_scaler_sees_training_rows_only(learnable):
    table = experiments.prepared(learnable, KEYS)
    train, test = split.hash_split(table, KEYS)
    a = models.stages(models.logistic(), scale="zscore").fit(train)
    assert a.stages[1].mean.toArray()[0] == pytest.approx(train.agg({"Protocol": "avg"}).first()[0])
    with pytest.raises(ValueError):
        models.stages(models.logistic(), scale="other")


def all_timed(row) -> bool:
    """Every stage has a time, and preparation is never free."""
    times = [row[f] for f in METRICS.names if f.endswith("_time_sec")]
    return len(times) == 6 and all(t is not None and t >= 0 for t in times) and row["preparation_time_sec"] > 0


def test_cross_source_and_strict(learnable):
    sides = split.split_by_source(learnable, "botnet", "bruteforce")
    row = experiments.cross_source(*sides, trees=10, experiment="cross").row
    finite = learnable.where("k2 % 50 != 0")
    assert row["train_rows"] == finite.where("source_file = 'botnet'").count() and row["roc_auc"] > 0.9
    strict = experiments.strict_split(learnable, ORDER, trees=10).row
    n = finite.select(*FEATURES, "is_attack").distinct().count()
    assert strict["train_rows"] == int(finite.distinct().count() * 0.06)
    assert n - strict["train_rows"] <= strict["test_rows"] <= n
    assert all_timed(row) and all_timed(strict) and strict["split_time_sec"] > 0
    assert all_timed(experiments.random_split(learnable, KEYS, models.stages(models.forest(3))).row)
    assert all_timed(experiments.ordered_split(learnable, ORDER, trees=3).row)


def test_ladder_skips_small_rungs_and_nests(learnable, spark):
    table = experiments.ladder(
        learnable, KEYS, lambda n: models.stages(models.logistic(5), scale="std"), [0.001, 0.1, 1.0],
        experiment="l", algorithm="Logistic Regression",
    )
    assert table.schema == METRICS
    rows = table.orderBy("fraction").collect()
    assert [r.dataset_size for r in rows] == ["10%", "100%"]
    counts = {r.fraction: r for r in experiments.rung_counts(learnable, KEYS, [0.001, 0.1, 1.0]).collect()}
    assert all(counts[r.fraction].train_rows == r.train_rows and counts[r.fraction].n_rows == r.n_rows for r in rows)
    assert all(r.total_ml_time_sec == pytest.approx(r.training_time_sec + r.prediction_time_sec) for r in rows)


def test_exact_sizes(learnable):
    make = lambda n: models.stages(models.logistic_l2(n, 50), scale="zscore")
    rows = experiments.exact_size_ladder(learnable, KEYS, [500, 10**7], make).collect()
    assert [(r.n_rows, r.train_rows) for r in rows] == [(500, 400)]
    assert all(all_timed(r) and r.selection_time_sec > 0 for r in rows)
    rows = experiments.exact_size_ladder(learnable, KEYS, [50], make, replacement=True).collect()
    assert [r.train_rows for r in rows] == [50] and all(map(all_timed, rows))


def test_ablation(learnable):
    rows = experiments.ablation(learnable, ORDER, trees=5).collect()
    assert len(rows) == 1 + len(FEATURES) and all(map(all_timed, rows))
    assert {r.num_features for r in rows} == {10, 9} and len({(r.train_rows, r.test_rows) for r in rows}) == 1
    full = next(r for r in rows if r.experiment == "Full Model")
    loss = {r.removed_feature: full.roc_auc - r.roc_auc for r in rows if r.removed_feature}
    assert max(loss, key=loss.get) in ("Fwd_Packets_Length_Total", "Total_Fwd_Packets", "Flow_Bytes_per_s")


def test_population_scaler_is_a_stage(learnable):
    table = experiments.prepared(learnable, KEYS)
    pipeline = models.stages(models.logistic(), scale="population", train_rows=table.count())
    a = pipeline.fit(table).transform(table)
    moments = a.select(F.posexplode(vector_to_array("features")))
    spread = moments.groupBy("pos").agg(F.stddev_pop("col").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 or r.s == 0 for r in spread)


def test_a_fit_runs_in_few_tasks(spark, learnable):
    rows = spark.range(0, 5000, 1, 64)
    assert experiments.packed(rows, 5000).rdd.getNumPartitions() == 1
    cores = spark.sparkContext.defaultParallelism
    assert experiments.packed(rows, 10**6).rdd.getNumPartitions() == min(64, cores)
    many = experiments.packed(rows, 3 * cores * experiments.ROWS_PER_TASK)
    assert many.rdd.getNumPartitions() == min(64, 3 * cores) and many.count() == 5000


def test_model_queries_read_staged_rows(spark):
    from flowlab import queries

    for side in queries._model_sides(spark, SMALL):
        assert "Exchange" not in side._jdf.queryExecution().executedPlan().toString()
