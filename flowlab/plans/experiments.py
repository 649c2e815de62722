"""Model experiments over gold rows; each gives one row of the METRICS schema per run.

Input tables hold the features, the target and key columns. Stage times are wall-clock times of
forced actions: preparation is cleaning and dropping copies, selection is taking a sample (0 where all
rows are taken), split is forming and counting the two sides. Prediction is timed on materialised predictions, never on a count, which
Catalyst would answer without running the model.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from time import perf_counter

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.functions.hashing import bucket, edge
from flowlab.operators import clean, dedup, evaluate, models, split
from flowlab.operators.features import add_class_weights, assemble
from flowlab.schemas import FEATURES, LADDER, METRICS, TARGET
from flowlab.sources.staging import stage

MIN_ROWS = 100
TRAIN_EDGE = edge(0.8)
HEAD = 0.06
# Training rows a task of a fit may hold.
ROWS_PER_TASK = 2_000_000
# Fewer rows than these are not worth a task of their own in every pass.
LEAST_ROWS = 10_000

MakeModel = Callable[[int], Pipeline]


@dataclass
class Run:
    model: PipelineModel
    row: dict


@contextmanager
def kept(*tables: DataFrame) -> Iterator[None]:
    """Keeps tables in memory, or on disk where they do not fit, for the length of a block."""
    for t in tables:
        t.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield
    finally:
        for t in tables:
            t.unpersist()


def forced(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def metric_table(spark, rows: Sequence[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(f) for f in METRICS.names) for r in rows], METRICS)


def _taken(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Keys, features and target, which must all be there; a column may be both key and feature."""
    columns = list(dict.fromkeys([*keys, *features, TARGET]))
    return clean.require_columns(df, columns).select(columns)


def prepared(df: DataFrame, keys: Sequence[str] = (), features: Sequence[str] = FEATURES) -> DataFrame:
    """Keys, double features without any missing value (0.0 instead), target; no null target."""
    table = clean.drop_null_label(_taken(df, keys, features))
    return clean.zero_fill_all(table, features)


def complete(df: DataFrame, keys: Sequence[str] = (), features: Sequence[str] = FEATURES) -> DataFrame:
    """Keys, double features, target; rows with a missing value of any kind are left out (a fit
    rejects Infinity)."""
    table = clean.cast_features(_taken(df, keys, features), features)
    return clean.drop_incomplete(clean.inf_to_null(table, features), [*features, TARGET])


def packed(train: DataFrame, rows: int) -> DataFrame:
    """The training rows in whole waves of tasks, one wave unless they are many. A fit makes at least one pass per step
    or level, and every task of a pass sends statistics as large as the model, however few rows it has."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    waves = max(1, math.ceil(rows / (cores * ROWS_PER_TASK)))
    return train.coalesce(max(1, min(cores * waves, math.ceil(rows / LEAST_ROWS))))


def run(
    train: DataFrame,
    test: DataFrame,
    pipeline: Pipeline,
    train_rows: int,
    features: Sequence[str] = FEATURES,
    **labels,
) -> Run:
    """Fit, score, evaluate."""
    start = perf_counter()
    model = pipeline.fit(packed(train, train_rows))
    training = perf_counter() - start
    scored = models.score(model, test)
    with kept(scored):
        start = perf_counter()
        forced(scored)
        prediction = perf_counter() - start
        measured = evaluate.evaluate(scored).first().asDict()
    test_rows = sum(measured[c] for c in evaluate.CELLS)
    row = {
        "dataset_size": "100%", "fraction": 1.0, "n_rows": train_rows + test_rows,
        "train_rows": train_rows, "test_rows": test_rows, "num_features": len(features),
        "training_time_sec": training, "prediction_time_sec": prediction,
        "total_ml_time_sec": training + prediction,
    }
    return Run(model, row | measured | labels)


def split_run(sides: Callable[[], split.Split], pipeline: Pipeline | MakeModel, **labels) -> Run:
    """`sides` forms the split; its own jobs are part of the split time. The pipeline may depend on the
    number of training rows."""
    start = perf_counter()
    train, test = sides()
    with kept(train, test):
        train_rows = train.count()
        if test is not train:
            forced(test)
        splitting = perf_counter() - start
        if not isinstance(pipeline, Pipeline):
            pipeline = pipeline(train_rows)
        return run(train, test, pipeline, train_rows, split_time_sec=splitting, **labels)


def staged(df: DataFrame) -> tuple[DataFrame, dict]:
    """The prepared table, written once, and the times of the stages before the split."""
    start = perf_counter()
    table = stage(df, "distinct")
    return table, {"preparation_time_sec": perf_counter() - start, "selection_time_sec": 0.0}


def random_split(df: DataFrame, keys: list[str], pipeline: Pipeline, **labels) -> Run:
    """About 80 / 20 by key digest; both sides are filters over one kept table."""
    marked = _marked(df, keys)
    with kept(marked):
        start = perf_counter()
        forced(marked)
        preparation = perf_counter() - start
        start = perf_counter()
        train, test = _sides(marked)
        train_rows = train.count()
        return run(
            train, test, pipeline, train_rows, preparation_time_sec=preparation, selection_time_sec=0.0,
            split_time_sec=perf_counter() - start, **labels,
        )


def _marked(df: DataFrame, keys: list[str]) -> DataFrame:
    """Prepared rows with their sample and split buckets."""
    buckets = bucket(keys, "sample").alias("_sample"), bucket(keys, "split").alias("_side")
    return prepared(df, keys).select(*FEATURES, TARGET, *buckets)


def _sides(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    side = F.col("_side")
    return marked.where(side < TRAIN_EDGE), marked.where(side >= TRAIN_EDGE)


def ordered_split(df: DataFrame, order: list[str], trees: int = 50, **labels) -> Run:
    """The first 80 % of the distinct rows in the given order train a forest on z-scores."""
    table, times = staged(complete(dedup.distinct_rows(df), order))
    pipeline = models.stages(models.forest(trees), scale="zscore")
    return split_run(lambda: split.split_ordered(table, order), pipeline, **times, **labels)


def strict_split(df: DataFrame, order: list[str], trees: int = 100, head: float = HEAD, **labels) -> Run:
    """A small head trains, the distinct rest tests; no feature row is on both sides."""
    columns = [*FEATURES, TARGET]
    table, times = staged(complete(dedup.distinct_rows(df), order))
    sides = lambda: split.split_head_except(table, order, head, columns)
    return split_run(sides, models.stages(models.forest(trees)), **times, **labels)


def cross_source(train: DataFrame, test: DataFrame, trees: int = 100, **labels) -> Run:
    """Train on one source with balanced class weights, test on another."""
    train, test = complete(dedup.distinct_rows(train)), complete(dedup.distinct_rows(test))
    pipeline = models.stages(models.forest(trees, weight="class_weight"))
    with kept(train, test):
        start = perf_counter()
        forced(test)
        train_rows = train.count()
        # The sources are the sides, so nothing is split or selected.
        return run(
            add_class_weights(train), test, pipeline, train_rows, preparation_time_sec=perf_counter() - start,
            selection_time_sec=0.0, split_time_sec=0.0, **labels,
        )


def rung_counts(table: DataFrame, keys: list[str], fractions: Sequence[float] = LADDER) -> DataFrame:
    """Rows, training rows and test rows of every rung, from one pass."""
    sample, side = bucket(keys, "sample"), bucket(keys, "split")
    marked = table.select(sample.alias("s"), (side < TRAIN_EDGE).alias("t"))
    aggregates = []
    for i, f in enumerate(fractions):
        taken = F.col("s") < edge(f)
        aggregates += [F.count_if(taken).alias(f"n{i}"), F.count_if(taken & F.col("t")).alias(f"t{i}")]
    row = marked.agg(*aggregates)
    return row.select(F.inline(F.array(*(
        F.struct(
            F.lit(float(f)).alias("fraction"), F.col(f"n{i}").alias("n_rows"),
            F.col(f"t{i}").alias("train_rows"), (F.col(f"n{i}") - F.col(f"t{i}")).alias("test_rows"),
        )
        for i, f in enumerate(fractions)
    ))))


def ladder(
    df: DataFrame,
    keys: list[str],
    make: MakeModel,
    fractions: Sequence[float] = LADDER,
    **labels,
) -> DataFrame:
    """One run per fraction over nested samples. The sample and split buckets are computed once
    on the kept table, so a rung is a filter. Rungs under 100 rows are skipped."""
    start = perf_counter()
    marked = _marked(df, keys)
    rows = []
    with kept(marked):
        forced(marked)
        preparation = perf_counter() - start
        start = perf_counter()
        counts = marked.agg(*(
            F.count_if((F.col("_sample") < edge(f)) & side).alias(f"{name}{i}")
            for i, f in enumerate(fractions)
            for name, side in (("train", F.col("_side") < TRAIN_EDGE), ("test", F.col("_side") >= TRAIN_EDGE))
        )).first()
        selection = perf_counter() - start
        for i, f in enumerate(fractions):
            train_rows, test_rows = counts[f"train{i}"], counts[f"test{i}"]
            if train_rows + test_rows < MIN_ROWS:
                continue
            train, test = _sides(marked.where(F.col("_sample") < edge(f)))
            # The pass that counts all rungs splits them too.
            rows.append(run(
                train, test, make(train_rows), train_rows, dataset_size=f"{f:.0%}", fraction=float(f),
                preparation_time_sec=preparation, selection_time_sec=selection, split_time_sec=0.0, **labels,
            ).row)
    return metric_table(df.sparkSession, rows)


def exact_size_ladder(
    df: DataFrame, keys: list[str], sizes: Sequence[int], make: MakeModel, replacement: bool = False,
    features: Sequence[str] = FEATURES, **labels,
) -> DataFrame:
    """One run per exact sample size: class shares kept, or drawn with replacement (then the
    model is scored on its own sample). Sizes above the table are skipped."""
    table = prepared(df, keys, features)
    rows = []
    with kept(table):
        start = perf_counter()
        n = table.count()
        preparation = perf_counter() - start
        for size in sizes:
            if size > n and not replacement:
                continue
            start = perf_counter()
            drawn = split.slot_draws(table, size, keys) if replacement else split.stratified_sample(table, size, keys)
            with kept(drawn):
                forced(drawn)
                selection = perf_counter() - start
                sides = lambda: (drawn, drawn) if replacement else split.split_stratified(drawn, keys, seed="split")
                rows.append(split_run(
                    sides, make(size), features=features, dataset_size=str(size), fraction=min(size / n, 1.0),
                    preparation_time_sec=preparation, selection_time_sec=selection, **labels,
                ).row)
    return metric_table(df.sparkSession, rows)


def ablation(
    df: DataFrame, order: list[str], trees: int = 50, train: float = 0.8, at_once: int = 2,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """The full model, then one model without each feature, all on one ordered split. Vectors are
    assembled once; two fits run at a time, so stages with few tasks do not leave cores idle."""
    table, times = staged(complete(dedup.distinct_rows(df), order, features))
    start = perf_counter()
    train_side, test_side = (
        assemble(side, features, "all_features").select("all_features", TARGET)
        for side in split.split_ordered(table, order, train)
    )

    def one(removed: str | None) -> dict:
        name = "Full Model" if removed is None else f"Without {removed}"
        left = [f for f in features if f != removed]
        pipeline = Pipeline(stages=[models.without(removed, features), models.forest(trees)])
        return run(
            train_side, test_side, pipeline, train_rows, left, experiment=name, algorithm="Random Forest",
            split_time_sec=splitting, **times,
        ).row | {"removed_feature": removed}

    with kept(train_side, test_side):
        train_rows = train_side.count()
        forced(test_side)
        splitting = perf_counter() - start
        with ThreadPoolExecutor(at_once) as pool:
            rows = list(pool.map(one, [None, *features]))
    spark = df.sparkSession
    removed = spark.createDataFrame(
        [(r["experiment"], r["removed_feature"]) for r in rows], "experiment string, removed_feature string"
    )
    return metric_table(spark, rows).join(removed, "experiment")
