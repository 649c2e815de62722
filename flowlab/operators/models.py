"""Detectors: logistic regression on Spark ML, random forests with its model."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.operators.features import assembler, scaler
from flowlab.operators.forests import HistogramForest
from flowlab.schemas import FEATURES, TARGET

SEED = 42
# Class counts that a task of a forest holds per pass, beside the JVM; 100 trees of depth 10 come to about 100 MB on the last level.
FOREST_MEMORY_MB = 128


def forest(trees: int = 100, depth: int = 10, weight: str | None = None, target: str = TARGET) -> HistogramForest:
    model = HistogramForest(
        labelCol=target, featuresCol="features", numTrees=trees, maxDepth=depth, seed=SEED, maxMemoryInMB=FOREST_MEMORY_MB,
    )
    return model.setWeightCol(weight) if weight else model


def logistic(iterations: int = 20, target: str = TARGET) -> LogisticRegression:
    """No penalty."""
    return LogisticRegression(labelCol=target, featuresCol="features", maxIter=iterations)


def logistic_l2(train_rows: int, iterations: int = 1000, target: str = TARGET) -> LogisticRegression:
    """A penalty of |w|^2 / 2 against the summed loss; Spark penalises the mean loss, hence 1 / n."""
    return LogisticRegression(
        labelCol=target, featuresCol="features", maxIter=iterations, regParam=1.0 / max(train_rows, 1),
        elasticNetParam=0.0, standardization=False,
    )


def stages(model, features: Sequence[str] = FEATURES, scale: str | None = None, train_rows: int = 0) -> Pipeline:
    """Assembler, optional scaler ('std', 'zscore' or 'population'), classifier, fitted as one: the
    scaler sees the training rows only. 'population' divides by the population standard deviation
    and needs the number of training rows, by which it differs from the sample's."""
    if scale is None:
        return Pipeline(stages=[assembler(features), model])
    if scale not in ("std", "zscore", "population"):
        raise ValueError(f"scale must be None, 'std', 'zscore' or 'population', not {scale!r}")
    if scale == "population":
        factor = math.sqrt(train_rows / (train_rows - 1)) if train_rows > 1 else 1.0
        widened = ElementwiseProduct(
            scalingVec=Vectors.dense([factor] * len(features)), inputCol="sample_scaled", outputCol="features"
        )
        return Pipeline(stages=[assembler(features, "raw_features"), scaler(True, output="sample_scaled"), widened, model])
    return Pipeline(stages=[assembler(features, "raw_features"), scaler(scale == "zscore"), model])


def score(model: Transformer, df: DataFrame, target: str = TARGET, keep: Sequence[str] = ()) -> DataFrame:
    """(label, score, prediction): score is the probability of an attack."""
    return model.transform(df).select(
        *keep,
        F.col(target).cast("int").alias("label"),
        vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def feature_importance(model: PipelineModel, spark, features: Sequence[str] = FEATURES) -> DataFrame:
    """Impurity gain per feature (adds up to 1), largest first."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(features, map(float, weights)), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "feature string, importance double")


def without(feature: str, features: Sequence[str] = FEATURES) -> VectorSlicer:
    """Cuts one feature out of the assembled vector."""
    kept = [i for i, f in enumerate(features) if f != feature]
    return VectorSlicer(inputCol="all_features", outputCol="features", indices=kept)
