"""Logistic regression by Newton steps, each of them one aggregation.

A step needs the gradient (p + 1 sums) and the Hessian ((p + 1)(p + 2) / 2 sums) over all rows. Both
come from one pass that merges sums inside every task and shuffles one row per task; only these
few numbers reach the driver, which solves for p + 1 coefficients. The loss is convex and steps
converge quadratically, so a fixed small number of them gives the minimum to the last digits. The
result is checkable: it does not depend on a library's stopping rule, and the same steps can be
written in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.schemas import FEATURES, TARGET

STEPS = 8
INTERCEPT = "(intercept)"


@dataclass
class Fit:
    """Coefficients of centred and scaled features, the scaling, and the gradient at the end."""

    features: list[str]
    mean: list[float]
    deviation: list[float]
    coefficients: np.ndarray
    gradient: np.ndarray
    n_rows: int

    def table(self, spark) -> DataFrame:
        """(feature, coefficient) per standard deviation; the intercept belongs to centred features."""
        names = [INTERCEPT, *self.features]
        return spark.createDataFrame(list(zip(names, map(float, self.coefficients))), "feature string, coefficient double")

    def score(self) -> Column:
        """The probability of an attack, as an expression over the feature columns."""
        return _probability(self.coefficients, [_scaled(*x) for x in zip(self.features, self.mean, self.deviation)])


def _scaled(feature: str, mean: float, deviation: float) -> Column:
    return (F.col(feature) - F.lit(mean)) / F.lit(deviation)


def _probability(coefficients: Sequence[float], scaled: Sequence[Column]) -> Column:
    eta = F.lit(float(coefficients[0]))
    for c, x in zip(coefficients[1:], scaled):
        eta = eta + F.lit(float(c)) * x
    return 1.0 / (1.0 + F.exp(-eta))


def fit(
    df: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET, penalty: float = 0.0,
    population: bool = False, steps: int = STEPS,
) -> Fit:
    """Minimises the summed log loss plus penalty / 2 * |w|^2 (not on the intercept) over features centred and divided by
    their sample or population deviation. A constant feature is only centred and gets no weight.

    Features are finite numbers and the target is 0 or 1, as `experiments.prepared` gives them; the table
    is kept for the length of the fit. Fails on a table without rows. If the classes can be told apart without
    error, the loss has no minimum: the coefficients then grow with every step.
    """
    features = list(features)
    spread = F.stddev_pop if population else F.stddev_samp
    row = df.agg(F.count(F.lit(1)).alias("n"), *(
        F.struct(F.avg(f).alias("mean"), spread(f).alias("std"), (F.min(f) < F.max(f)).alias("varies")).alias(f) for f in features
    )).first()
    if not row["n"]:
        raise ValueError("no rows to fit")
    mean = [float(row[f]["mean"]) for f in features]
    deviation = [float(row[f]["std"]) if row[f]["varies"] else 1.0 for f in features]
    varies = [True, *(bool(row[f]["varies"]) for f in features)]
    names = [f"z{i}" for i in range(1, len(features) + 1)]
    scaled = [_scaled(f, m, d).alias(z) for f, m, d, z in zip(features, mean, deviation, names)]
    rows = df.select(F.col(target).cast("double").alias("y"), *scaled).persist(StorageLevel.MEMORY_AND_DISK)
    size = len(names) + 1
    ridge = penalty * np.diag([0.0] + [1.0] * len(names))
    coefficients = np.zeros(size)
    try:
        for _ in range(steps):
            gradient, hessian = _sums(rows, names, coefficients)
            gradient -= ridge @ coefficients
            hessian += ridge
            for i in np.flatnonzero(~np.array(varies)):
                gradient[i], hessian[i, i] = 0.0, 1.0
            coefficients = coefficients + np.linalg.solve(hessian, gradient)
        gradient = _sums(rows, names, coefficients, curvature=False)[0] - ridge @ coefficients
    finally:
        rows.unpersist()
    return Fit(features, mean, deviation, coefficients, gradient * np.array(varies), row["n"])


def _sums(
    rows: DataFrame, names: list[str], coefficients: np.ndarray, curvature: bool = True
) -> tuple[np.ndarray, np.ndarray | None]:
    """Gradient of the log likelihood and, on request, the negative Hessian, from one aggregation."""
    p = _probability(coefficients, [F.col(z) for z in names])
    marked = rows.select("*", p.alias("p")).select("*", (F.col("y") - F.col("p")).alias("r"), (F.col("p") * (1 - F.col("p"))).alias("w"))
    x = [F.lit(1.0), *map(F.col, names)]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))] if curvature else []
    sums = [F.sum(F.col("r") * c) for c in x] + [F.sum(F.col("w") * x[i] * x[j]) for i, j in pairs]
    values = np.array(marked.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first(), dtype=float)
    if not curvature:
        return values, None
    hessian = np.zeros((len(x), len(x)))
    for (i, j), v in zip(pairs, values[len(x) :]):
        hessian[i, j] = hessian[j, i] = v
    return values[: len(x)], hessian
