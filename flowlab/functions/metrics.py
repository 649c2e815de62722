"""Closed forms over the four confusion cells tn, fp, fn, tp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0.0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def accuracy() -> Column:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return ratio(tp + tn, tn + fp + fn + tp)


def attack_metrics() -> dict[str, Column]:
    fp, fn, tp = F.col("fp"), F.col("fn"), F.col("tp")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision_attack": p, "recall_attack": r, "f1_attack": harmonic(p, r)}


def weighted_metrics() -> dict[str, Column]:
    """Per-class precision, recall and F1, weighted by the true share of the class."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    classes = [(tn, tn + fn, tn + fp), (tp, tp + fp, tp + fn)]  # hits, predicted, true

    def weighted(score) -> Column:
        return sum((score(*c) * ratio(c[2], n) for c in classes), F.lit(0.0))

    return {
        "precision_weighted": weighted(lambda hit, predicted, true: ratio(hit, predicted)),
        "recall_weighted": weighted(lambda hit, predicted, true: ratio(hit, true)),
        "f1_weighted": weighted(
            lambda hit, predicted, true: harmonic(ratio(hit, predicted), ratio(hit, true))
        ),
    }
