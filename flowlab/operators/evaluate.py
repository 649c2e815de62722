"""Evaluation of scored rows (label, score, prediction).

One aggregation by score carries all metrics: the confusion cells, exact ROC AUC and exact
PR AUC. Rows are scored and scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.functions import metrics
from flowlab.operators.analysis import auc_of
from flowlab.operators.ordering import running_totals

CELLS = ["tn", "fp", "fn", "tp"]
LIMITED_RECALL = 0.50
# Fixed value: the bins of Spark's evaluator.
BINS = 1000


def _cell_counts(label: str, prediction: str) -> dict[str, Column]:
    y, p = F.col(label), F.col(prediction)
    return {
        "tn": F.count_if((y == 0) & (p == 0)),
        "fp": F.count_if((y == 0) & (p == 1)),
        "fn": F.count_if((y == 1) & (p == 0)),
        "tp": F.count_if((y == 1) & (p == 1)),
    }


def confusion_table(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return scored.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(label, prediction)


def confusion_cells(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row tn, fp, fn, tp; a cell without rows is 0."""
    return scored.agg(*(c.alias(n) for n, c in _cell_counts(label, prediction).items()))


def confusion_by(scored: DataFrame, by: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The cells of several models over the same rows."""
    return scored.groupBy(by).agg(*(c.alias(n) for n, c in _cell_counts(label, prediction).items()))


def add_metrics(cells: DataFrame) -> DataFrame:
    return cells.withColumns({
        "accuracy": metrics.accuracy(), **metrics.weighted_metrics(), **metrics.attack_metrics(),
    })


def ranked_scores(scored: DataFrame, label: str = "label", score: str = "score", prediction: str = "prediction") -> DataFrame:
    """Rows per distinct score and class, with the rows of each class below it."""
    y = F.col(label)
    counts = scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(y == 0).alias("n0"),
        F.count_if(y == 1).alias("n1"),
        *(c.alias(n) for n, c in _cell_counts(label, prediction).items()),
    )
    return running_totals(counts, [], ["score"], ["n0", "n1"])


def _roc_auc() -> Column:
    return auc_of(*(F.col(c) for c in ("n0", "n1", "n0_before", "n0_total", "n1_total")))


def _pr_auc() -> Column:
    """Trapezoids over the distinct thresholds from the highest score down; the curve starts at
    recall 0 with the precision of its first point."""
    n0, n1 = F.col("n0"), F.col("n1")
    hits = F.col("n1_total") - F.col("n1_before")
    flagged = hits + F.col("n0_total") - F.col("n0_before")
    here = F.try_divide(hits.cast("double"), flagged.cast("double"))
    above = F.try_divide((hits - n1).cast("double"), (flagged - n0 - n1).cast("double"))
    step = F.try_divide(n1.cast("double"), F.col("n1_total").cast("double"))
    return F.sum(step * (here + F.coalesce(above, here)) / 2)


def binned_scores(ranked: DataFrame, bins: int = BINS) -> DataFrame:
    """Ranked scores drawn together to about `bins` thresholds, as Spark's evaluator does by default: from the
    highest score down, every `distinct / bins` distinct scores become one, if that is two or more.
    The evaluator starts anew in each of its partitions, so its figure is this one where it has one."""
    whole = running_totals(ranked.withColumn("_one", F.lit(1).cast("bigint")), [], ["score"], ["_one"])
    at_once = F.floor(F.col("_one_total") / F.lit(bins))
    from_top = F.col("_one_total") - 1 - F.col("_one_before")
    group = F.when(at_once < 2, from_top).otherwise(F.floor(from_top / at_once))
    return whole.groupBy(group.alias("_group"), "n0_total", "n1_total").agg(
        F.max("score").alias("score"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
        F.min("n0_before").alias("n0_before"), F.min("n1_before").alias("n1_before"),
    ).drop("_group")


def roc_auc(ranked: DataFrame) -> DataFrame:
    return ranked.agg(_roc_auc().alias("roc_auc"))


def pr_auc(ranked: DataFrame) -> DataFrame:
    return ranked.agg(_pr_auc().alias("pr_auc"))


def areas(ranked: DataFrame) -> DataFrame:
    return ranked.agg(_roc_auc().alias("roc_auc"), _pr_auc().alias("pr_auc"))


def evaluate(scored: DataFrame, label: str = "label", score: str = "score", prediction: str = "prediction") -> DataFrame:
    """All metrics of one set of predictions as one row."""
    ranked = ranked_scores(scored, label, score, prediction)
    row = ranked.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CELLS),
        _roc_auc().alias("roc_auc"),
        _pr_auc().alias("pr_auc"),
    )
    return add_metrics(row)


def verdict(cells: DataFrame) -> DataFrame:
    """Does the detector carry over? No attack found: none; under half found: limited."""
    recall = metrics.attack_metrics()["recall_attack"]
    word = F.when(F.col("tp") == 0, "none").when(recall < LIMITED_RECALL, "limited").otherwise("present")
    return cells.withColumn("recall_attack", recall).withColumn("generalization", word)
