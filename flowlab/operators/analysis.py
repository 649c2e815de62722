"""How well single features separate the classes, and how they move together."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlab.functions.cleaning import finite
from flowlab.operators import clean
from flowlab.operators.ordering import running_totals
from flowlab.operators.profile import melt
from flowlab.schemas import FEATURES, TARGET
from flowlab.sources.staging import stage

HIGH_CORRELATION = 0.70
# The rank of an approximate median is off by one part in so many at most.
SKETCH_ACCURACY = 1000


def value_counts(df: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET) -> DataFrame:
    """(position, value, n0, n1): rows per finite value and class, by position in the feature list
    (a short key for what may be as long as the data).

    Copies are merged inside each task, so a hot value costs one row per task in the shuffle.
    """
    y = F.col(target)
    named = {str(i): f for i, f in enumerate(features)}
    one = F.when(y == 1, 1).otherwise(0).cast("bigint").alias("_one")
    # No filter on the target: it would be pushed below the removal of copies, where labels are cleaned a second time.
    wide = df.select(one, *(F.when(y.isin(0, 1), finite(F.col(f))).alias(i) for i, f in named.items()))
    return (
        wide.unpivot(["_one"], list(named), "position", "value").where(F.col("value").isNotNull())
        .groupBy(F.col("position").cast("int").alias("position"), "value")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_one").alias("n1"))
        .select("position", "value", (F.col("n") - F.col("n1")).alias("n0"), "n1")
    )


def staged_counts(df: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET) -> DataFrame:
    """value_counts, written once: ranges are drawn from a first look at the rows, which would merge them all again."""
    return stage(value_counts(df, features, target), "counts")


def ranked_counts(counts: DataFrame) -> DataFrame:
    """Value counts with the rows of each class below every value."""
    return running_totals(counts, ["position"], ["value"], ["n0", "n1"])


def ranked_values(df: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET) -> DataFrame:
    """value_counts with the rows of each class below every value."""
    return ranked_counts(staged_counts(df, features, target))


def auc_of(n0: Column, n1: Column, n0_before: Column, n0_total: Column, n1_total: Column) -> Column:
    """Mann-Whitney: share of (attack, normal) pairs in which the attack lies higher, ties half."""
    wins = F.sum(n1.cast("double") * (n0_before + n0 / 2.0))
    return F.try_divide(wins, F.max(n0_total).cast("double") * F.max(n1_total).cast("double"))


def _median(k: int) -> Column:
    n, before, total = F.col(f"n{k}"), F.col(f"n{k}_before"), F.col(f"n{k}_total")

    def at(rank: Column) -> Column:
        return F.min(F.when((total > 0) & (before + n >= rank), F.col("value")))

    return (at(F.floor((total + 1) / 2)) + at(F.ceil((total + 1) / 2))) / 2


def approximate_medians(
    df: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET, accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """(feature, label, n, median) of the finite values of each class, from mergeable quantile sketches: one pass that
    shuffles one row of sketches per task and class. The rank of a median is off by n / accuracy at most."""
    y = F.col(target)
    values = df.where(y.isin(0, 1)).select(y.alias("label"), *(finite(F.col(f).cast("double")).alias(f) for f in features))
    per_class = values.groupBy("label").agg(*(
        a for f in features for a in (F.count(f).alias(f"{f}.n"), F.percentile_approx(f, 0.5, accuracy).alias(f"{f}.median"))
    ))
    entries = {f: [F.col("label"), F.col(f"`{f}.n`"), F.col(f"`{f}.median`")] for f in features}
    return melt(per_class, entries, ["feature", "label", "n", "median"])


def rank_errors(df: DataFrame, medians: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET) -> DataFrame:
    """(feature, label, n, median, rank_error): how far the rank of each value is from the middle, in rows; one aggregate over
    the table. `medians` has one row per feature and class."""
    at = {(r["feature"], r["label"]): r["median"] for r in medians.collect()}
    y = F.col(target)
    entries = []
    for (f, k), m in at.items():
        x, m = finite(F.col(f).cast("double")), F.lit(m)
        below, upto = F.count_if((y == k) & (x < m)), F.count_if((y == k) & (x <= m))
        middle = F.count_if((y == k) & x.isNotNull()) / 2
        error = F.greatest(F.lit(0.0), below - middle, middle - upto)
        entries.append(F.struct(F.lit(f).alias("feature"), F.lit(k).alias("label"), error.alias("rank_error")))
    return medians.join(df.agg(F.array(*entries).alias("e")).select(F.inline("e")), ["feature", "label"])


def rank_statistics(ranked: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Median per class, AUC and separability per feature, from one pass over ranked values."""
    auc = auc_of(*(F.col(c) for c in ("n0", "n1", "n0_before", "n0_total", "n1_total")))
    out = ranked.groupBy("position").agg(
        _median(0).alias("normal_median"), _median(1).alias("attack_median"), auc.alias("auc")
    )
    name = F.array(*map(F.lit, features))[F.col("position")].alias("feature")
    separability_auc = F.greatest("auc", 1 - F.col("auc")).alias("separability_auc")
    return out.select(name, "normal_median", "attack_median", "auc", separability_auc)


def class_moments(df: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET) -> DataFrame:
    """Count, mean and sample variance per feature and class, finite values only: one pass over
    the wide table that shuffles two rows per task."""
    y = F.col(target)
    values = df.where(y.isin(0, 1)).select(y, *(finite(F.col(f)).alias(f) for f in features))
    per_class = values.groupBy(target).agg(*(
        a for f in features for a in (
            F.count(f).alias(f"{f}.n"), F.avg(f).alias(f"{f}.mean"), F.var_samp(f).alias(f"{f}.var")
        )
    ))
    entries = {f: [y, *(F.col(f"`{f}.{m}`") for m in ("n", "mean", "var"))] for f in features}
    long = melt(per_class, entries, ["feature", "y", "n", "mean", "var"])

    def of(k: int, column: str) -> Column:
        return F.max(F.when(F.col("y") == k, F.col(column)))

    return long.groupBy("feature").agg(
        F.coalesce(of(0, "n"), F.lit(0)).alias("normal_count"),
        F.coalesce(of(1, "n"), F.lit(0)).alias("attack_count"),
        of(0, "mean").alias("normal_mean"),
        of(1, "mean").alias("attack_mean"),
        of(0, "var").alias("normal_var"),
        of(1, "var").alias("attack_var"),
    )


def count_moments(counts: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """class_moments from value counts that hold at least one row: sums over the distinct values, then over their squared
    distances from the means. The means, one row per feature, are broadcast. counts is scanned twice."""
    v = F.col("value")
    sums = counts.groupBy("position").agg(*(
        a for k in (0, 1) for a in (F.sum(f"n{k}").alias(f"total{k}"), F.sum(F.col(f"n{k}") * v).alias(f"sum{k}"))
    ))
    means = sums.select("position", *(
        c for k in (0, 1) for c in (F.col(f"total{k}"), F.try_divide(f"sum{k}", f"total{k}").alias(f"mean{k}"))
    ))
    # Far values of the other class must not make 0 * Infinity.
    spread = counts.join(F.broadcast(means), "position").groupBy("position", *means.columns[1:]).agg(*(
        F.sum(F.when(F.col(f"n{k}") > 0, F.col(f"n{k}") * (v - F.col(f"mean{k}")) * (v - F.col(f"mean{k}")))).alias(f"squares{k}")
        for k in (0, 1)
    ))
    names = counts.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, features))).alias("position", "feature"))
    return names.join(spread, "position", "left").select(
        "feature",
        F.coalesce("total0", F.lit(0)).alias("normal_count"),
        F.coalesce("total1", F.lit(0)).alias("attack_count"),
        F.col("mean0").alias("normal_mean"),
        F.col("mean1").alias("attack_mean"),
        F.try_divide("squares0", F.col("total0") - 1).alias("normal_var"),
        F.try_divide("squares1", F.col("total1") - 1).alias("attack_var"),
    )


def cohens_d() -> Column:
    """Absolute mean difference over the pooled sample deviation; 0.0 where it is undefined."""
    n0, n1 = F.col("normal_count"), F.col("attack_count")
    pooled = F.sqrt(F.try_divide(
        (n0 - 1) * F.col("normal_var") + (n1 - 1) * F.col("attack_var"), (n0 + n1 - 2).cast("double")
    ))
    d = F.abs(F.try_divide(F.col("normal_mean") - F.col("attack_mean"), pooled))
    return F.when((n0 < 2) | (n1 < 2), 0.0).otherwise(F.coalesce(d, F.lit(0.0)))


def effect_band(d: Column) -> Column:
    return (
        F.when(d < 0.2, "very small").when(d < 0.5, "small").when(d <= 0.8, "medium").otherwise("large")
    )


def separability(df: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET) -> DataFrame:
    """One row per feature: counts, means, medians, AUC, separability and effect size. One pass over df: everything follows
    from its value counts. Only if no feature has a finite value is df scanned again."""
    counts = staged_counts(df, features, target)
    moments = class_moments(df, features, target) if counts.isEmpty() else count_moments(counts, features)
    ranks = rank_statistics(ranked_counts(counts), features)
    return moments.join(ranks, "feature", "left").select(
        "feature", "normal_count", "attack_count", "normal_mean", "attack_mean",
        "normal_median", "attack_median", "auc", "separability_auc",
        cohens_d().alias("effect_size"), effect_band(cohens_d()).alias("effect_band"),
    )


def separability_ranking(table: DataFrame, k: int = 5) -> DataFrame:
    return table.orderBy(F.desc_nulls_last("separability_auc"), "feature").limit(k)


def correlation(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Pearson r of every pair i < j on the rows complete in all features: (feature_1, feature_2,
    correlation). A constant feature has no correlation (null).

    Two passes that shuffle one row per task: means and extremes, then plain sums of centred
    products. df is scanned twice.
    """
    rows = clean.drop_incomplete(clean.inf_to_null(df.select(*features), features), features)
    fit = rows.agg(*(
        F.struct(F.avg(f).alias("mean"), (F.min(f) < F.max(f)).alias("varies")).alias(f) for f in features
    )).first()
    # Rounding of the mean leaves a constant a deviation of about 1e-16 of its value.
    varies = {f: bool(fit[f]["varies"]) for f in features}
    centred = rows.select(*((F.col(f) - F.lit(fit[f]["mean"] or 0.0)).alias(f) for f in features))
    sums = centred.agg(
        *(F.sum(F.col(f) * F.col(f)).alias(f"{i}_{i}") for i, f in enumerate(features)),
        *(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for (i, a), (j, b) in combinations(enumerate(features), 2)),
    )
    entries = [
        F.struct(
            F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"),
            F.when(
                F.lit(varies[a] and varies[b]),
                F.try_divide(F.col(f"{i}_{j}"), F.sqrt(F.col(f"{i}_{i}")) * F.sqrt(F.col(f"{j}_{j}"))),
            ).alias("correlation"),
        )
        for (i, a), (j, b) in combinations(enumerate(features), 2)
    ]
    return sums.select(F.inline(F.array(*entries)))


def correlation_matrix(pairs: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """The square matrix of a pair table: one row per feature, one column per feature."""
    # A feature correlates 1.0 with itself unless it is constant, when all its pairs are null.
    both = pairs.unionByName(pairs.select(
        F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"), "correlation"
    ))
    cells = [
        F.when(F.col("feature_1") == f, F.max(F.when(F.col("correlation").isNotNull(), 1.0)))
        .otherwise(F.max(F.when(F.col("feature_2") == f, F.col("correlation")))).alias(f)
        for f in features
    ]
    return both.groupBy("feature_1").agg(*cells).withColumnRenamed("feature_1", "feature")


def high_correlations(pairs: DataFrame, threshold: float = HIGH_CORRELATION) -> DataFrame:
    """Pairs of at least the threshold, strongest first, with their number and a flag for the
    strongest. One row per pair of features passes through the window."""
    strong = pairs.where(F.abs("correlation") >= threshold)
    order = [F.desc(F.abs("correlation")), "feature_1", "feature_2"]
    whole = W.partitionBy(F.lit(0))
    strong = strong.withColumns({
        "n_pairs": F.count(F.lit(1)).over(whole), "is_strongest": F.row_number().over(whole.orderBy(*order)) == 1,
    })
    return strong.orderBy(*order)


def ablation_impact(metrics: DataFrame, full: str = "Full Model") -> DataFrame:
    """What each removed feature costs against the full model, largest F1 drop first."""
    base = metrics.where(F.col("experiment") == full).select(F.struct("f1", "roc_auc").alias("b")).scalar()
    drops = metrics.where(F.col("experiment") != full).select(
        "removed_feature",
        (base["f1"] - F.col("f1")).alias("f1_drop"),
        (base["roc_auc"] - F.col("roc_auc")).alias("roc_auc_drop"),
    )
    return drops.orderBy(F.desc("f1_drop"), "removed_feature")
