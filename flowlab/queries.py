"""One query per operator, over the given tables: (session, folder) to DataFrame.

Results hold no NaN or Infinity, which engines compare in different ways: a column that may hold
them is shown as a finite value and a kind. Computed doubles are rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.fixtures import view
from flowlab.operators import (
    analysis, clean, dedup, evaluate, features, histogram_trees, models, newton, profile, results, split,
)
from flowlab.plans import experiments, medallion
from flowlab.schemas import (
    FEATURES, LONG_LADDER, OPTIONAL_FEATURE, RAW_LABEL, SAMPLE_FEATURES, SAMPLE_RAW, SOURCE, TARGET,
)
from flowlab.sources import tables
from flowlab.sources.staging import new_folder, stage

Query = Callable[[SparkSession, str], DataFrame]

KEYS = ["k1", "k2", "k3", "k4"]
ORDER = ["flow_ts", *KEYS, "Fwd_Packets_Length_Total"]
ODD = "Flow_Bytes_per_s"
# The columns of the summary.
DESCRIBED = ["Protocol", "Flow_Duration", "Total_Fwd_Packets", "Total_Backward_Packets", TARGET]
DRAWS = 500
ROBUST_KEYS = ["Flow_Duration", "Protocol", "Total_Fwd_Packets", "Total_Backward_Packets"]
# The sizes of the small ladder.
SMALL_SIZES = [5, 10, 25, 50]
SAMPLE_KEYS = ["row_key", "src_ip", "dst_ip", "src_port"]

SOURCES = ["botnet", "bruteforce"]
# Fixed values from 100,000 on: the sizes of the large ladder. The first two suit small tables.
EXACT_SIZES = [2_500, 10_000, 100_000, 250_000, 500_000, 750_000]

RAW_FILES = 8

REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def shown(df: DataFrame, odd: str = ODD) -> DataFrame:
    """Splits a column that may hold NaN or Infinity; timestamps become days."""
    c = F.col(odd)
    kind = (
        F.when(c.isNull(), "null").when(F.isnan(c), "nan")
        .when(c == float("inf"), "+inf").when(c == float("-inf"), "-inf").otherwise("number")
    )
    day = [F.col("flow_ts").cast("date").cast("string").alias("flow_day")] if "flow_ts" in df.columns else []
    kept = [c for c in df.columns if c not in (odd, "flow_ts")]
    return df.select(*kept, *day, F.when(kind == "number", c).alias(odd), kind.alias(f"{odd}_kind"))


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    return df.select([
        F.round(c, special.get(c, digits)).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in df.dtypes
    ])


def gold(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct flows with keys, features and target."""
    flows = clean.normalise_label(dedup.distinct_rows(view(spark, folder, "flows")))
    return features.add_target(flows).select(*KEYS, "flow_ts", SOURCE, *FEATURES, OPTIONAL_FEATURE, TARGET)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Gold rows before deduplication, for the experiments that remove copies themselves."""
    flows = features.add_target(clean.normalise_label(view(spark, folder, "flows")))
    return flows.select(*KEYS, "flow_ts", SOURCE, *FEATURES, OPTIONAL_FEATURE, TARGET)


def finite_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Gold rows in which every feature is a finite number."""
    table = clean.cast_features(gold(spark, folder).select(*KEYS, SOURCE, *FEATURES, TARGET))
    return clean.drop_incomplete(clean.inf_to_null(table), FEATURES)


def _sample_text(df: DataFrame) -> DataFrame:
    """Engines print fractions of a second differently, so the text is cut at the second."""
    return df.withColumn("timestamp", F.substring("timestamp", 1, 19))


# --- sources and sinks ------------------------------------------------------------------------


@query
def csv_scan(spark, folder):
    path = new_folder(spark, "csv")
    tables.write_csv(view(spark, folder, "sample_flows"), path)
    return _sample_text(tables.read_csv(spark, path, SAMPLE_RAW))


@query
def csv_types(spark, folder):
    """The inferred type of each column of the sample's CSV, and of the numeric columns once the odd port is null."""
    path, clean_path = new_folder(spark, "csv"), new_folder(spark, "csv")
    sample = view(spark, folder, "sample_flows")
    tables.write_csv(sample, path)
    tables.write_csv(sample.withColumn("src_port", F.when(F.col("src_port") != "n/a", F.col("src_port"))), clean_path)
    kinds = [
        (table, f.name, f.dataType.simpleString())
        for table, at in (("sample", path), ("ports", clean_path)) for f in tables.read_csv_typed(spark, at).schema
    ]
    return spark.createDataFrame(kinds, "file string, column_name string, column_type string")


@query
def csv_typed_scan(spark, folder):
    path = new_folder(spark, "csv")
    sample = view(spark, folder, "sample_flows")
    tables.write_csv(sample.withColumn("src_port", F.when(F.col("src_port") != "n/a", F.col("src_port"))), path)
    rows = tables.read_csv_typed(spark, path)
    return rounded(rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("src_port").alias("src_port"), F.sum("packet_count").alias("packets"),
        F.sum("bytes").alias("bytes"), F.max("timestamp").cast("date").cast("string").alias("last_day"),
    ), 2)


@query
def bronze_csv_to_parquet(spark, folder):
    raw, bronze = new_folder(spark, "csv"), new_folder(spark, "bronze")
    tables.write_csv(view(spark, folder, "sample_flows"), raw)
    tables.write_table(tables.read_csv(spark, raw, SAMPLE_RAW), bronze)
    return _sample_text(tables.read_table(spark, bronze))


@query
def bronze_ingest(spark, folder):
    bronze = tables.ingest(spark, folder, new_folder(spark, "bronze"), "lineitem*.parquet")
    return bronze.groupBy(SOURCE).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_orderkey").alias("sum_orderkey")
    )


@query
def bronze_ingest_merged(spark, folder):
    """Two files of differing columns as one bronze table: orders, and customers with their own columns."""
    raw, bronze = new_folder(spark, "raw"), new_folder(spark, "bronze")
    orders = view(spark, folder, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("amount"))
    customers = view(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"))
    orders.write.parquet(f"{raw}/orders")
    customers.write.parquet(f"{raw}/customer")
    rows = tables.ingest(spark, f"{raw}/*", bronze)
    return rounded(rows.groupBy(F.col("segment").isNull().alias("is_order")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("custkey").alias("sum_custkey"), F.count("amount").alias("n_amounts"),
        F.sum(F.round(F.col("amount") * 100).cast("bigint")).alias("cents"), F.count("segment").alias("n_segments"),
    ))


@query
def scan_by_source(spark, folder):
    path = new_folder(spark, "flows")
    tables.write_table(view(spark, folder, "flows"), path)
    table = tables.read_table(spark, path)
    tables.require_sources(table, ["botnet"])
    rows = tables.scan_source(table, "botnet")
    return rows.groupBy(SOURCE, RAW_LABEL).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("Flow_Duration").alias("sum_duration")
    )


@query
def recursive_scan(spark, folder):
    rows = tables.read_recursive(spark, folder, "*lineitem*.parquet")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_orderkey").alias("sum_orderkey"))


def _silver(spark, folder) -> DataFrame:
    return medallion.flows_to_silver(view(spark, folder, "flows"))


@query
def silver_write(spark, folder):
    path = new_folder(spark, "silver")
    tables.write_table(_silver(spark, folder), path)
    return shown(tables.read_table(spark, path))


@query
def gold_write(spark, folder):
    path = new_folder(spark, "gold")
    tables.write_table(medallion.flows_to_gold(_silver(spark, folder)), path)
    return shown(tables.read_table(spark, path))


@query
def raw_to_gold(spark, folder):
    """All stages of the flow tables, from raw files with spaced column names to the gold table on disk."""
    raw, flows = new_folder(spark, "raw"), view(spark, folder, "flows")
    spaced = flows.drop(SOURCE).toDF(*(c.replace("_", " ") for c in flows.columns if c != SOURCE))
    # Copies go to one file: those in different files are different records. Every file is a source of its own, and
    # with it a partition of each stage table, so their number does not follow the session's shuffle partitions.
    spaced.repartition(RAW_FILES, *(F.col(f"`{c}`") for c in spaced.columns)).write.parquet(raw)
    table = medallion.run_flows(spark, raw, new_folder(spark, "area"))
    return table.groupBy(TARGET).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("Flow_Duration").alias("sum_duration"),
        F.sum("Total_Fwd_Packets").alias("sum_packets"), F.count(ODD).alias("n_rates"),
        F.count_if(F.isnan(ODD)).alias("n_nan"), F.count_if(F.abs(ODD) == float("inf")).alias("n_infinite"),
    )


@query
def sample_raw_to_gold(spark, folder):
    """All stages of the small sample, from CSV to the gold table on disk; bad ports are corrected, as they fail the run."""
    raw, sample = new_folder(spark, "csv"), view(spark, folder, "sample_flows")
    port = F.when(F.col("src_port") == "n/a", "0").otherwise(F.col("src_port"))
    tables.write_csv(sample.withColumn("src_port", port), raw)
    table = medallion.run_sample(spark, raw, new_folder(spark, "area"))
    return rounded(table.groupBy("protocol", TARGET).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("src_port").alias("sum_ports"), F.sum("packet_count").alias("packets"),
        F.sum("bytes").alias("bytes"), F.max("timestamp").cast("date").cast("string").alias("last_day"),
    ), 2)


@query
def sample_gold(spark, folder):
    table = medallion.sample_to_gold(medallion.sample_to_silver(view(spark, folder, "sample_flows")))
    return rounded(table.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")))


@query
def result_sink(spark, folder):
    path = new_folder(spark, "results")
    runs = view(spark, folder, "run_metrics")
    tables.write_results(runs, path)
    return rounded(tables.read_results(spark, path, runs.schema))


# --- projections, filters, cleaning -----------------------------------------------------------


@query
def feature_projection(spark, folder):
    return shown(clean.feature_projection(features.add_target(clean.normalise_label(view(spark, folder, "flows")))))


@query
def gold_projection(spark, folder):
    wanted = [*KEYS, *FEATURES, "Not_In_The_Table", OPTIONAL_FEATURE, TARGET]
    flows = features.add_target(clean.normalise_label(view(spark, folder, "flows")))
    return shown(clean.keep_present(flows, wanted))


@query
def normalise_columns(spark, folder):
    raw = view(spark, folder, "flows").withColumnsRenamed({
        "Flow_Bytes_per_s": "Flow Bytes/s", "Flow_Packets_per_s": "Flow Packets/s",
        "Total_Fwd_Packets": " Total Fwd Packets ", "Packet_Length_Mean": "Packet Length Mean",
    })
    return shown(clean.normalise_names(raw))


@query
def drop_empty_columns(spark, folder):
    return shown(clean.drop_empty_columns(view(spark, folder, "flows")))


@query
def normalise_strings(spark, folder):
    return clean.normalise_strings(view(spark, folder, "sample_flows")).select("src_ip", "dst_ip", "protocol", "label")


@query
def parse_timestamp(spark, folder):
    table = clean.parse_timestamp(view(spark, folder, "sample_flows"))
    text = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return table.select(text.alias("timestamp"), "src_ip", "dst_ip")


@query
def coerce_numeric(spark, folder):
    return clean.coerce_numeric(view(spark, folder, "sample_flows")).drop("timestamp")


@query
def cast_features(spark, folder):
    return shown(clean.cast_features(gold(spark, folder)))


@query
def zero_fill_nan(spark, folder):
    return shown(clean.zero_fill_nan(gold(spark, folder)))


@query
def zero_fill_inf(spark, folder):
    return shown(clean.zero_fill_inf(gold(spark, folder)))


@query
def inf_to_null(spark, folder):
    return shown(clean.inf_to_null(gold(spark, folder)))


@query
def drop_incomplete(spark, folder):
    return shown(clean.drop_incomplete(gold(spark, folder), FEATURES))


@query
def drop_null_label(spark, folder):
    return shown(clean.drop_null_label(view(spark, folder, "flows"), RAW_LABEL))


@query
def feature_not_null(spark, folder):
    return shown(clean.features_not_null(gold(spark, folder)))


@query
def ratio_feature(spark, folder):
    table = features.add_ratio(clean.coerce_numeric(view(spark, folder, "sample_flows")))
    return rounded(table.select("src_ip", "dst_ip", "packet_count", "bytes", "duration_bytes"))


@query
def binary_target(spark, folder):
    flows = clean.normalise_label(view(spark, folder, "flows"))
    return features.add_target(flows).select(*KEYS, RAW_LABEL, TARGET)


# --- duplicates and set operations ------------------------------------------------------------


@query
def dedup_full_row(spark, folder):
    return shown(dedup.distinct_rows(view(spark, folder, "flows")))


@query
def dedup_gold(spark, folder):
    flows = clean.normalise_label(view(spark, folder, "flows"))
    table = features.add_target(flows).select(*FEATURES, OPTIONAL_FEATURE, TARGET)
    return shown(dedup.distinct_rows(table))


@query
def dedup_projected(spark, folder):
    flows = features.add_target(clean.normalise_label(view(spark, folder, "flows")))
    return shown(dedup.distinct_projection(flows))


@query
def dedup_after_clean(spark, folder):
    flows = features.add_target(clean.normalise_label(view(spark, folder, "flows")))
    return shown(dedup.dedup_after_clean(flows))


@query
def duplicate_report(spark, folder):
    flows = features.add_target(clean.normalise_label(view(spark, folder, "flows")))
    return rounded(dedup.duplicate_report(clean.feature_projection(flows)))


def _sides(spark, folder) -> tuple[DataFrame, DataFrame]:
    """All flows with their copies, and one source as it was before copies were added."""
    return view(spark, folder, "flows"), view(spark, folder, "flows_base").where(F.col(SOURCE) == "botnet")


@query
def except_distinct(spark, folder):
    return shown(dedup.except_distinct(*_sides(spark, folder)))


@query
def except_all(spark, folder):
    return shown(dedup.except_all(*_sides(spark, folder)))


@query
def duplicate_sketch(spark, folder):
    """Row counts, and whether the sketched number of distinct rows is within 2 % of the exact one. Copies share
    their source, so sketches per source add up."""
    flows = features.add_target(clean.normalise_label(view(spark, folder, "flows")))
    rows = flows.select(*FEATURES, TARGET, SOURCE)
    near = dedup.approximate_duplicates(dedup.distinct_sketches(rows, SOURCE))
    exact = dedup.duplicate_report(rows.drop(SOURCE)).first()
    apart = F.abs(F.col("unique_rows") - F.lit(exact["unique_rows"])) <= 0.02 * F.lit(exact["unique_rows"])
    return near.select("total_rows", apart.alias("within_bound"))


@query
def union_results(spark, folder):
    runs = view(spark, folder, "run_metrics")
    logistic = runs.where("algorithm = 'Logistic Regression' AND condition = 'Original'")
    forest = runs.where("algorithm = 'Random Forest' AND condition = 'Deduplicated'")
    union = dedup.union_results(
        logistic.drop("condition", "algorithm", "roc_auc"), forest.drop("condition"),
        condition=["Original", "Deduplicated"],
    )
    return rounded(union.select("condition", "algorithm", "dataset_size", "n_rows", "f1", "roc_auc"))


# --- profiling --------------------------------------------------------------------------------


@query
def preview(spark, folder):
    return rounded(profile.preview(gold(spark, folder).select(*KEYS, "Flow_Duration", "Fwd_Packets_Length_Total", TARGET), [*KEYS, "Fwd_Packets_Length_Total"]))


@query
def table_profile(spark, folder):
    return profile.table_profile(view(spark, folder, "flows"))


@query
def null_counts(spark, folder):
    return profile.null_counts(view(spark, folder, "flows"))


@query
def schema_report(spark, folder):
    return profile.schema_report(view(spark, folder, "flows"))


@query
def label_counts(spark, folder):
    return profile.label_counts(_silver(spark, folder))


@query
def class_distribution(spark, folder):
    return profile.class_distribution(gold(spark, folder))


@query
def class_share(spark, folder):
    return rounded(profile.class_share(gold(spark, folder)))


@query
def describe_features(spark, folder):
    return rounded(profile.describe_columns(gold(spark, folder), DESCRIBED), 4)


@query
def constraint_report(spark, folder):
    return profile.constraint_report(medallion.sample_to_silver(view(spark, folder, "sample_flows")))


# --- feature analysis -------------------------------------------------------------------------


@query
def class_stats(spark, folder):
    table = analysis.separability(gold(spark, folder).select(*FEATURES, TARGET))
    return rounded(table.drop("auc", "separability_auc", "effect_size", "effect_band"), 4)


@query
def approximate_medians(spark, folder):
    """Rows per feature and class, and whether the sketched median's rank is within the stated bound."""
    table = stage(gold(spark, folder).select(*FEATURES, TARGET), "gold")
    checked = analysis.rank_errors(table, analysis.approximate_medians(table))
    bound = F.ceil(F.col("n") / analysis.SKETCH_ACCURACY) + 1
    return checked.select("feature", "label", F.col("n").alias("n_rows"), (F.col("rank_error") <= bound).alias("within_bound"))


@query
def cohens_d(spark, folder):
    moments = analysis.class_moments(gold(spark, folder))
    return rounded(moments.select("feature", analysis.cohens_d().alias("effect_size")))


@query
def feature_auc(spark, folder):
    table = analysis.rank_statistics(analysis.ranked_values(gold(spark, folder)))
    return rounded(table.select("feature", "auc", "separability_auc"))


@query
def separability_ranking(spark, folder):
    table = analysis.separability_ranking(analysis.separability(gold(spark, folder).select(*FEATURES, TARGET)))
    return rounded(table.select("feature", "separability_auc", "effect_size", "effect_band"))


@query
def correlation_matrix(spark, folder):
    return rounded(analysis.correlation_matrix(analysis.correlation(_features(spark, folder))))


def _features(spark, folder) -> DataFrame:
    return stage(gold(spark, folder).select(*FEATURES), "features")


@query
def strong_pairs(spark, folder):
    """Pairs from 0.70 on, with a further feature that follows from two others."""
    total = (F.col("Fwd_Packets_Length_Total") + F.col("Bwd_Packets_Length_Total")).alias("Packets_Length_Total")
    table = _features(spark, folder).select("*", total)
    return rounded(analysis.high_correlations(analysis.correlation(table, [*FEATURES, "Packets_Length_Total"])))


@query
def high_correlation_pairs(spark, folder):
    # No pair of these tables is strong: all pairs are listed.
    return rounded(analysis.high_correlations(analysis.correlation(_features(spark, folder)), threshold=0.0))


@query
def ablation_impact(spark, folder):
    return rounded(analysis.ablation_impact(view(spark, folder, "ablation_metrics")))


# --- samples and splits -----------------------------------------------------------------------


def _drawn(table: DataFrame, *extra: str) -> DataFrame:
    return table.select(*KEYS, TARGET, *extra)


@query
def sample_fraction(spark, folder):
    return _drawn(split.hash_sample(gold(spark, folder), 0.25, KEYS))


@query
def stratified_sample_n(spark, folder):
    return _drawn(split.stratified_sample(stage(gold(spark, folder).select(*KEYS, TARGET), "gold"), 5000, KEYS))


@query
def sample_with_replacement(spark, folder):
    table = gold(spark, folder).select(*KEYS, "Fwd_Packets_Length_Total", TARGET)
    order = [*KEYS, "Fwd_Packets_Length_Total"]
    return _drawn(split.sample_with_replacement(table, DRAWS, order), "draw")


@query
def slot_draws(spark, folder):
    table = gold(spark, folder).select(*KEYS, "Fwd_Packets_Length_Total", TARGET)
    return _drawn(split.slot_draws(table, DRAWS, KEYS), "draw")


@query
def split_random(spark, folder):
    train, test = split.hash_split(gold(spark, folder), KEYS)
    return _drawn(train.withColumn("in_train", F.lit(True)).union(test.withColumn("in_train", F.lit(False))), "in_train")


@query
def split_exact(spark, folder):
    return _drawn(split.mark_exact(stage(gold(spark, folder).select(*KEYS, TARGET), "gold"), KEYS), "in_train")


@query
def split_stratified(spark, folder):
    return _drawn(split.mark_stratified(stage(gold(spark, folder).select(*KEYS, TARGET), "gold"), KEYS), "in_train")


@query
def split_ordered(spark, folder):
    return _drawn(split.mark_ordered(stage(gold(spark, folder), "gold"), ORDER), "in_train")


@query
def split_head_except(spark, folder):
    columns = [*FEATURES, TARGET]
    head, rest = split.split_head_except(stage(gold(spark, folder), "gold"), ORDER, 0.06, columns)
    return shown(head.withColumn("in_train", F.lit(True)).union(rest.withColumn("in_train", F.lit(False))))


@query
def split_by_source(spark, folder):
    train, test = split.split_by_source(gold(spark, folder), "botnet", "bruteforce")
    both = train.withColumn("in_train", F.lit(True)).union(test.withColumn("in_train", F.lit(False)))
    return both.groupBy("in_train", SOURCE, TARGET).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("Flow_Duration").alias("sum_duration")
    )


# --- vectors, scalers, weights ----------------------------------------------------------------


@query
def assemble_features(spark, folder):
    vector = vector_to_array("features")
    table = features.assemble(clean.cast_features(gold(spark, folder)))
    return shown(table.select(*KEYS, *(vector[i].alias(f) for i, f in enumerate(FEATURES))))


def _scaling_sides(spark, folder) -> tuple[DataFrame, DataFrame]:
    table = stage(finite_gold(spark, folder), "finite")
    return table.select(*KEYS, *FEATURES), split.hash_split(table, KEYS)[0]


@query
def scale_std(spark, folder):
    table, train = _scaling_sides(spark, folder)
    return rounded(features.scale(table, fit_on=train))


@query
def scale_zscore(spark, folder):
    table, train = _scaling_sides(spark, folder)
    return rounded(features.scale(table, centre=True, fit_on=train))


@query
def scale_zscore_pop(spark, folder):
    table, train = _scaling_sides(spark, folder)
    return rounded(features.scale_population(table, train))


@query
def class_weights(spark, folder):
    return rounded(features.class_weights(gold(spark, folder)))


# --- models (no SQL form) ---------------------------------------------------------------------


def _metrics(spark, run: experiments.Run) -> DataFrame:
    return experiments.metric_table(spark, [run.row])


def _model_sides(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Both sides of the prepared rows, which are staged: every fit reads its rows more than once."""
    table = stage(experiments.prepared(gold(spark, folder), KEYS), "prepared")
    return split.hash_split(table, KEYS)


@query
def model_stages(spark, folder):
    """Assembler, scaler and classifier as one fitted unit: its coefficients."""
    train, _ = _model_sides(spark, folder)
    fitted = models.stages(models.logistic(), scale="std").fit(train).stages[-1]
    rows = list(zip(FEATURES, map(float, fitted.coefficients)))
    return spark.createDataFrame(rows, "feature string, coefficient double")


@query
def logreg_metrics(spark, folder):
    pipeline = models.stages(models.logistic(), scale="std")
    return _metrics(spark, experiments.random_split(
        gold(spark, folder), KEYS, pipeline, experiment="random split", algorithm="Logistic Regression"
    ))


@query
def logreg_l2_metrics(spark, folder):
    table, times = experiments.staged(experiments.prepared(gold(spark, folder), KEYS))
    return _metrics(spark, experiments.split_run(
        lambda: split.split_stratified(table, KEYS),
        lambda n: models.stages(models.logistic_l2(n), scale="population", train_rows=n),
        experiment="stratified split", algorithm="Logistic Regression", **times,
    ))


@query
def logreg_coefficients(spark, folder):
    """Logistic regression without penalty by Newton steps: coefficients per standard deviation."""
    return rounded(newton.fit(_model_sides(spark, folder)[0]).table(spark))


@query
def logreg_l2_coefficients(spark, folder):
    """With a penalty of |w|^2 / 2 on the summed loss, on population z-scores."""
    return rounded(newton.fit(_model_sides(spark, folder)[0], penalty=1.0, population=True).table(spark))


@query
def logreg_scores(spark, folder):
    """Every row of the test side with the score of the model fitted on the other side."""
    train, test = _model_sides(spark, folder)
    score = newton.fit(train).score()
    scored = test.select(*KEYS, F.col(TARGET).cast("int").alias("label"), score.alias("score"))
    return rounded(scored.withColumn("prediction", (F.col("score") > 0.5).cast("int")))


@query
def forest_metrics(spark, folder):
    pipeline = models.stages(models.forest(20))
    return _metrics(spark, experiments.random_split(
        gold(spark, folder), KEYS, pipeline, experiment="random split", algorithm="Random Forest"
    ))


@query
def ordered_forest(spark, folder):
    return _metrics(spark, experiments.ordered_split(
        labelled(spark, folder), ORDER, experiment="ordered split", algorithm="Random Forest"
    ))


@query
def strict_generalization(spark, folder):
    return _metrics(spark, experiments.strict_split(
        labelled(spark, folder), ORDER, experiment="strict split", algorithm="Random Forest"
    ))


@query
def weighted_forest_cross_dataset(spark, folder):
    sides = split.split_by_source(labelled(spark, folder), "botnet", "bruteforce")
    return _metrics(spark, experiments.cross_source(
        *sides, experiment="cross source", algorithm="Random Forest"
    ))


@query
def weighted_forest_learnable(spark, folder):
    """The cross-source run on a target that follows from two features; the given label follows
    from none, so its trees grow to full size."""
    learnable = (F.col("Fwd_Packets_Length_Total") > 1500 * F.col("Total_Fwd_Packets")).cast("int")
    table = labelled(spark, folder).withColumn(TARGET, learnable)
    return _metrics(spark, experiments.cross_source(
        *split.split_by_source(table, "botnet", "bruteforce"),
        experiment="cross source, learnable", algorithm="Random Forest",
    ))


@query
def batch_scoring(spark, folder):
    train, test = _model_sides(spark, folder)
    model = models.stages(models.logistic(), scale="std").fit(train)
    return models.score(model, test, keep=KEYS)


@query
def feature_importance(spark, folder):
    train = _model_sides(spark, folder)[0].select(*FEATURES, TARGET)
    # A fit reads its rows four times; the side is drawn once.
    with experiments.kept(train):
        model = models.stages(models.forest(20)).fit(experiments.packed(train, train.count()))
    return models.feature_importance(model, spark)


@query
def feature_ablation(spark, folder):
    return experiments.ablation(labelled(spark, folder), ORDER)


# A small bootstrap forest, and one tree of all features beside one without each of them.
BOOTSTRAP = [histogram_trees.Tree(draw=True, choice=4)] * 3
ABLATION = [histogram_trees.Tree(), *(histogram_trees.Tree(without=(i,)) for i in range(len(FEATURES)))]
TREE_DEPTH = 4


def _tree_sides(spark, folder) -> tuple[DataFrame, DataFrame]:
    """A target that follows from two features, so that splits differ: the given label follows from none."""
    table = experiments.prepared(gold(spark, folder), KEYS)
    learnable = (F.col("Fwd_Packets_Length_Total") > 1500 * F.col("Total_Fwd_Packets")).cast("int")
    return split.hash_split(stage(table.withColumn(TARGET, learnable), "prepared"), KEYS)


@query
def forest_nodes(spark, folder):
    nodes = histogram_trees.grow(_tree_sides(spark, folder)[0], KEYS, BOOTSTRAP, TREE_DEPTH)
    return rounded(nodes, gain=9)


@query
def forest_importance(spark, folder):
    nodes = histogram_trees.grow(_tree_sides(spark, folder)[0], KEYS, BOOTSTRAP, TREE_DEPTH)
    return rounded(histogram_trees.importances(nodes))


@query
def forest_scores(spark, folder):
    """Every row of the test side with the score of the forest grown on the other side."""
    train, test = _tree_sides(spark, folder)
    score = histogram_trees.forest_score(histogram_trees.grow(train, KEYS, BOOTSTRAP, TREE_DEPTH))
    return rounded(test.select(*KEYS, F.col(TARGET).alias("label"), score.alias("score")))


@query
def tree_ablation(spark, folder):
    """Confusion cells of a tree on all features and of one without each, all grown at once on rows binned once."""
    train, test = _tree_sides(spark, folder)
    scores = histogram_trees.scores(histogram_trees.grow(train, KEYS, ABLATION, TREE_DEPTH))
    names = ["none", *FEATURES]
    each = F.array(*(F.struct(F.lit(names[i]).alias("removed_feature"), (s > 0.5).cast("int").alias("prediction")) for i, s in scores.items()))
    rows = test.select(F.col(TARGET).alias("label"), F.inline(each))
    return evaluate.confusion_by(rows, "removed_feature")


# --- evaluation -------------------------------------------------------------------------------


@query
def confusion_matrix(spark, folder):
    return evaluate.confusion_cells(view(spark, folder, "scored"))


@query
def confusion_table(spark, folder):
    return evaluate.confusion_table(view(spark, folder, "scored"))


def _cells_with_metrics(spark, folder) -> DataFrame:
    return evaluate.add_metrics(evaluate.confusion_cells(view(spark, folder, "scored")))


@query
def classification_metrics(spark, folder):
    return rounded(_cells_with_metrics(spark, folder).select(
        "accuracy", "precision_weighted", "recall_weighted", "f1_weighted"
    ))


@query
def attack_metrics(spark, folder):
    return rounded(_cells_with_metrics(spark, folder).select("precision_attack", "recall_attack", "f1_attack"))


@query
def roc_auc(spark, folder):
    return rounded(evaluate.roc_auc(evaluate.ranked_scores(view(spark, folder, "scored"))))


@query
def pr_auc(spark, folder):
    return rounded(evaluate.pr_auc(evaluate.ranked_scores(view(spark, folder, "scored"))))


@query
def binned_auc(spark, folder):
    """Both areas at the evaluator's number of bins and at one that draws scores of this table together."""
    ranked = stage(evaluate.ranked_scores(view(spark, folder, "scored")), "ranked")

    def areas(bins: int) -> DataFrame:
        return evaluate.areas(evaluate.binned_scores(ranked, bins)).select(F.lit(bins).alias("bins"), "roc_auc", "pr_auc")

    return rounded(areas(evaluate.BINS).unionByName(areas(40)))


@query
def generalization_verdict(spark, folder):
    return rounded(evaluate.verdict(evaluate.confusion_cells(view(spark, folder, "scored"))))


# --- ladders and result tables ----------------------------------------------------------------


@query
def ladder_counts(spark, folder):
    return experiments.rung_counts(gold(spark, folder), KEYS, LONG_LADDER)


def _distinct_features(spark: SparkSession, folder: str) -> DataFrame:
    flows = features.add_target(clean.normalise_label(view(spark, folder, "flows")))
    keys = [F.col(k).cast("string").alias(f"key_{k}") for k in ROBUST_KEYS]
    return dedup.distinct_projection(flows).select("*", *keys)


@query
def robust_ladder_counts(spark, folder):
    """The ladder on distinct feature rows; the draw goes by the row's own values."""
    return experiments.rung_counts(_distinct_features(spark, folder), ROBUST_KEYS)


@query
def scalability_ladder(spark, folder):
    return experiments.ladder(
        gold(spark, folder), KEYS, lambda n: models.stages(models.forest(50)),
        LONG_LADDER, experiment="scalability", algorithm="Random Forest",
    )


@query
def ladder_runs(spark, folder):
    """Rows of each run of a ladder that has a rung under the least size on small tables, whether every test row
    was scored, and whether every stage has its time."""
    runs = experiments.ladder(
        gold(spark, folder), KEYS, lambda n: models.stages(models.logistic(5), scale="std"), [0.001, *LONG_LADDER],
    )
    times = [F.coalesce(F.col(c) >= 0, F.lit(False)) for c in runs.columns if c.endswith("_time_sec")]
    return runs.select(
        "fraction", "n_rows", "train_rows", "test_rows", sum(F.col(c) for c in evaluate.CELLS).alias("n_scored"),
        reduce(lambda a, b: a & b, times).alias("all_timed"),
    )


@query
def logistic_ladder(spark, folder):
    return experiments.ladder(
        gold(spark, folder), KEYS, lambda n: models.stages(models.logistic(), scale="std"),
        experiment="ladder", algorithm="Logistic Regression",
    )


@query
def robust_ladder(spark, folder):
    """The forest ladder on distinct feature rows."""
    # Keys as text of their own: the features become doubles, which would draw other rows.
    return experiments.ladder(
        _distinct_features(spark, folder), [f"key_{k}" for k in ROBUST_KEYS], lambda n: models.stages(models.forest(20)),
        experiment="deduplicated", algorithm="Random Forest",
    )


@query
def exact_size_ladder(spark, folder):
    """Per source, all exact sizes that it has rows for."""
    table = stage(gold(spark, folder), "gold")
    return reduce(DataFrame.unionByName, (
        experiments.exact_size_ladder(
            split.scan_source(table, source), KEYS, EXACT_SIZES,
            lambda n: models.stages(models.logistic_l2(n), scale="population", train_rows=n),
            experiment=f"exact sizes, {source}", algorithm="Logistic Regression",
        )
        for source in SOURCES
    ))


@query
def exact_size_counts(spark, folder):
    """Rows per source, size and class that the ladder of exact sizes draws."""
    counts = gold(spark, folder).groupBy(SOURCE, TARGET).agg(F.count(F.lit(1)).alias("n"))
    return split.size_quotas(counts, SOURCE, TARGET, EXACT_SIZES)


def _sample_table(spark: SparkSession, folder: str) -> DataFrame:
    """Gold rows of the small sample with complete features; the key is the row's second as text."""
    table = medallion.sample_to_gold(medallion.sample_to_silver(view(spark, folder, "sample_flows")))
    table = table.withColumn("row_key", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    return table.select("row_key", "src_ip", "dst_ip", *SAMPLE_FEATURES, TARGET)


@query
def sample_detector(spark, folder):
    """Logistic regression on the five features of the small sample, exact 80 / 20 split."""
    table, times = experiments.staged(experiments.prepared(_sample_table(spark, folder), SAMPLE_KEYS, SAMPLE_FEATURES))
    return _metrics(spark, experiments.split_run(
        lambda: split.split_exact(table, SAMPLE_KEYS), models.stages(models.logistic(100), SAMPLE_FEATURES, "zscore"),
        features=SAMPLE_FEATURES, experiment="sample", algorithm="Logistic Regression", **times,
    ))


@query
def sample_detector_counts(spark, folder):
    """Rows on both sides of the sample detector's split."""
    table = experiments.prepared(_sample_table(spark, folder), SAMPLE_KEYS, SAMPLE_FEATURES)
    marked = split.mark_exact(stage(table, "sample"), SAMPLE_KEYS)
    return marked.groupBy("in_train").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def replacement_ladder(spark, folder):
    """The detector on 5 to 50 rows drawn with replacement, scored on its own draw."""
    return experiments.exact_size_ladder(
        _sample_table(spark, folder), SAMPLE_KEYS, SMALL_SIZES,
        lambda n: models.stages(models.logistic(100), SAMPLE_FEATURES, "zscore"), replacement=True,
        features=SAMPLE_FEATURES, experiment="replacement", algorithm="Logistic Regression",
    )


def _runs(spark, folder) -> DataFrame:
    return view(spark, folder, "run_metrics")


RUN = ["condition", "algorithm", "dataset_size"]


@query
def time_per_row(spark, folder):
    return rounded(results.time_per_row(_runs(spark, folder)).select(*RUN, "time_per_row"), 9)


@query
def scalability_growth(spark, folder):
    table = results.scalability_growth(_runs(spark, folder))
    return rounded(table.select(
        *RUN, "training_time_growth", "prediction_time_growth",
        "rows_per_second_training", "rows_per_second_prediction",
    ), 4)


@query
def scalability_findings(spark, folder):
    return rounded(results.scalability_findings(_runs(spark, folder)))


@query
def ordered_results(spark, folder):
    table = results.ordered_results(_runs(spark, folder).where("condition = 'Original'"))
    return rounded(table.select("size_order", *RUN, "n_rows", "f1"))


@query
def algorithm_pivot(spark, folder):
    runs = _runs(spark, folder).where("condition = 'Original'")
    return rounded(results.algorithm_pivot(runs, {"Logistic Regression": "logistic", "Random Forest": "forest"}))


@query
def algorithm_ratio(spark, folder):
    return rounded(results.algorithm_ratio(_runs(spark, folder), "Random Forest", "Logistic Regression"))


@query
def robustness_delta(spark, folder):
    return rounded(results.robustness_delta(_runs(spark, folder)))


@query
def first_last(spark, folder):
    return rounded(results.first_last(_runs(spark, folder)))
