"""Column lists and table schemas of every stage."""

from __future__ import annotations

from pyspark.sql import types as T

# The model features, in model order.
FEATURES = [
    "Protocol",
    "Flow_Duration",
    "Total_Fwd_Packets",
    "Total_Backward_Packets",
    "Fwd_Packets_Length_Total",
    "Bwd_Packets_Length_Total",
    "Flow_Bytes_per_s",
    "Flow_Packets_per_s",
    "Packet_Length_Mean",
    "Packet_Length_Std",
]
OPTIONAL_FEATURE = "Average_Packet_Size"
TARGET = "is_attack"
RAW_LABEL = "Label"
BENIGN = "BENIGN"
SOURCE = "source_file"
GOLD_COLUMNS = FEATURES + [OPTIONAL_FEATURE, TARGET]

# The small traffic sample, its numeric columns and its model features.
SAMPLE_COLUMNS = [
    "timestamp", "src_ip", "dst_ip", "src_port", "dst_port",
    "protocol", "packet_count", "bytes", "label",
]
SAMPLE_NUMERIC = ["src_port", "dst_port", "packet_count", "bytes"]
SAMPLE_TEXT = ["protocol", "label"]
SAMPLE_NOT_NULL = ["timestamp", "src_ip", "dst_ip", "protocol"]
SAMPLE_FEATURES = SAMPLE_NUMERIC + ["duration_bytes"]

# The raw CSV is read as text in one pass; typing is the job of the silver stage.
SAMPLE_RAW = T.StructType([T.StructField(c, T.StringType()) for c in SAMPLE_COLUMNS])

# Size labels in ladder order, and the fractions they stand for.
SIZE_LABELS = ["10%", "25%", "50%", "75%", "100%"]
LADDER = [0.10, 0.25, 0.50, 0.75, 1.00]
LONG_LADDER = [0.01, 0.05, 0.10, 0.25, 0.50, 1.00]

# One result schema for every model experiment; metric names carry their averaging.
METRICS = T.StructType([
    T.StructField("experiment", T.StringType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("dataset_size", T.StringType()),
    T.StructField("fraction", T.DoubleType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("train_rows", T.LongType()),
    T.StructField("test_rows", T.LongType()),
    T.StructField("num_features", T.IntegerType()),
    T.StructField("selection_time_sec", T.DoubleType()),
    T.StructField("preparation_time_sec", T.DoubleType()),
    T.StructField("split_time_sec", T.DoubleType()),
    T.StructField("training_time_sec", T.DoubleType()),
    T.StructField("prediction_time_sec", T.DoubleType()),
    T.StructField("total_ml_time_sec", T.DoubleType()),
    T.StructField("tn", T.LongType()),
    T.StructField("fp", T.LongType()),
    T.StructField("fn", T.LongType()),
    T.StructField("tp", T.LongType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision_weighted", T.DoubleType()),
    T.StructField("recall_weighted", T.DoubleType()),
    T.StructField("f1_weighted", T.DoubleType()),
    T.StructField("precision_attack", T.DoubleType()),
    T.StructField("recall_attack", T.DoubleType()),
    T.StructField("f1_attack", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()),
    T.StructField("pr_auc", T.DoubleType()),
])

# The result columns compared between two conditions.
# The metrics that are compared.
COMPARED_METRICS = [
    "training_time_sec", "prediction_time_sec", "total_ml_time_sec",
    "accuracy", "precision_weighted", "recall_weighted", "f1", "roc_auc",
]
