"""Flow-shaped views over the given tables, as SQL that Spark and DuckDB both run.

`{name}` is a table or another view. The base tables hold no missing values, so the views put in
duplicates, null, NaN, +/-Infinity, an empty column and unstripped labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FLOWS_BASE = """
SELECT l_orderkey AS k1, l_partkey AS k2, l_suppkey AS k3, l_linenumber AS k4, l_shipdate AS flow_ts,
       CASE WHEN l_linestatus = 'F' THEN 'botnet' ELSE 'bruteforce' END AS source_file,
       l_linenumber AS Protocol, l_orderkey AS Flow_Duration,
       CAST(l_quantity AS BIGINT) AS Total_Fwd_Packets, l_suppkey AS Total_Backward_Packets,
       l_extendedprice AS Fwd_Packets_Length_Total, l_extendedprice * l_discount AS Bwd_Packets_Length_Total,
       CASE l_partkey % 50 WHEN 0 THEN CAST('Infinity' AS DOUBLE) WHEN 1 THEN CAST('-Infinity' AS DOUBLE)
            WHEN 2 THEN CAST('NaN' AS DOUBLE) WHEN 3 THEN CAST(NULL AS DOUBLE)
            ELSE l_extendedprice / l_quantity END AS Flow_Bytes_per_s,
       l_quantity / l_linenumber AS Flow_Packets_per_s,
       l_discount AS Packet_Length_Mean, l_tax AS Packet_Length_Std,
       l_extendedprice * l_tax AS Average_Packet_Size, CAST(NULL AS DOUBLE) AS Empty_Column,
       CASE WHEN l_suppkey % 97 = 0 THEN NULL WHEN l_returnflag = 'N' THEN ' Benign '
            WHEN l_returnflag = 'A' THEN 'Bot' ELSE 'SSH-Bruteforce' END AS Label
FROM {lineitem}
"""

FLOWS = """
SELECT * FROM {flows_base}
UNION ALL SELECT * FROM {flows_base} WHERE k2 % 10 = 0
"""

_SAMPLE = """
SELECT CAST(ts AS STRING) AS timestamp,
       concat('10.0.0.', CAST(user_id AS STRING)) AS src_ip, concat('10.1.0.', CAST(event_id % 250 AS STRING)) AS dst_ip,
       CASE WHEN event_id % 100 = 7 THEN 'n/a' ELSE CAST(event_id % 65536 AS STRING) END AS src_port,
       CAST(443 + user_id AS STRING) AS dst_port,
       CASE event_id % 3 WHEN 0 THEN ' tcp' WHEN 1 THEN 'Udp ' ELSE 'icmp' END AS protocol,
       CAST(event_id % 17 AS STRING) AS packet_count, CAST(value AS STRING) AS bytes,
       CASE WHEN event_type = 'view' THEN ' benign ' ELSE event_type END AS label
FROM {events}
"""
SAMPLE_FLOWS = f"{_SAMPLE} UNION ALL {_SAMPLE} WHERE event_id % 20 = 0"

SCORED = """
SELECT k1, k2, k3, k4, label, score, CASE WHEN score >= 0.5e0 THEN 1 ELSE 0 END AS prediction
FROM (SELECT k1, k2, k3, k4,
             CASE WHEN Label IS NULL OR upper(trim(Label)) <> 'BENIGN' THEN 1 ELSE 0 END AS label,
             CASE WHEN Label IS NULL OR upper(trim(Label)) <> 'BENIGN' THEN 0.2e0 ELSE 0e0 END
               + CAST(k2 % 100 AS DOUBLE) / 125e0 AS score
      FROM {flows_base}) t
"""


def _runs(condition: str, where: str) -> str:
    return f"""
SELECT '{condition}' AS condition,
       algorithm,
       CASE rung WHEN 1 THEN '10%' WHEN 2 THEN '25%' WHEN 3 THEN '50%' WHEN 4 THEN '75%' ELSE '100%' END AS dataset_size,
       CASE rung WHEN 1 THEN 0.1e0 WHEN 2 THEN 0.25e0 WHEN 3 THEN 0.5e0 WHEN 4 THEN 0.75e0 ELSE 1e0 END AS fraction,
       count(*) * rung AS n_rows, CAST(floor(count(*) * rung * 0.8e0) AS BIGINT) AS train_rows,
       count(*) * rung - CAST(floor(count(*) * rung * 0.8e0) AS BIGINT) AS test_rows,
       sum(l_quantity) / 1000 AS training_time_sec, sum(l_tax) / 10 AS prediction_time_sec,
       sum(l_quantity) / 1000 + sum(l_tax) / 10 AS total_ml_time_sec,
       1 - avg(l_tax) AS accuracy, avg(l_quantity) / 50 AS precision_weighted, 1 - avg(l_discount) AS recall_weighted,
       avg(l_discount) * 10 AS f1, avg(l_tax) * 10 AS roc_auc
FROM (SELECT *, (l_linenumber - 1) % 5 + 1 AS rung, CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_orderkey % 2 = 0) THEN 'Logistic Regression' ELSE 'Random Forest' END AS algorithm
      FROM {{lineitem}}) t {where}
GROUP BY algorithm, rung
"""


RUN_METRICS = _runs("Original", "") + "UNION ALL" + _runs("Deduplicated", "WHERE l_partkey % 5 <> 0")

ABLATION_METRICS = """
SELECT CASE l_linenumber WHEN 1 THEN 'Full Model' ELSE concat('Without feature_', CAST(l_linenumber AS STRING)) END AS experiment,
       CASE l_linenumber WHEN 1 THEN '' ELSE concat('feature_', CAST(l_linenumber AS STRING)) END AS removed_feature,
       avg(l_discount) * 10 AS f1, avg(l_tax) * 10 AS roc_auc, count(*) AS test_rows
FROM {lineitem} GROUP BY l_linenumber
"""

# View name to (SQL, what it reads).
VIEWS = {
    "flows_base": (FLOWS_BASE, "lineitem"),
    "flows": (FLOWS, "flows_base"),
    "sample_flows": (SAMPLE_FLOWS, "events"),
    "scored": (SCORED, "flows_base"),
    "run_metrics": (RUN_METRICS, "lineitem"),
    "ablation_metrics": (ABLATION_METRICS, "lineitem"),
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view (or a plain table) over the tables of a folder."""
    if name not in VIEWS:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    sql, source = VIEWS[name]
    return spark.sql(sql, **{source: view(spark, folder, source)})


def with_clause(*names: str) -> str:
    """The views as common table expressions over the plain tables."""
    wanted: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in wanted:
            add(VIEWS[name][1])
            wanted.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({VIEWS[n][0].format(**{VIEWS[n][1]: VIEWS[n][1]})})" for n in wanted]
    return "WITH " + ",\n".join(parts)
