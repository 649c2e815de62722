"""Scans, sinks, staging and the stages from raw to gold."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from flowlab.plans import medallion
from flowlab.sources import staging, tables
from tests.conftest import SMALL

DAYS = ["monday_CICFlowMeter.parquet", "tuesday_CICFlowMeter.parquet"]


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    (folder / "deeper").mkdir(parents=True)
    for i, day in enumerate(DAYS):
        n = 40 + i
        pq.write_table(pa.table({
            " Protocol": pa.array([r % 3 for r in range(n)] + [0], pa.int32()),
            "Flow Bytes/s": pa.array([float(r) for r in range(n)] + [0.0]),
            "Nothing": pa.array([None] * (n + 1), pa.float64()),
            "Label": ["Benign " if r % 2 == 0 else " Bot" for r in range(n)] + ["Benign "],
        }), folder / day)
    pq.write_table(pa.table({"other": [1]}), folder / "deeper" / "notes.parquet")
    return folder


def test_ingest_keeps_the_file_name(spark, raw, tmp_path):
    bronze = tables.ingest(spark, str(raw), str(tmp_path / "bronze"))
    assert {r[0]: r[1] for r in bronze.groupBy("source_file").count().collect()} == {DAYS[0]: 41, DAYS[1]: 42}
    plan = tables.scan_source(bronze, DAYS[0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_file" in plan
    tables.require_sources(bronze, DAYS)
    with pytest.raises(FileNotFoundError, match="sunday"):
        tables.require_sources(bronze, ["sunday"])


def test_recursive_scan_prefers_the_known_name(spark, raw, tmp_path):
    assert tables.read_recursive(spark, str(raw)).count() == 83
    assert tables.read_recursive(spark, str(raw / "deeper")).columns == ["other"]


def test_flows_from_raw_to_gold(spark, raw, tmp_path):
    area = tmp_path / "area"
    gold = medallion.run_flows(spark, str(raw), str(area))
    assert gold.columns == ["Protocol", "Flow_Bytes_per_s", "is_attack", "source_file"]
    # The copy at the end of each day is gone; the same flow on two days is two rows.
    assert {r[0]: r[1] for r in gold.groupBy("source_file").count().collect()} == {DAYS[0]: 40, DAYS[1]: 41}
    assert gold.where("is_attack = 0").count() == 41
    # A second run replaces, it does not add.
    assert medallion.run_flows(spark, str(raw), str(area)).count() == 81


def test_sample_from_csv_to_gold(spark, tmp_path):
    head = "timestamp,src_ip,dst_ip,src_port,dst_port,protocol,packet_count,bytes,label\n"
    line = "2024-01-01 00:00:01,1.1.1.1,2.2.2.2,10,443, tcp ,3,100,benign \n"
    bad = "2024-01-01 00:00:02,1.1.1.1,2.2.2.2,n/a,443,udp,1,10,scan\n"
    (tmp_path / "good.csv").write_text(head + line + line)
    row = medallion.run_sample(spark, str(tmp_path / "good.csv"), str(tmp_path / "good")).collect()
    assert len(row) == 1 and row[0].protocol == "TCP" and row[0].duration_bytes == 25.0 and row[0].is_attack == 0
    (tmp_path / "bad.csv").write_text(head + line + bad)
    with pytest.raises(ValueError, match="src_port >= 0 .1 rows"):
        medallion.run_sample(spark, str(tmp_path / "bad.csv"), str(tmp_path / "bad"))


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 0.1, None), ("b", 1e-17, 3)], "name string, x double, n bigint")
    tables.write_results(df, str(tmp_path / "r"))
    assert sorted(tables.read_results(spark, str(tmp_path / "r"), df.schema).collect()) == sorted(df.collect())


def test_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert staging.shared_folder(spark) == folder
    assert staging.stage(spark.range(5), "five").count() == 5
    assert any(name.startswith("five-") for name in os.listdir(folder))


def test_warehouse_where_no_folder_is_set():
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return "hdfs:///warehouse/" if key == "spark.sql.warehouse.dir" else default

    assert staging.shared_folder(Session) == "hdfs:///warehouse/staged"


def test_files_of_differing_columns(spark, tmp_path):
    raw = tmp_path / "raw"
    spark.sql("SELECT 1 id, 2 x").coalesce(1).write.parquet(str(raw / "a"))
    spark.sql("SELECT 3 id, 'y' y").coalesce(1).write.parquet(str(raw / "b"))
    folder = tmp_path / "flat"
    folder.mkdir()
    for name in ("a", "b"):
        next((raw / name).glob("*.parquet")).rename(folder / f"{name}.parquet")
    table = tables.ingest(spark, str(folder), str(tmp_path / "bronze"))
    assert {(r.id, r.x, r.y, r.source_file) for r in table.collect()} == {(1, 2, None, "a.parquet"), (3, None, "y", "b.parquet")}


@pytest.mark.parametrize("name", ["silver_write", "gold_write", "raw_to_gold"])
def test_stage_tables_are_not_shuffled_again_for_the_write(spark, monkeypatch, name):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from flowlab import queries

    hints = []
    original = Classic.hint
    monkeypatch.setattr(Classic, "hint", lambda self, *a: hints.append(a) or original(self, *a))
    assert queries.REGISTRY[name](spark, SMALL).count() > 0 and not hints
