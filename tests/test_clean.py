"""Cleaning rules on the rows where the kinds of missing value differ."""

from __future__ import annotations

import datetime as dt
import math

import pytest

from flowlab.operators import clean, dedup, features, profile

NAN, INF = math.nan, math.inf


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, 1.5), (2, None), (3, NAN), (4, INF), (5, -INF), (6, -0.0)]
    return spark.createDataFrame(rows, "id int, x double")


def values(df, column="x"):
    return [r[column] for r in df.orderBy("id").collect()]


def same(a, b):
    return len(a) == len(b) and all(
        (x is None and y is None) or (x is not None and y is not None and (x == y or (x != x and y != y)))
        for x, y in zip(a, b)
    )


def test_missing_kinds(odd):
    assert same(values(clean.zero_fill_nan(odd, ["x"])), [1.5, 0, 0, INF, -INF, 0])
    assert same(values(clean.zero_fill_inf(odd, ["x"])), [1.5, 0, NAN, 0, 0, 0])
    assert same(values(clean.inf_to_null(odd, ["x"])), [1.5, None, None, None, None, 0])
    assert same(values(clean.zero_fill_all(odd, ["x"])), [1.5, 0, 0, 0, 0, 0])
    assert same(values(clean.drop_incomplete(odd)), [1.5, INF, -INF, 0])
    assert same(values(clean.features_not_null(odd, ["x"])), [1.5, NAN, INF, -INF, 0])


def test_text_is_stripped_of_any_white_space(spark):
    df = spark.createDataFrame([(1, "\t Tcp\n"), (2, " udp "), (3, None), (4, "a b")], "id int, x string")
    assert values(clean.normalise_strings(df, ["x"])) == ["TCP", "UDP", None, "A B"]


def test_lenient_numbers(spark):
    texts = ["1", " 2.5 ", "n/a", "", None, "1e3", "-7", "3d", "4f", "inf"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    assert values(clean.coerce_numeric(df, ["x"])) == [1, 2.5, None, None, None, 1000, -7, None, None, INF]


def test_timestamps(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:07.25"), (2, None)], "id int, x string")
    assert values(clean.parse_timestamp(df, "x")) == [dt.datetime(2024, 1, 1, 0, 0, 7, 250000), None]
    bad = spark.createDataFrame([(1, "yesterday-ish")], "id int, x string")
    assert values(clean.parse_timestamp(bad, "x", strict=False)) == [None]
    with pytest.raises(Exception, match="not a timestamp"):
        clean.parse_timestamp(bad, "x").collect()


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "` Flow Bytes/s` int, `Label` int")
    assert clean.normalise_names(df).columns == ["Flow_Bytes_per_s", "Label"]
    with pytest.raises(ValueError, match="collide"):
        clean.normalise_names(spark.createDataFrame([(1, 2)], "`a b` int, a_b int"))


def test_required_and_present_columns(odd):
    assert clean.require_columns(odd, ["x"]) is odd
    with pytest.raises(ValueError, match="'y'"):
        clean.require_columns(odd, ["x", "y"])
    assert clean.keep_present(odd, ["y", "x", "id"]).columns == ["x", "id"]


def test_empty_columns(spark):
    n = 3000
    df = spark.range(n).selectExpr(
        "id", "cast(null as string) as empty", "cast('NaN' as double) as nan",
        f"if(id = {n - 1}, 'late', null) as late", "if(id = 0, 1e0, cast('NaN' as double)) as early",
    )
    assert clean.empty_columns(df) == ["empty", "nan"]
    assert clean.drop_empty_columns(df).columns == ["id", "late", "early"]
    assert clean.empty_columns(df.limit(0)) == df.columns


def test_null_label_modes(spark):
    df = spark.createDataFrame([(1, "BENIGN"), (2, "BOT"), (3, None)], "id int, Label string")
    assert values(features.add_target(df), "is_attack") == [0, 1, 1]
    assert values(features.add_target(df, null_label="drop"), "is_attack") == [0, 1]


def test_ratio_at_zero_denominator(spark):
    df = spark.createDataFrame([(1, 6.0, 2.0), (2, 6.0, -1.0), (3, None, 1.0)], "id int, bytes double, packet_count double")
    assert values(features.add_ratio(df), "duration_bytes") == [2.0, None, None]


def test_equal_kinds_collapse(spark):
    rows = [(None,), (None,), (NAN,), (NAN,), (0.0,), (-0.0,), (INF,)]
    df = spark.createDataFrame(rows, "x double")
    assert dedup.distinct_rows(df).count() == 4
    report = dedup.duplicate_report(df).first()
    assert (report.total_rows, report.unique_rows, report.duplicate_rows) == (7, 4, 3)
    empty = dedup.duplicate_report(df.limit(0)).first()
    assert (empty.total_rows, empty.duplicate_rate) == (0, 0.0)


def test_constraints(spark):
    df = spark.createDataFrame(
        [("a", 1.0), (None, NAN), ("b", None), ("c", -1.0), ("d", 0.0)], "t string, x double"
    )
    report = {r.rule: (r.violations, r.passed) for r in profile.constraint_report(df, ["t"], ["x"]).collect()}
    assert report == {"t is not null": (1, False), "x >= 0": (3, False)}
    with pytest.raises(ValueError, match="x >= 0"):
        profile.constraint_report(df, ["t"], ["x"], strict=True)


def test_union_fills_absent_columns(spark):
    a = spark.createDataFrame([("10%", 0.5)], "dataset_size string, f1 double")
    b = spark.createDataFrame([("Random Forest", "10%")], "algorithm string, dataset_size string")
    rows = dedup.union_results(a, b, condition=["x", "y"]).orderBy("condition").collect()
    assert [(r.algorithm, r.f1, r.condition) for r in rows] == [("Logistic Regression", 0.5, "x"), ("Random Forest", None, "y")]
