"""Top-k through the pivot index against all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from flowlab.llm import pivot_index
from flowlab.llm.queries import REGISTRY

BIG = (1 << 63) - 1


def brute(rows: list[tuple], asks, k: int) -> list[tuple]:
    """Of rows (vec_id, vector): per asking row the k best other rows."""
    out = []
    for i, (q, x) in enumerate(rows):
        if q is not None and asks(q):
            scored = [(-max(-BIG - 1, min(BIG, sum(a * b for a, b in zip(x, y)))), v is None, v or 0, v) for j, (v, y) in enumerate(rows) if j != i]
            out += [(q, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BLOCK", 16), ("CHUNK", 5), ("PART_BLOCKS", 2), ("MAX_CELLS", 12), ("SAMPLE", 100)):
        monkeypatch.setattr(pivot_index, name, value)


def test_clusters_hot_vectors_and_repeated_rows(spark, small_blocks):
    r = random.Random(1)
    centres = [[r.randint(-900, 900) for _ in range(6)] for _ in range(9)]
    rows = [(i, [c + r.randint(-30, 30) for c in r.choice(centres)]) for i in range(500)]
    rows += [(1000 + i, [700, 0, 0, 0, 0, -7]) for i in range(250)]
    rows += [rows[20], rows[20], rows[100], (None, rows[100][1]), (None, [1, 2, 3, 4, 5, 6])]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    assert got(pivot_index.top_k(df, F.col("vec_id") % 10 == 0, 7)) == brute(rows, lambda q: q % 10 == 0, 7)


def test_lengths_ties_and_large_numbers(spark, small_blocks):
    r = random.Random(2)
    rows = [(i, [r.choice((-1, 0, 1)) for _ in range(r.randint(0, 4))]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    assert got(pivot_index.top_k(df, F.col("vec_id") % 3 == 0, 10)) == brute(rows, lambda q: q % 3 == 0, 10)
    for digits in (8, 12):
        rows = [(i, [r.randint(-10**digits, 10**digits) for _ in range(3)]) for i in range(90)]
        df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
        assert got(pivot_index.top_k(df, F.col("vec_id") % 9 == 0, 4)) == brute(rows, lambda q: q % 9 == 0, 4)


def test_far_cells_are_left_out(spark, small_blocks, monkeypatch):
    """Tight clusters: a query compares a small part of the vectors."""
    r = random.Random(3)
    centres = [[1000 * math.cos(a), 1000 * math.sin(a)] for a in (0.1, 1, 2, 3, 4, 5)]
    rows = [(i, [round(c) + r.randint(-9, 9) for c in centres[i % 6]]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    probed = []
    plain = pivot_index._probes

    def counted(chunks, choose, parts):
        probed.append(plain(chunks, choose, parts))
        return probed[-1]

    monkeypatch.setattr(pivot_index, "_probes", counted)
    assert got(pivot_index.top_k(df, F.col("vec_id") % 50 == 0, 3)) == brute(rows, lambda q: q % 50 == 0, 3)
    cells = sum(p.select("cell", F.explode("members")).distinct().count() for p in probed)
    assert cells < 12 * 12 / 2


def test_query_on_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 1.5], "a", 1), (100, [0.25, 0.0], "a", 1), (7, [None, 1.0], "a", 1), (8, None, "a", 1), (9, [nan, 1.0], "a", 1)]
    rows += [(200, [inf, 0.0], "a", 1), (11, [-0.0001, 0.0], "a", 1), (None, [0.5, 1.5], None, None), (12, [], "a", 1)]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string, rank int").write.parquet(path)
    whole = [(v, [math.floor(1024 * x) for x in e]) for v, e, *_ in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    assert got(REGISTRY["op12_pivot_top_k"](spark, str(tmp_path))) == brute(whole, lambda q: q % 100 == 0, 10)
    empty = spark.createDataFrame([], "vec_id bigint, vector array<bigint>")
    out = pivot_index.top_k(empty, F.col("vec_id") % 2 == 0, 3)
    assert out.count() == 0 and out.columns == ["query_id", "rank", "vec_id", "score"]
    none = spark.createDataFrame([(1, [1])], "vec_id bigint, vector array<bigint>")
    assert pivot_index.top_k(none, F.col("vec_id") == 1, 3).count() == 0
