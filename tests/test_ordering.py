"""Orders, cuts, draws and set operations against brute force, also where one row makes up a
large part of the table."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from flowlab.operators import dedup, ordering, split

COLUMNS = "g int, a bigint, b double"


def some_rows(seed: int, n: int = 600, hot: float = 0.0, domain: int = 50):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), rng.randrange(domain), rng.choice([None, 0.5, 1.5, float(rng.randrange(9))])) for _ in range(n)]
    return rows + [(1, 7, 0.5)] * int(hot * n)


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.fixture(params=[(1, 0.0), (2, 0.6)], ids=["plain", "hot"])
def rows(request):
    return some_rows(request.param[0], hot=request.param[1])


@pytest.fixture(params=[10_000, 7], ids=["whole", "stepped"])
def step(request, monkeypatch):
    """Large groups of copies are written out in steps."""
    monkeypatch.setattr(ordering, "COPIES_PER_STEP", request.param)


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, COLUMNS).repartition(parts)


def test_running_totals(spark):
    rng = random.Random(3)
    data = [(g, v, rng.randrange(5), rng.randrange(5)) for g in range(3) for v in range(200)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g int, v int, x bigint, y bigint").repartition(6)
    got = ordering.running_totals(df, ["g"], ["v"], ["x", "y"]).collect()
    assert len(got) == len(data)
    for r in got:
        group = [d for d in data if d[0] == r.g]
        assert r.x_before == sum(d[2] for d in group if d[1] < r.v)
        assert (r.y_before, r.y_total) == (sum(d[3] for d in group if d[1] < r.v), sum(d[3] for d in group))


def test_global_index(spark, rows, step):
    got = ordering.global_index(frame(spark, rows), ["a"]).orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(len(rows)))
    assert Counter((r.g, r.a, r.b) for r in got) == Counter(rows)
    assert [r.a for r in got] == sorted(r[1] for r in rows)


def test_global_index_by_group(spark, rows):
    got = ordering.global_index(frame(spark, rows), ["a", "b"], ["g"]).collect()
    for g in range(3):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.row_index)
        assert [r.row_index for r in mine] == list(range(len(mine)))
        assert [key((r.a, r.b)) for r in mine] == sorted(key(r[1:]) for r in rows if r[0] == g)


@pytest.mark.parametrize("share", [0.0, 0.06, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("lead", ["a", "b"])
def test_order_cut(spark, rows, share, lead, step):
    """On an integer lead (bracketed) and on a double lead with nulls (put in order as a whole)."""
    order = [lead, *(c for c in ("a", "b", "g") if c != lead)]
    got = split.mark_ordered(frame(spark, rows), order, share).collect()
    named = [dict(zip(("g", "a", "b"), r)) for r in rows]
    want = sorted(named, key=lambda r: key(tuple(r[c] for c in order)))[: int(len(rows) * share)]
    assert Counter((r.g, r.a, r.b) for r in got) == Counter(rows)
    assert Counter((r.g, r.a, r.b) for r in got if r.in_train) == Counter((r["g"], r["a"], r["b"]) for r in want)


def test_order_cut_null_lead(spark):
    rows = [(i, None if i % 3 else i) for i in range(90)]
    df = spark.createDataFrame(rows, "i int, a bigint").repartition(4)
    for share in (0.2, 0.7, 0.9):
        got = split.mark_ordered(df, ["a", "i"], share).where("in_train").collect()
        want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))[: int(90 * share)]
        assert {r.i for r in got} == {r[0] for r in want}


def test_exact_sizes(spark, rows, step):
    df = frame(spark, rows)
    n = len(rows)
    train, test = split.split_exact(df, ["g", "a", "b"], 0.2)
    assert test.count() == -(-n * 2 // 10)
    assert Counter(map(tuple, train.collect())) + Counter(map(tuple, test.collect())) == Counter(rows)


def test_stratified_sizes(spark, rows, step):
    df = frame(spark, rows)
    counts = Counter(r[0] for r in rows)
    for n in (1, 10, 101):
        drawn = split.stratified_sample(df, n, ["a", "b"], label="g").collect()
        got = Counter(r.g for r in drawn)
        assert len(drawn) == n
        assert all(abs(got[g] - n * c / len(rows)) < 1 for g, c in counts.items())
        assert not Counter(map(tuple, drawn)) - Counter(rows)
    assert split.stratified_sample(df, len(rows) + 5, ["a", "b"], label="g").count() == len(rows)
    train, test = split.split_stratified(df, ["a", "b"], 0.2, label="g")
    got = Counter(r.g for r in train.collect())
    assert all(abs(got[g] - 0.8 * c) <= 1 for g, c in counts.items())
    assert Counter(map(tuple, train.collect())) + Counter(map(tuple, test.collect())) == Counter(rows)


def test_draws_follow_the_digest(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 2 as int) as is_attack").repartition(7)
    got = {r.id for r in split.stratified_sample(df, 100, ["id"]).collect()}
    digest = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    want = {i for k in (0, 1) for i in sorted(range(k, 500, 2), key=digest)[:50]}
    assert got == want


def test_hash_samples_are_nested_and_splits_disjoint(spark):
    df = spark.range(5000).toDF("id")
    ids = lambda t: {r.id for r in t.collect()}
    small, large = (ids(split.hash_sample(df, f, ["id"])) for f in (0.1, 0.5))
    assert small < large and 350 < len(small) < 650
    assert split.hash_sample(df, 1.0, ["id"]) is df
    train, test = map(ids, split.hash_split(df, ["id"]))
    assert not train & test and len(train | test) == 5000 and 3800 < len(train) < 4200
    # Independent of the sample.
    assert 0.7 < len(small & train) / len(small) < 0.9


def test_with_replacement(spark):
    df = spark.range(40).toDF("id").repartition(3)
    got = split.sample_with_replacement(df, 200, ["id"]).collect()
    want = [int(hashlib.md5(f"draw|{i}".encode()).hexdigest()[:15], 16) % 40 for i in range(200)]
    assert [r.id for r in sorted(got, key=lambda r: r.draw)] == want
    assert split.sample_with_replacement(df.limit(0), 5, ["id"]).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_slot_draws(spark, parts):
    ids = [7] * 400 + list(range(8, 700)) + [None, None]
    df = spark.createDataFrame([(i, 0) for i in ids], "id int, _at int").repartition(parts).drop("_at")
    digest = lambda i: hashlib.md5(("draw" if i is None else f"draw|{i}").encode()).hexdigest()
    ordered = sorted(ids, key=digest)
    want = [ordered[int(hashlib.md5(f"draw|{i}".encode()).hexdigest()[:15], 16) % len(ids)] for i in range(3000)]
    got = sorted(split.slot_draws(df, 3000, ["id"]).collect(), key=lambda r: r.draw)
    assert [r.draw for r in got] == list(range(3000)) and [r.id for r in got] == want
    assert split.slot_draws(df.limit(0), 5, ["id"]).count() == 0
    assert split.slot_draws(df, 0, ["id"]).count() == 0


def test_set_differences(spark, rows, step):
    right = some_rows(9, 300, hot=0.1)
    a, b = Counter(rows), Counter(right)
    left, right = frame(spark, rows), frame(spark, right)
    assert Counter(map(tuple, dedup.except_distinct(left, right).collect())) == Counter(set(a) - set(b))
    assert Counter(map(tuple, dedup.except_all(left, right).collect())) == a - b


def test_head_except(spark, rows):
    df = frame(spark, rows)
    head, rest = split.split_head_except(df, ["a", "b", "g"], 0.06)
    head, rest = ([tuple(r) for r in t.collect()] for t in (head, rest))
    assert len(head) == int(len(rows) * 0.06)
    assert set(head) | set(rest) == set(rows) and not set(head) & set(rest) and len(rest) == len(set(rest))


def test_empty_table(spark):
    df = frame(spark, [(0, 1, 0.5)]).limit(0)
    assert ordering.global_index(df, ["a"]).count() == 0
    assert split.mark_ordered(df, ["a"]).count() == 0
    assert split.mark_exact(df, ["a"]).count() == 0
    assert split.stratified_sample(df, 5, ["a"], label="g").count() == 0


def test_null_is_a_class_and_minus_zero_stays(spark):
    from flowlab.operators import split

    rows = [(i, None if i % 4 == 0 else i % 2, -0.0 if i % 3 else 0.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, is_attack int, x double").repartition(5)
    assert sorted(split.stratified_sample(df, 5000, ["id"]).collect(), key=str) == sorted(df.collect(), key=str)
    marked = split.mark_stratified(df, ["id"]).collect()
    for label in (None, 0, 1):
        own = [r for r in marked if r.is_attack == label]
        assert 0.75 < sum(r.in_train for r in own) / len(own) < 0.85
    for order in (["id"], ["x", "id"]):
        cut = ordering.order_cut(df, order, 400, 1000).collect()
        assert sum(r.in_head for r in cut) == 400
        assert sorted((r.id, str(r.x)) for r in cut) == sorted((r[0], str(r[2])) for r in rows)


def test_tiny_fractions(spark):
    from flowlab.operators import split

    n = split.hash_sample(spark.range(200_000), 0.0004, ["id"]).count()
    assert 40 < n < 130
    assert abs(split.hash_sample(spark.range(30_000), 1 / 3, ["id"]).count() - 10_000) < 400
