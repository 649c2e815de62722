"""Repairs against plain dynamic programming over rows, without blocks or vectors."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from flowlab.llm import turn_repair
from flowlab.llm.queries import REGISTRY
from tests.conftest import SMALL

SOLID = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile("(s?(ua)+)?")


def cheapest(marks: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """(cost, audit) for rows (initial, forced, cut). States are the roles so far, cut to what matters."""

    @cache
    def best(i: int, state: str, inserts: int) -> tuple[int, str]:
        options = []
        following = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if i == len(marks):
            options += [(0, "")] if state in ("", "a") else []
        else:
            initial, forced, cut = marks[i]
            options.append(add(2, "D", best(i + 1, state, 2)))
            if not forced:
                if initial in following and initial:
                    options.append(add(5 * cut, "K", best(i + 1, initial, 2)))
                options += [add(1 + 5 * cut, "R", best(i + 1, f, 2)) for f in following if f in "ua"]
        if inserts:
            options += [add(5, "I", best(i, f, inserts - 1)) for f in following if f in "ua"]
        return min(options, default=(10**9, ""))

    def add(cost: int, edit: str, rest: tuple[int, str]) -> tuple[int, str]:
        return cost + rest[0], edit + rest[1]

    return best(0, "", 2)


def repaired(rows: list[tuple], audit: str) -> list[tuple]:
    """The turns an audit leaves; an inserted or changed role is the one that may follow."""
    out, i = [], 0
    for edit in audit:
        follow = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit == "I":
            out.append((follow, ""))
            continue
        if edit != "D":
            out.append((rows[i][1] if edit == "K" else follow, rows[i][2]))
        i += 1
    assert i == len(rows) and GOOD.fullmatch("".join(r[:1] for r, _ in out))
    return out


def brute(rows: list[tuple]) -> dict:
    """rows: (turn, role, text) in order."""
    seen, marks, count = set(), [], defaultdict(int)
    for _, role, text in rows:
        blank, twice = not SOLID.search(text), (role, text) in seen
        cut = not blank and SOLID.findall(text)[-1] not in ".!?"
        count["blank" if blank else "duplicate" if twice else "truncated" if cut else "none"] += 1
        marks.append((role[:1], blank or twice, cut))
        seen.add((role, text))
    cost, audit = cheapest(marks)
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired(rows, audit)).encode()).hexdigest(),
    } | {f: count[f] for f in ("blank", "duplicate", "truncated")}


def ordered(rows: list[tuple]) -> dict:
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        own[c].append((turn, role, text))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in own.items()}


def contract(rows: list[tuple]) -> dict:
    damaged = []
    for c, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged += [(c, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    own = ordered(damaged)
    return {c: brute(own.get(c, [])) for c in {r[0] for r in rows}}


def differences(got, wanted: dict) -> list:
    mine = {r.conv_id: r.asDict() for r in got.collect()}
    assert mine.keys() == wanted.keys()
    return [(c, mine[c], w) for c, w in wanted.items() if any(mine[c][k] != v for k, v in w.items())]


def test_blocks_give_the_cheapest_least_audit():
    r = random.Random(1)
    for _ in range(3000):
        symbols = [r.randrange(9) for _ in range(r.randint(0, 14))]
        marks = [("suax"[(s - 1) // 2] if s else "u", s == 0, s > 0 and s % 2 == 0) for s in symbols]
        steps = turn_repair.trace(symbols)
        audit = "".join("I" * len(s.before) + s.edit for s in steps)
        audit += "I" * len(turn_repair.finish(steps[-1].state if steps else 0))
        assert audit == cheapest(marks)[1], symbols
    assert len(turn_repair.tables().vectors) < 100


def test_runs_compose():
    r = random.Random(2)
    for _ in range(300):
        symbols = [r.randrange(9) for _ in range(r.randint(2, 30))]
        at = r.randrange(1, len(symbols))
        left, right = symbols[:at], symbols[at:]
        vectors, _ = turn_repair.segment_map(right)
        ending = int(vectors[0])
        _, states = turn_repair.segment_map(left)
        middle = int(states[ending, 0])
        assert turn_repair.trace(left, ending) + turn_repair.trace(right, 0, middle) == turn_repair.trace(symbols)


def conversations(r: random.Random) -> list[tuple]:
    rows = []
    for c in range(40):
        for t in range(r.choice((0, 1, 4, 9))):
            role, text = r.choice(("system", "user", "assistant", "", "tool", None)), r.choice(("a.", "b", " ", "c! ", "é?\n", None, ""))
            rows.append((c, t if r.random() < 0.9 else None, role, text, "x", 1))
    rows += [rows[3]] * 3 + [(None, 1, "user", "a.", None, None), (None, None, "assistant", "b.", None, None), (77, None, None, None, None, None)]
    # A conversation with over a third of all rows.
    rows += [(50, 2 * t, r.choice(("user", "assistant", "system")), f"{t % 90}{r.choice('. !x')}", "x", 2) for t in range(len(rows))]
    return rows


@pytest.mark.parametrize("parts", ["1", "7"])
def test_query_equals_brute_force(spark, tmp_path, parts):
    rows = conversations(random.Random(6))
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, conv string, slice int").write.parquet(f"{tmp_path}/conversations.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = REGISTRY["op11_turn_repair"](spark, str(tmp_path))
        assert differences(got, contract(rows)) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_small_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    assert differences(REGISTRY["op11_turn_repair"](spark, SMALL), contract(rows)) == []


def test_turns_that_remain(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c"), (2, 0, "assistant", "x.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    edited = turn_repair.edits(df)
    out = turn_repair.repaired_turns(edited).orderBy("at", "place").collect()
    for c, own in ordered(rows).items():
        assert [(r.role, r.text) for r in out if r.conv_id == c] == repaired(own, brute(own)["audit"])
    empty = df.limit(0)
    assert turn_repair.edits(empty).count() == 0 and turn_repair.reports_of_all(df, empty).where(F.col("audit") == "").count() == 2
