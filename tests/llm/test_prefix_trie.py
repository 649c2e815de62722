"""The trie of rebuilt conversations against plain Python that makes every rebuilt text."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from flowlab.llm import prefix_trie
from flowlab.llm.queries import REGISTRY

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, place int"


def brute(rows: list[tuple], heads: dict[int, tuple[int, int]]) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            address = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), role, address, (role, text)))
    own = {c: [r[-1] for r in sorted(v)] for c, v in own.items()}
    rebuilt = {c: own.get(b, [])[:h] + own.get(c, [])[h:] for c, (b, h) in heads.items()}
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = {n: sum(len(m) == len(n) + 1 and m[:-1] == n for m in members) for n in members}
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), kids[node],
            sum(kids[m] == 0 for m in below), sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def conversations(r: random.Random, n: int) -> list[tuple]:
    rows = []
    for c in range(n):
        for t in range(r.choice((0, 1, 3, 8, 12))):
            rows.append((c, t, r.choice(("user", "assistant", "")), r.choice(("a", "b", "äö", "")), "x", 1))
    rows += [rows[5]] * 3 + [(7, None, None, None, None, None), (7, None, "user", None, None, None), (None, 1, "user", "lost", None, 1)]
    # A key with a third of all rows.
    rows += [(40, t, "user", "long" if t % 3 else "a", "x", 2) for t in range(len(rows) // 2)]
    return rows


def contract_heads(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    return {c: (c - c % 5, zlib.crc32(str(c).encode()) % 9) for c in {r[0] for r in rows} - {None}}


def got(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_brute_force(spark, tmp_path):
    rows = conversations(random.Random(3), 60)
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    wanted = brute(rows, contract_heads(rows))
    assert got(REGISTRY["op13_prefix_trie"](spark, str(tmp_path))) == wanted
    assert any(w[4] > 1 for w in wanted) and any(w[6] > 0 for w in wanted)


def test_any_heads_and_absent_bases(spark):
    rows = [r for r in conversations(random.Random(4), 25) if r[0] != 40]
    heads = {c: (random.Random(c).choice((0, 3, 99, 7)), c % 14) for c in range(27)}
    given = spark.createDataFrame([(c, b, h, "x") for c, (b, h) in heads.items()], "conv_id int, base_id int, head int, turn string")
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), given)) == brute(rows, heads)


def test_colliding_fingerprints_are_found_and_drawn_again(spark):
    rows = conversations(random.Random(5), 12)
    df, heads = spark.createDataFrame(rows, SCHEMA), contract_heads(rows)
    given = spark.createDataFrame([(c, b, h) for c, (b, h) in heads.items()], "conv_id bigint, base_id bigint, head bigint")
    turns = prefix_trie.stored_turns(df)
    flat = prefix_trie.rebuilt_paths(prefix_trie.prefix_products(turns, 0, 0), given, 0)
    assert prefix_trie._verified_nodes(flat) is None
    _, nodes = prefix_trie.trie_paths(df, given, base=0)
    assert nodes.count() == len(brute(rows, heads))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    heads = df.select("conv_id", F.col("conv_id").alias("base_id"), F.col("turn").alias("head"))
    assert prefix_trie.prefix_trie(df, heads).count() == 0
