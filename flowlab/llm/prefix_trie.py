"""Prefix trie of conversations that are put together from the head of one and the rest of another.

A turn is stored once and named by its address, the SHA-256 of role and text. In each of LANES
lanes it has an element e, a hash of its address below the prime P, and a sequence of turns has
the product (length, sum of e_i * BASE^i mod P). Products form a monoid:

    (m, x) * (n, y) = (m + n, x + BASE^m * y)

so a rebuilt conversation, base head then own suffix, gets the fingerprints of all its prefixes
from the prefix products of the two conversations as they stand: no rebuilt text is ever made.
An own suffix that moves to another place is scaled by a power of BASE.

A node is a depth and a fingerprint. Every path row refers to its last stored turn by address and to
its parent by fingerprint; a group is right if all its rows refer to the same turn and the same
parent, which by induction makes all prefixes equal. This is verified in the aggregation that
makes the nodes; if it fails anywhere, the elements are drawn again with the next seed.

Sums over subtrees need no walk: a node belongs to its smallest member, and the nodes below v
are those that members of v own at the depth of v or deeper. So a running total along each
conversation, summed over the members of v, is the total of v's subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import bounded_batches
from flowlab.operators.ordering import global_index, running_totals
from flowlab.sources.staging import stage

P = (1 << 31) - 1
BASE = 1_103_515_245 % P
LANES = 4
SEEDS = range(8)
NODE = ["depth", "f", "g"]
PARENT = ["parent_depth", "pf", "pg"]


def power(base: int, exponent: Column) -> Column:
    """base^exponent mod P for exponents from 0."""
    bits = F.array(*(
        F.struct(F.lit(1 << j).cast("bigint").alias("bit"), F.lit(pow(base, 1 << j, P)).cast("bigint").alias("value"))
        for j in range(40)
    ))
    return F.aggregate(
        bits, F.lit(1).cast("bigint"),
        lambda x, s: F.when(exponent.bitwiseAND(s["bit"]) != 0, x * s["value"] % P).otherwise(x),
    )


def stored_turns(df: DataFrame) -> DataFrame:
    """(conv_id, place, address, bytes), staged: turns of a conversation from place 1 on, by turn (null
    first), then role, then address. Null roles and texts are empty; a repeated row is a turn of
    its own; rows without conv_id belong to no conversation and take no part."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("address"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    placed = global_index(rows, ["turn", "role", "address"], by=["conv_id"], index="place")
    return stage(placed.select("conv_id", (F.col("place") + 1).alias("place"), "address", "bytes"), "trie-turns")


def prefix_products(turns: DataFrame, seed: int, base: int = BASE) -> DataFrame:
    """Adds per lane the turn's own term e<k> and the sum s<k> of all terms up to it, staged."""
    shift = turns.withColumn("_power", power(base, F.col("place")))
    terms = {
        f"e{k}": F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "address"), F.lit(P)).cast("bigint") * F.col("_power") % P
        for k in range(LANES)
    }
    lanes = list(terms)
    summed = running_totals(shift.withColumns(terms).drop("_power"), ["conv_id"], ["place"], lanes)
    upto = [((F.col(f"e{k}_before") + F.col(f"e{k}")) % P).alias(f"s{k}") for k in range(LANES)]
    return stage(summed.select(*turns.columns, *lanes, *upto), "trie-products")


def _plan(products: DataFrame, heads: DataFrame, base: int) -> DataFrame:
    """Per rebuilt conversation: conv_id, base_id, head, join (turns taken from the base), size, and
    the constants that turn a prefix product of the own turns into one of the rebuilt turns."""
    lengths = products.groupBy("conv_id").agg(F.max("place").alias("n"))
    own = lengths.withColumnRenamed("n", "own_n")
    other = lengths.select(F.col("conv_id").alias("base_id"), F.col("n").alias("base_n"))
    plan = heads.join(own, "conv_id", "left").join(other, "base_id", "left").fillna(0, ["own_n", "base_n"])
    plan = plan.withColumn("join", F.least("head", "base_n"))
    plan = plan.withColumn("size", F.col("join") + F.greatest(F.lit(0), F.col("own_n") - F.col("head")))
    sums = [F.col(f"s{k}").alias(f"b{k}") for k in range(LANES)]
    at_join = products.select(F.col("conv_id").alias("base_id"), F.col("place").alias("join"), *sums)
    sums = [F.col(f"s{k}").alias(f"c{k}") for k in range(LANES)]
    at_head = products.select("conv_id", F.col("place").alias("head"), *sums)
    plan = plan.join(at_join, ["base_id", "join"], "left").join(at_head, ["conv_id", "head"], "left")
    plan = plan.fillna(0, [f"{x}{k}" for x in "bc" for k in range(LANES)])
    # Without an inverse the own terms cannot move; the groups will not verify and the seed goes on.
    scale = power(pow(base, -1, P) if base % P else 0, F.col("head") - F.col("join"))
    plan = plan.withColumn("scale", scale)
    start = {f"d{k}": F.pmod(F.col(f"b{k}") - F.col(f"c{k}") * F.col("scale") % P, F.lit(P)) for k in range(LANES)}
    return stage(plan.withColumns(start).select("conv_id", "base_id", "head", "join", "size", "scale", *start), "trie-plan")


def _packed(lanes: list[Column], names: tuple[str, str]) -> list[Column]:
    """Four lanes of 31 bits in two whole numbers."""
    return [(lanes[i] * (1 << 31) + lanes[i + 1]).alias(n) for i, n in zip((0, 2), names)]


def rebuilt_paths(products: DataFrame, heads: DataFrame, base: int = BASE) -> DataFrame:
    """(conv_id, size, depth, f, g, parent_depth, pf, pg, address, bytes), staged: one row per rebuilt conversation and
    prefix, the empty one included."""
    plan = _plan(products, heads, base)
    t, p = products.alias("t"), plan.alias("p")

    def rows(joined: DataFrame, depth: Column, moved) -> DataFrame:
        whole = [moved(k)[0] for k in range(LANES)]
        above = [F.pmod(moved(k)[0] - moved(k)[1], F.lit(P)) for k in range(LANES)]
        return joined.select(
            F.col("p.conv_id").alias("conv_id"), "p.size", depth.alias("depth"), *_packed(whole, ("f", "g")),
            (depth - 1).alias("parent_depth"), *_packed(above, ("pf", "pg")), "t.address", "t.bytes",
        )

    head = p.join(t, (F.col("p.base_id") == F.col("t.conv_id")) & (F.col("t.place") <= F.col("p.join")))
    head = rows(head, F.col("t.place"), lambda k: (F.col(f"t.s{k}"), F.col(f"t.e{k}")))
    rest = p.join(t, (F.col("p.conv_id") == F.col("t.conv_id")) & (F.col("t.place") > F.col("p.head")))
    rest = rows(
        rest, F.col("t.place") - F.col("p.head") + F.col("p.join"),
        lambda k: ((F.col(f"p.d{k}") + F.col(f"t.s{k}") * F.col("p.scale") % P) % P, F.col(f"t.e{k}") * F.col("p.scale") % P),
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = plan.select(
        "conv_id", "size", zero.alias("depth"), zero.alias("f"), zero.alias("g"), none.alias("parent_depth"),
        none.alias("pf"), none.alias("pg"), F.lit("").alias("address"), zero.alias("bytes"),
    )
    return stage(head.unionByName(rest).unionByName(root), "trie-paths")


def _verified_nodes(paths: DataFrame) -> DataFrame | None:
    """(depth, f, g, parent_depth, pf, pg, conv_id, n_convs, bytes), or None if a group holds different prefixes."""
    parent = F.struct(*PARENT)
    nodes = stage(paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"),
        F.min(parent).alias("parent"), (F.min(parent) == F.max(parent)).alias("_one_parent"),
        (F.min("address") == F.max("address")).alias("_one_turn"),
    ), "trie-nodes")
    if not nodes.where(~F.col("_one_turn") | ((F.col("depth") > 0) & ~F.col("_one_parent"))).isEmpty():
        return None
    return nodes.select(*NODE, "parent.*", "conv_id", "n_convs", "bytes")


def trie_paths(df: DataFrame, heads: DataFrame, base: int = BASE) -> tuple[DataFrame, DataFrame]:
    """The path rows and the nodes, verified."""
    turns = stored_turns(df)
    for seed in SEEDS:
        paths = rebuilt_paths(prefix_products(turns, seed, base), heads, base)
        nodes = _verified_nodes(paths)
        if nodes is not None:
            return paths, nodes
        base = pow(BASE, seed + 2, P)
    raise RuntimeError(f"fingerprints of {LANES} lanes collide under {len(SEEDS)} seeds")


def _ends(paths: DataFrame) -> DataFrame:
    """(depth, f, g, ends_sha256) of nodes at which conversations end: their ids, ascending, as a stream that
    holds one hash state at a time."""
    bounded_batches(paths.sparkSession, 10_000)
    rows = paths.where("depth = size").select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    names = [*NODE, "ends_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            done = []
            for *here, conv in zip(*(b.column(c).to_pylist() for c in (*NODE, "conv_id"))):
                if here == node:
                    state.update(b",%d" % conv)
                else:
                    done += [(*node, state.hexdigest())] if node else []
                    node, state = here, hashlib.sha256(b"%d" % conv)
            yield _batch(done, names)
        yield _batch([(*node, state.hexdigest())] if node else [], names)

    return rows.mapInArrow(digest, "depth bigint, f bigint, g bigint, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def prefix_trie(df: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    df: (conv_id, turn, role, text); heads: (conv_id, base_id, head), one row per conversation to be built from the
    first `head` turns of base_id (all if fewer, none if it is absent) and its own turns after its
    first `head`. Gives conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Ties of turn, repeated rows and nulls: see stored_turns. A conversation
    without turns ends at the root. Without heads there are no nodes. Further columns of both
    tables do not matter.
    """
    heads = heads.select(*(F.col(c).cast("bigint").alias(c) for c in ("conv_id", "base_id", "head")))
    paths, nodes = trie_paths(df, heads)
    children = nodes.where("depth > 0").groupBy(*(F.col(p).alias(n) for p, n in zip(PARENT, NODE))).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = stage(nodes.join(children, NODE, "left").fillna(0, ["n_children"]), "trie-children")
    owned = nodes.select(
        "conv_id", "depth", (F.col("n_children") == 0).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    along = paths.select("conv_id", *NODE).join(owned, ["conv_id", "depth"], "left").fillna(0, ["leaves", "saved"])
    along = running_totals(along, ["conv_id"], ["depth"], ["leaves", "saved"])
    below = along.groupBy(*NODE).agg(*(
        F.sum(F.col(f"{c}_total") - F.col(f"{c}_before")).alias(n)
        for c, n in (("leaves", "n_leaves"), ("saved", "saved_tokens"))
    ))
    parents = nodes.select(*(F.col(n).alias(p) for p, n in zip(PARENT, NODE)), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below, NODE).join(_ends(paths), NODE, "left").join(parents, PARENT, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
