"""Near copies by five-word Jaccard similarity: SimHash fingerprints linked through vantage-point trees, and
MinHash bands and a prefix filter for the pairs that differ in more bits; every link is verified.

SimHash goes first: each unit has a fingerprint, units whose fingerprints one group of the trees
holds are compared with the smallest of the group, and the links among them count from then on.
Similarity of 0.8 leaves up to 11 bits, where the trees no longer prune, so that MinHash looks for the rest.

A text is the set of its five-word shingles (A-Z lower-cased; a shorter text is one shingle). Texts
with equal sets are one unit. A unit has BANDS keys, each made of WIDTH minima; two units of
similarity s share one with probability 1 - (1 - s^WIDTH)^BANDS, 0.99993 at 0.8. Units that share
no key with any other are done.

Of the others every shingle gets a place in its unit, rare shingles first. If two units of m and k
shingles reach 0.8, they share at least 4/9 (m + k), so behind the places p and q of their first
common shingle there are as many: min(m - p, k - q) >= 4/9 (m + k). So only the first fifth of a
unit is indexed, pairs are looked for among equal indexed shingles, and a passage that many texts
have in common is indexed only where little else stands in the text.

Under each shingle all units are compared with the one where it stands first, which links large
groups of near copies by a star. Then only units outside the largest linked group of a shingle
are compared with the units of other groups under it: all of them, so no link between groups is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlab.llm.common import bounded_batches
from flowlab.llm.simhash import components, edges, fingerprint, kept_rows
from flowlab.sources.staging import remove, stage

SEED = 42
WORDS = 5
BANDS, WIDTH = 24, 5
ROWS = 1 << 12
SALTS = np.array([xxhash.xxh64_intdigest(b"%d" % i, SEED) for i in range(BANDS * WIDTH)], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Distinct XXH64 of the five-word shingles, in order; none for a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) < WORDS:
        runs = iter([b" ".join(w)] if w else [])
    else:
        runs = map(b" ".join, zip(*(w[i:] for i in range(WORDS))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key per band, signed. Texts without words share all keys."""
    least = np.full(len(SALTS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(hashes), ROWS):
        mixed = (hashes[i : i + ROWS] ^ SALTS[:, None]) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(33)
        mixed *= np.uint64(0xC4CEB9FE1A85EC53)
        least = np.minimum(least, mixed.min(axis=1))
    keys = [xxhash.xxh64_intdigest(b.tobytes(), n) for n, b in enumerate(least.reshape(BANDS, WIDTH))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _unit(hashes: np.ndarray) -> str:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest()


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text_hash, unit, size, keys, fp) of every row, staged: texts are read once."""
    bounded_batches(df.sparkSession)
    narrow = df.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    names = ["doc_id", "text_hash", "unit", "size", "keys", "fp"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit, size, keys, fp = [], [], [], []
            for t in b.column("text"):
                h = shingles(t.as_py())
                unit.append(_unit(h))
                size.append(len(h))
                keys.append(band_keys(h))
                fp.append(fingerprint(t.as_py()))
            out = [pa.array(unit, pa.string()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(fp, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *out], names)

    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash bigint, unit string, size bigint, keys array<bigint>, fp bigint"
    return stage(narrow.mapInArrow(hashed, schema), "near-rows")


def _sets(df: DataFrame, least: DataFrame, key: str, text: str) -> DataFrame:
    """(unit, shingles) of the units whose least rows are given, staged."""
    narrow = kept_rows(df, least, key, text).select(F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # One text at a time: a set is as large as its text.
            for t in b.column("text"):
                h = shingles(t.as_py())
                out = [pa.array([_unit(h)], pa.string()), pa.array([h.view(np.int64).tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, ["unit", "shingles"])

    return stage(narrow.mapInArrow(cut, "unit string, shingles array<bigint>"), "near-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked): whether similarity is 0.8 or more, staged."""
    a = sets.select(F.col("unit").alias("a"), F.col("shingles").alias("_a"))
    b = sets.select(F.col("unit").alias("b"), F.col("shingles").alias("_b"))
    both = pairs.join(a, "a").join(b, "b")
    both = both.select("a", "b", F.size(F.array_intersect("_a", "_b")).alias("_both"), (F.size("_a") + F.size("_b")).alias("_sum"))
    # In whole numbers: both / (sum - both) >= 4 / 5.
    return stage(both.select("a", "b", (9 * F.col("_both").cast("bigint") >= 4 * F.col("_sum").cast("bigint")).alias("linked")), "near-verified")


def _larger_first(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _indexed(sets: DataFrame) -> DataFrame:
    """(token, unit, m, p), staged: the first fifth of every unit's shingles in order of (units that have it, shingle),
    without those that no other unit has."""
    tokens = sets.select("unit", F.size("shingles").alias("m"), F.explode("shingles").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = tokens.join(common, "token")
    own = W.partitionBy("unit")
    placed = shared.withColumn("p", F.col("m") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("n", "token")) - 1)
    return stage(placed.where("5 * (m - p) >= 4 * m").select("token", "unit", "m", "p"), "near-index")


def _possible(x: str, y: str) -> Column:
    """Whether two units can reach 0.8 if they meet under their first common shingle."""
    m, k = F.col(f"{x}.m"), F.col(f"{y}.m")
    behind = F.least(m - F.col(f"{x}.p"), k - F.col(f"{y}.p"))
    return (5 * F.least(m, k) >= 4 * F.greatest(m, k)) & (9 * behind >= 4 * (m + k))


def fingerprint_pairs(units: DataFrame) -> DataFrame:
    """(a, b) with a > b, staged: each unit with the smallest unit of its SimHash group. A unit is one point, with the
    smallest fingerprint of its texts."""
    points = stage(units.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "unit-fingerprints")
    roots = components(edges(points)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    grouped = units.select("unit", "fp").join(roots, "fp", "left").select("unit", F.coalesce("root", "fp").alias("root"))
    grouped = stage(grouped, "simhash-units")
    least = grouped.groupBy("root").agg(F.min("unit").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = grouped.join(least, "root").where("unit != least").select(F.col("unit").alias("a"), F.col("least").alias("b"))
    out = stage(pairs, "simhash-pairs")
    remove(points, grouped)
    return out


def links(df: DataFrame, units: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b) with a > b, staged: linked units, enough of them to tell the groups."""
    alike = fingerprint_pairs(units)
    buckets = units.select("unit", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    met = alike.select(F.col("a").alias("unit")).unionByName(alike.select(F.col("b").alias("unit")))
    wanted = buckets.join(shared, "key").select("unit").unionByName(met).distinct()
    sets = _sets(df, units.join(wanted, "unit").select("least"), key, text)
    index = _indexed(sets)
    first = index.groupBy("token").agg(F.min(F.struct("p", "unit", "m")).alias("c"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    x, c = index.alias("x"), first.select("token", "c.*").alias("c")
    star = x.join(c, (F.col("x.token") == F.col("c.token")) & (F.col("x.unit") != F.col("c.unit")) & _possible("x", "c"))
    stars = _verified(star.select(*_larger_first(F.col("x.unit"), F.col("c.unit"))).distinct(), sets)
    simhash = _verified(alike, sets)
    near = stars.unionByName(simhash).where("linked").select("a", "b").distinct()
    roots = components(near)
    members = index.join(roots.select(F.col("a").alias("unit"), F.col("b").alias("root")), "unit", "left")
    members = stage(members.withColumn("root", F.coalesce("root", "unit")), "near-members")
    groups = members.groupBy("token", "root").agg(F.count(F.lit(1)).alias("_n"))
    largest = groups.groupBy("token").agg(F.max(F.struct("_n", "root"))["root"].alias("largest"), F.count(F.lit(1)).alias("_n"))
    seen = members.join(largest.where("_n > 1").select("token", "largest"), "token")
    x, y = seen.where("root != largest").alias("x"), seen.alias("y")
    apart = (
        (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & _possible("x", "y")
        & ((F.col("y.root") == F.col("y.largest")) | (F.col("x.unit") > F.col("y.unit")))
    )
    rest = x.join(y, apart).select(*_larger_first(F.col("x.unit"), F.col("y.unit"))).distinct()
    more = _verified(rest, sets)
    out = stage(near.unionByName(more.where("linked").select("a", "b")), "near-links")
    remove(alike, simhash, sets, index, stars, roots, members, more)
    return out


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of df per group of near copies: that of the smallest key (null last), then text hash.
    Of rows equal in both one stays. All columns of df are kept. Groups are joined over links."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = _rows(df, key, text)
    units = rows.groupBy("unit").agg(F.min("size").alias("size"), F.min(row).alias("least"), F.first("keys").alias("keys"), F.min("fp").alias("fp"))
    units = stage(units, "near-units")
    linked = links(df, units, key, text)
    roots = components(linked)
    grouped = units.select("unit", "least").join(roots.select(F.col("a").alias("unit"), F.col("b").alias("root")), "unit", "left")
    leasts = stage(grouped.groupBy(F.coalesce("root", "unit")).agg(F.min("least").alias("least")), "near-leasts")
    remove(rows, units, linked, roots)
    return kept_rows(df, leasts, key, text)
