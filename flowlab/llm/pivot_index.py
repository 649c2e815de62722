"""Exact top-k by inner product through a pivot-distance index.

The largest inner product is the smallest distance once every vector x gets a further component
sqrt(M^2 - |x|^2), M the largest norm, and every query a zero: |q - x|^2 = |q|^2 + M^2 - 2 q.x. The
index keys each distinct vector by its nearest pivot and its distance r to it. Rings of r cut a
pivot's vectors into cells, cells are stored in blocks of at most BLOCK vectors in order of r.

A query at distance d from a pivot is at least |d - r| from a vector at r. It first searches the
cells of the smallest such bound that hold k vectors together. Their k-th best score turns into a
distance; all cells whose bound exceeds it are left out, of the others only the annulus around d
is compared. What is left out cannot hold a better score or a tie, so the result is exact
whatever the pivots are; they are fitted on SAMPLE vectors and only decide how much is searched.

Queries go in chunks of CHUNK against blocks, as one product of matrices of bounded size. Cells with many
blocks are dealt in parts. Equal vectors are one entry with their k smallest ids, so a vector that
makes up a third of the table is one entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlab.llm.common import bounded_batches
from flowlab.sources.staging import stage

SAMPLE = 4096
BLOCK = 1024
CHUNK = 256
PART_BLOCKS = 16
MAX_CELLS = 4096
EXACT = 1 << 53
SLACK = 1e-9


def least_ids(vectors: DataFrame, k: int) -> DataFrame:
    """(vector, ids), staged: each distinct vector with its k smallest ids, nulls last. The limit is applied
    before and after the shuffle."""
    place = F.row_number().over(W.partitionBy("vector").orderBy(F.col("vec_id").asc_nulls_last()))
    few = vectors.select("vector", "vec_id").withColumn("_place", place).where(F.col("_place") <= k)
    row = F.array_sort(F.collect_list(F.struct("_place", "vec_id")))
    return stage(few.groupBy("vector").agg(row["vec_id"].alias("ids")), "pivot-vectors")


def padded(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column as rows of equal length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out, at = np.zeros((len(sizes), dim), np.int64), 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


class Space:
    """Pivots, and the distances of vectors and queries to them."""

    def __init__(self, dim: int, norm2: float, largest: int, pivots: np.ndarray):
        self.dim, self.norm2, self.largest = dim, norm2, largest
        self.pivots = pivots.astype(np.float64)
        self.lifts = self.lift(self.pivots)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.norm2 - (x * x).sum(axis=1)))

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        apart = 2 * self.norm2 - 2 * (x @ self.pivots.T) - 2 * np.outer(self.lift(x), self.lifts)
        return np.sqrt(np.maximum(0.0, apart))

    def reach(self, q: np.ndarray) -> np.ndarray:
        """|q|^2 + M^2 of each query."""
        q = q.astype(np.float64)
        return (q * q).sum(axis=1) + self.norm2

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.reach(q)[:, None] - 2 * (q.astype(np.float64) @ self.pivots.T)))

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Inner products in whole numbers; beyond 64 bits they end at the largest such number."""
        size = self.largest * self.largest * max(1, self.dim)
        if size < EXACT:
            return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
        if size < 1 << 63:
            return q @ x.T
        exact = q.astype(object) @ x.T.astype(object)
        return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def fit(groups: DataFrame, cells: int) -> tuple[Space, np.ndarray]:
    """Pivots by farthest-first choice from a sample, and the ring limits of each pivot."""
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    widest = F.aggregate("vector", F.lit(0).cast("decimal(20,0)"), lambda a, x: F.greatest(a, F.abs(x.cast("decimal(20,0)"))))
    bound = groups.agg(F.max(F.size("vector")).alias("dim"), F.max(size).alias("norm2"), F.max(widest).alias("largest")).first()
    rows = groups.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()
    points = padded(pa.array([r.vector for r in rows], pa.list_(pa.int64())), bound.dim)
    number = max(1, int(np.ceil(np.sqrt(cells))))
    chosen = [0]
    space = Space(bound.dim, float(bound.norm2), int(bound.largest), points)
    apart = np.full(len(points), np.inf)
    for _ in range(min(number, len(points)) - 1):
        near = Space(bound.dim, space.norm2, space.largest, points[chosen[-1:]]).of_vectors(points)[:, 0]
        apart = np.minimum(apart, near)
        chosen.append(int(apart.argmax()))
    space = Space(bound.dim, space.norm2, space.largest, points[chosen])
    d = space.of_vectors(points)
    nearest, r = d.argmin(axis=1), d.min(axis=1)
    rings = max(1, -(-cells // len(chosen)))
    shares = np.arange(1, rings) / rings
    limits = [np.quantile(r[nearest == p], shares) if (nearest == p).any() else np.zeros(rings - 1) for p in range(len(chosen))]
    return space, np.array(limits).reshape(len(chosen), rings - 1)


def keyed(groups: DataFrame, space: Space, limits: np.ndarray) -> DataFrame:
    """(pivot, ring, r) beside every row of a table with a column `vector`."""
    names = groups.columns
    rings = limits.shape[1] + 1

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = space.of_vectors(padded(b.column("vector"), space.dim))
            pivot = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
            r = d[np.arange(len(d)), pivot]
            ring = (limits[pivot] <= r[:, None]).sum(axis=1)
            extra = [pa.array(pivot * rings + ring, pa.int64()), pa.array(pivot, pa.int64()), pa.array(r, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*names, "cell", "pivot", "r"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema)
    return groups.mapInArrow(key, f"{schema}, cell bigint, pivot bigint, r double")


def _packed(rows: DataFrame, most: int, limit_to_cell: bool, columns: dict[str, str], name: str) -> DataFrame:
    """Rows in order of (pivot, r), up to `most` of them (of one cell) as one row of lists with a number of its own."""
    ordered = rows.repartitionByRange("pivot", "r").sortWithinPartitions("pivot", "r")
    kinds = {"vector": pa.list_(pa.int64()), "ids": pa.list_(pa.int64()), "r": pa.float64()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            cells = b.column("cell").to_numpy()
            cuts = {0, len(cells), *range(0, len(cells), most)}
            if limit_to_cell:
                # Cut at every change of cell, then by size.
                cuts = {0, len(cells)}
                edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
                for a, z in zip(edges, edges[1:]):
                    cuts.update(range(a, z, most))
            ends = sorted(cuts)
            for a, z in zip(ends, ends[1:]):
                lists = [pa.array([b.column(c)[a:z].to_pylist()], pa.list_(kinds[c])) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([int(cells[a])], pa.int64()), *lists], ["number", "cell", *columns]
                )
                number += 1

    schema = "number bigint, cell bigint, " + ", ".join(f"{c} {t}" for c, t in columns.items())
    return stage(ordered.mapInArrow(pack, schema), name)


class Cells:
    """What is known of every cell: one row per cell, MAX_CELLS rings and pivots at most."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda c: c.cell)
        self.cell, self.pivot, self.count = (np.array([r[c] for r in rows], np.int64) for c in ("cell", "pivot", "n"))
        self.low, self.high = (np.array([r[c] for r in rows], np.float64) for c in ("low", "high"))

    def bounds(self, d: np.ndarray) -> np.ndarray:
        """Per query and cell the distance that no vector of the cell comes below."""
        at = d[:, self.pivot]
        return np.maximum(0.0, np.maximum(at - self.high, self.low - at))


def _probes(chunks: DataFrame, choose: Callable, parts: dict[int, int]) -> DataFrame:
    """(number, cell, part, members, floors): which queries of a chunk look into which cell."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["number", "cell", "part", "members", "floors"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64())]
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                for cell, members, floors in choose(b.slice(i, 1)):
                    rows += [(b.column("number")[i].as_py(), cell, p, members, floors) for p in range(parts[cell])]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)

    return chunks.mapInArrow(probe, "number bigint, cell bigint, part bigint, members array<int>, floors array<double>")


def _found(probes: DataFrame, chunks: DataFrame, blocks: DataFrame, space: Space, k: int) -> DataFrame:
    """(number, place, score, vec_id): the k best of every block for every query that looks into it."""
    queries = probes.join(chunks.select("number", F.col("vector").alias("queries")), "number")
    pairs = queries.join(blocks.drop("number"), ["cell", "part"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = {c: b.column(c)[i] for c in b.schema.names}
                r = one["r"].values.to_numpy()
                members = one["members"].values.to_numpy()
                q = padded(one["queries"].values, space.dim)[members]
                floors = one["floors"].values.to_numpy()
                at = space.of_queries(q)[:, one["pivot"].as_py()]
                # Scores from the floor on are at distances up to `far`.
                reach = space.reach(q)
                far = np.sqrt(np.maximum(0.0, reach - 2 * floors) + SLACK * reach + 2)
                first, last = np.searchsorted(r, (at - far).min()), np.searchsorted(r, (at + far).max(), "right")
                if first == last:
                    continue
                x = padded(one["vector"].values, space.dim)[first:last]
                ids = [v.as_py() for v in one["ids"].values[first:last]]
                yield _best(one["number"].as_py(), members, space.scores(q, x), ids, k)

    return pairs.mapInArrow(search, "number bigint, place int, score bigint, vec_id bigint")


def _best(number: int, members: np.ndarray, scores: np.ndarray, ids: list[list], k: int) -> pa.RecordBatch:
    """Of each query the k best (score, then smaller id, null last), from all entries that tie at the k-th."""
    place, score, vec = [], [], []
    for m, row in zip(members.tolist(), scores):
        least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else row.min()
        rows = [(-int(row[j]), v is None, v) for j in np.flatnonzero(row >= least) for v in ids[j]]
        for s, _, v in sorted(rows, key=lambda t: (t[0], t[1], t[2] or 0))[:k]:
            place.append(m)
            score.append(-s)
            vec.append(v)
    columns = [pa.array([number] * len(place), pa.int64()), pa.array(place, pa.int32()), pa.array(score, pa.int64()), pa.array(vec, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["number", "place", "score", "vec_id"])


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("number", "place").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(vector, found): for each distinct vector of `queries` the k best rows of `vectors` as an ordered array of
    (score, vec_id). Both tables have (vec_id bigint, vector array<bigint>) without nulls in the vectors.

    Vectors of different lengths are compared as if the shorter one ended in zeros. Repeated rows
    are rows of their own. Ties go to the smaller id, null last. Scores beyond 64 bits end at the
    largest number of 64 bits. Fewer than k rows give all; empty tables give an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    groups = least_ids(vectors, k)
    n = groups.count()
    if not n:
        empty = queries.select("vector", F.array(F.struct(F.lit(0).cast("bigint").alias("score"), "vec_id")).alias("found"))
        return empty.limit(0)
    space, limits = fit(groups, min(MAX_CELLS, -(-n // BLOCK)))
    index = stage(keyed(groups, space, limits), "pivot-keys")
    cells = Cells(index.groupBy("cell").agg(
        F.min("pivot").alias("pivot"), F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("n"),
    ).collect())
    parts = {c: max(1, -(-int(m) // (BLOCK * PART_BLOCKS))) for c, m in zip(cells.cell.tolist(), cells.count.tolist())}
    blocks = _packed(index, BLOCK, True, {"vector": "array<array<bigint>>", "ids": "array<array<bigint>>", "r": "array<double>"}, "pivot-blocks")
    rings = limits.shape[1] + 1
    of_cell = F.create_map(*(F.lit(x) for c in parts.items() if c[1] > 1 for x in c)) if max(parts.values()) > 1 else None
    n_parts = F.lit(1) if of_cell is None else F.coalesce(of_cell[F.col("cell")], F.lit(1))
    blocks = blocks.withColumns({
        "part": F.pmod(F.xxhash64("number"), n_parts.cast("bigint")), "pivot": (F.col("cell") / rings).cast("bigint"),
    })
    asked = keyed(queries.select("vector").distinct(), space, limits)
    chunks = _packed(asked, CHUNK, False, {"vector": "array<array<bigint>>"}, "pivot-chunks")

    def first_cells(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds per query and cell, the order of cells, and how many of them hold k entries."""
        bounds = cells.bounds(space.of_queries(q))
        order = np.argsort(bounds, axis=1, kind="stable")
        held = np.cumsum(cells.count[order], axis=1)
        return bounds, order, np.minimum((held < k).sum(axis=1) + 1, len(cells.cell))

    def by_cell(chosen: np.ndarray, floors: np.ndarray) -> Iterator[tuple]:
        for c in np.flatnonzero(chosen.any(axis=0)):
            members = np.flatnonzero(chosen[:, c])
            yield int(cells.cell[c]), members.tolist(), floors[members].tolist()

    def near(chunk: pa.RecordBatch) -> Iterator[tuple]:
        q = padded(chunk.column("vector")[0].values, space.dim)
        _, order, first = first_cells(q)
        chosen = np.zeros(order.shape, bool)
        for i, m in enumerate(first):
            chosen[i, order[i, :m]] = True
        return by_cell(chosen, np.full(len(q), -np.inf))

    def rest(chunk: pa.RecordBatch) -> Iterator[tuple]:
        q = padded(chunk.column("vector")[0].values, space.dim)
        bounds, order, first = first_cells(q)
        floors = np.full(len(q), -np.inf)
        for f in chunk.column("floors")[0].as_py() or []:
            floors[f["place"]] = f["floor"]
        reach = space.reach(q)
        # Annuli in order of their bound; the first beyond the floor ends the search.
        chosen = (reach[:, None] - bounds**2) / 2 + SLACK * reach[:, None] + 1 >= floors[:, None]
        for i, m in enumerate(first):
            chosen[i, order[i, :m]] = False
        return by_cell(chosen, floors)

    home = stage(_found(_probes(chunks, near, parts), chunks, blocks, space, k), "pivot-home")
    kth = _top(home, k).where(F.col("_rank") == k)
    floors = kth.groupBy("number").agg(F.collect_list(F.struct("place", F.col("score").cast("double").alias("floor"))).alias("floors"))
    more = _found(_probes(chunks.join(floors, "number", "left"), rest, parts), chunks, blocks, space, k)
    best = _top(home.unionByName(more), k)
    row = F.struct("_rank", "score", "vec_id")
    best = best.groupBy("number", "place").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    found = F.transform("_rows", lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id"))).alias("found")
    places = chunks.select("number", F.posexplode("vector").alias("place", "vector"))
    return best.select("number", "place", found).join(places, ["number", "place"]).select("vector", "found")


def top_k(vectors: DataFrame, asking: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of (vec_id, vector) that `asking` picks, which needs an id, the k best other
    rows. See `search` for ties, repeated rows and lengths."""
    queries = vectors.where(asking).select(F.col("vec_id").alias("query_id"), "vector")
    found = search(vectors, queries.withColumnRenamed("query_id", "vec_id"), k + 1)
    rows = queries.join(found, "vector")
    own = F.aggregate("vector", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)"))
    own = F.least(own, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint")
    at = F.array_position("found", F.struct(own.alias("score"), F.col("query_id").alias("vec_id")))
    size = F.lit(k + 1).cast("bigint")
    others = F.when(at > 0, F.concat(F.slice("found", F.lit(1), at - 1), F.slice("found", at + 1, size))).otherwise(F.col("found"))
    return rows.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("_at", "_row")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), "_row.vec_id", "_row.score"
    )
