"""Decision trees and forests as tables: grown from class histograms, kept as nodes, scored as expressions.

Features are cut once at exact quantiles, at most BINS bins each, and rows keep the bin numbers. One level of
all trees is one aggregate of (tree, node, feature, bin) class counts; a split is the best prefix of
a node's bins by Gini gain. Every task adds up its rows by array arithmetic, and what leaves it is
bounded by trees x nodes x features x bins, whatever the number of rows. Rows are written once, with their draws
for all trees, and find their node on a level by the splits above it.

Draws are digests of keys, so a forest is the same on any partitioning, and the same in SQL. A node
table also takes the trees of a Spark ML forest, and both kinds score by the same expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlab.functions.cleaning import finite
from flowlab.functions.hashing import bucket, edge
from flowlab.operators.ordering import running_totals
from flowlab.schemas import FEATURES, TARGET
from flowlab.session import share_package
from flowlab.sources.staging import new_folder, stage

BINS = 32
# The rank of a sketched quantile is off by one part in so many at most.
SKETCH_ACCURACY = 1_000
# The distribution function of the Poisson law with mean 1, from 0 on.
POISSON = [0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406]
NODE = "tree int, node int, feature int, threshold double, left int, right int, n0 double, n1 double, gain double"


@dataclass(frozen=True)
class Tree:
    """How one tree is grown: on Poisson draws of rows or on all rows, how many features a node
    chooses from, and which features it may not use."""

    draw: bool = False
    choice: int | None = None
    without: tuple[int, ...] = ()


def thresholds(df: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET, bins: int = BINS) -> list[list[float]]:
    """Cuts of each feature: its values at the multiples of 1 / bins of the rows, at most bins - 1.

    Sketches bracket the cuts. Only values inside a bracket are counted and ranked one by one; all values between two brackets count
    as one. A cut that lies between brackets shows that the sketch missed it: then all values of that feature are ranked.
    """
    share_package(df.sparkSession)
    y = F.col(target)
    values = df.select(*(F.when(y.isin(0, 1), finite(F.col(f).cast("double"))).alias(str(i)) for i, f in enumerate(features)))
    margin = 1.5 / SKETCH_ACCURACY
    points = [p for i in range(1, bins) for p in (max(0.0, i / bins - margin), min(1.0, i / bins + margin))]
    found = values.agg(*(F.percentile_approx(c, points, SKETCH_ACCURACY).alias(c) for c in values.columns)).first()
    brackets = {i: _merged(found[str(i)]) for i in range(len(features)) if found[str(i)]}
    cuts = _exact_cuts(values, brackets, bins)
    inside = lambda i, v: any(low <= v <= high for low, high in brackets[i])
    missed = [i for i in brackets if not all(inside(i, v) for v, _ in cuts[i])]
    if missed:
        cuts |= _exact_cuts(values, {i: [(float("-inf"), float("inf"))] for i in missed}, bins)
    return [sorted(v for v, largest in cuts.get(i, []) if not largest) for i in range(len(features))]


def _merged(edges: Sequence[float]) -> list[tuple[float, float]]:
    """Brackets that do not overlap, in order, from lower and upper ends in turn."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(zip(edges[::2], edges[1::2])):
        if out and low <= out[-1][1]:
            low, high = out[-1][0], max(high, out.pop()[1])
        out.append((low, high))
    return out


def _exact_cuts(values: DataFrame, brackets: dict[int, list[tuple[float, float]]], bins: int) -> dict[int, list[tuple[float, bool]]]:
    """The values at the multiples of 1 / bins per position, and whether one is the largest; exact where they lie inside brackets."""
    cuts: dict[int, list[tuple[float, bool]]] = {i: [] for i in brackets}
    if not brackets:
        return cuts
    counts = values.select(*map(str, brackets)).mapInArrow(_counted_inside(brackets), "position int, value double, n bigint")
    counts = stage(counts.groupBy("position", "value").agg(F.sum("n").alias("n")), "counts")
    ranked = running_totals(counts, ["position"], ["value"], ["n"])
    before, n, total = F.col("n_before"), F.col("n"), F.col("n_total")
    upto = F.floor((before + n) * bins / total)
    cut = F.least(upto, F.lit(bins - 1)) > F.floor(before * bins / total)
    # At most bins - 1 rows per feature.
    for r in ranked.where(cut).select("position", "value", (before + n >= total).alias("largest")).collect():
        cuts[r["position"]].append((float(r["value"]), r["largest"]))
    return cuts


def _counted_inside(brackets: dict[int, list[tuple[float, float]]]) -> Callable:
    """Rows per value inside the brackets of its position; those between two brackets at the next number above the lower one."""
    edges = {i: tuple(np.array(side) for side in zip(*b)) for i, b in brackets.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (low, high) in edges.items():
                x = batch.column(str(i)).drop_null().to_numpy(zero_copy_only=False) + 0.0
                at = np.searchsorted(low, x, side="right") - 1
                above = np.where(at < 0, -np.inf, np.nextafter(high, np.inf).take(np.maximum(at, 0)))
                value, n = np.unique(np.where((at >= 0) & (x <= high.take(np.maximum(at, 0))), x, above), return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "position": pa.array(np.full(len(value), i, np.int32)), "value": pa.array(value), "n": pa.array(n.astype(np.int64)),
                })

    return run


def binned(df: DataFrame, cuts: list[list[float]], features: Sequence[str] = FEATURES, target: str = TARGET, keep: Sequence[str | Column] = ()) -> DataFrame:
    """(y, bins, *keep): bin numbers of the features, a value on a cut belonging to the lower bin."""
    share_package(df.sparkSession)
    values = F.array(*(F.col(f).cast("double") for f in features)).alias("bins")
    wide = df.select(F.col(target).cast("int").alias("y"), values, *keep)
    edges = [np.array(c) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("bins"))
            bins = np.stack([np.searchsorted(at, x[:, i]) for i, at in enumerate(edges)], axis=1).astype(np.int32)
            each = np.arange(0, bins.size + 1, len(edges), dtype=np.int32)
            numbers = pa.ListArray.from_arrays(pa.array(each), pa.array(bins.ravel()))
            yield pa.RecordBatch.from_arrays([numbers if n == "bins" else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return wide.mapInArrow(run, ", ".join(f"`{n}` {'array<int>' if n == 'bins' else t}" for n, t in wide.dtypes))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Arrays of one length as rows of a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.empty((0, 1))


def poisson(keys: list[str], seed: str) -> Column:
    """How often a row is drawn for a bootstrap."""
    b = bucket(keys, seed)
    return reduce(lambda a, p: a + (b >= edge(p)).cast("int"), POISSON, F.lit(0))


def grow(
    df: DataFrame, keys: list[str], trees: Sequence[Tree], depth: int, features: Sequence[str] = FEATURES,
    target: str = TARGET, bins: int = BINS,
) -> DataFrame:
    """The node table of the trees: tree, node, feature (null in a leaf), threshold, left, right, n0, n1, gain.

    Nodes are numbered 1 at the root, 2i and 2i + 1 below i; up to the threshold a row goes left. n0 and n1
    are drawn rows of each class; gain is the drop of Gini impurity. Ties go to the first feature,
    then to the lowest threshold. df holds finite features and a target of 0 or 1, as
    `experiments.prepared` gives; without rows there are no nodes.
    """
    spark = df.sparkSession
    cuts = thresholds(df, features, target, bins)
    draws = F.array(*(poisson(keys, f"tree{i}") if t.draw else F.lit(1) for i, t in enumerate(trees)))
    rows = stage(binned(df, cuts, features, target, [draws.alias("w")]), "tree-rows")
    allowed = [(i, f) for i, t in enumerate(trees) for f in range(len(features)) if f not in t.without]
    choice = [(i, t.choice or len(features)) for i, t in enumerate(trees)]
    allowed = spark.createDataFrame(allowed, "tree int, feature int").join(spark.createDataFrame(choice, "tree int, choice int"), "tree")
    flat = [(f, b, v) for f, c in enumerate(cuts) for b, v in enumerate(c)]
    limits = spark.createDataFrame(flat, "feature int, bin int, threshold double")
    of_class = lambda i, k: F.coalesce(F.sum(F.when(F.col("y") == k, F.col("w")[i]).otherwise(0)), F.lit(0).cast("bigint")).alias(f"n{k}")
    ends = rows.agg(F.array(*(F.struct(F.lit(i).alias("tree"), F.lit(1).alias("node"), of_class(i, 0), of_class(i, 1)) for i in range(len(trees)))).alias("e"))
    nodes = [stage(ends.select(F.inline("e")).where("n0 + n1 > 0"), "tree-roots")]
    splits = []
    # Per tree the split of each inner node: at most trees x 2^depth, read by the driver.
    grown: list[dict[int, tuple[int, int]]] = [{} for _ in trees]
    for level in range(depth):
        counts = _counts(rows, trees, grown, level)
        best = stage(_best(counts, allowed).join(limits, ["feature", "bin"]), "tree-splits")
        splits.append(best.select("tree", "node", "feature", "threshold", "gain"))
        sides = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("l0").alias("n0"), F.col("l1").alias("n1")),
            F.struct((2 * F.col("node") + 1).alias("node"), F.col("r0").alias("n0"), F.col("r1").alias("n1")),
        )
        nodes.append(best.select("tree", F.inline(sides)))
        found = best.select("tree", "node", "feature", "bin").collect()
        for r in found:
            grown[r["tree"]][r["node"]] = r["feature"], r["bin"]
        if not found:
            break
    every, split = reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, splits)
    inner = F.col("feature").isNotNull()
    out = every.join(split, ["tree", "node"], "left").select(
        "tree", "node", "feature", "threshold", F.when(inner, 2 * F.col("node")).alias("left"),
        F.when(inner, 2 * F.col("node") + 1).alias("right"), F.col("n0").cast("double"), F.col("n1").cast("double"),
        F.coalesce("gain", F.lit(0.0)).alias("gain"),
    )
    return stage(out, "tree-nodes")


def _counts(rows: DataFrame, trees: Sequence[Tree], grown: Sequence[dict], level: int) -> DataFrame:
    """(tree, node, feature, bin, c0, c1): drawn rows of each class. Trees on all rows whose splits are the same so far
    are counted once. Every task sends one row per tree, node, feature and bin, however many rows it has."""
    share_package(rows.sparkSession)
    members: dict[object, list[int]] = {}
    for i, t in enumerate(trees):
        members.setdefault(i if t.draw else tuple(sorted(grown[i].items())), []).append(i)
    same = {m[0]: m for m in members.values()}
    schema = "tree int, node int, feature int, bin int, c0 bigint, c1 bigint"
    counts = rows.select("y", "bins", "w").mapInArrow(_task_counts({i: grown[i] for i in same}, level), schema)
    counts = counts.groupBy("tree", "node", "feature", "bin").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    every = F.create_map(*(x for i, m in same.items() for x in (F.lit(i), F.array(*map(F.lit, m)))))
    return counts.select(F.explode(every[F.col("tree")]).alias("tree"), "node", "feature", "bin", "c0", "c1")


def _task_counts(grown: dict[int, dict[int, tuple[int, int]]], level: int) -> Callable:
    """The counts of one task's rows. A row is in a node of the level if every node above it has a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, sums, width, features = 2 ** (level + 1), {}, 0, 0
        ready = {}
        for i, splits in grown.items():
            feature, cut, inner = np.zeros(size, np.intp), np.zeros(size, np.intp), np.zeros(size, bool)
            for node, (f, b) in splits.items():
                if node < size:
                    feature[node], cut[node], inner[node] = f, b, True
            ready[i] = feature, cut, inner
        for batch in batches:
            if not batch.num_rows:
                continue
            y, bins, draws = batch.column("y").to_numpy(zero_copy_only=False), _matrix(batch.column("bins")), _matrix(batch.column("w"))
            features, wider = bins.shape[1], int(bins.max()) + 1
            if wider > width:
                # A task does not know the number of bins before it has seen its rows.
                sums = {i: np.pad(s, ((0, 0), (0, 0), (0, wider - width), (0, 0))) for i, s in sums.items()}
                width = wider
            flat, known = np.ascontiguousarray(bins, np.intp).ravel(), np.isin(y, (0, 1))
            for i, (feature, cut, inner) in ready.items():
                at = np.flatnonzero(known & (draws[:, i] > 0))
                node = np.ones(len(at), np.intp)
                for _ in range(level):
                    live = inner.take(node)
                    at, node = at[live], node[live]
                    node = 2 * node + (flat.take(at * features + feature.take(node)) > cut.take(node))
                here = sums.setdefault(i, np.zeros((size, features, width, 2), np.int64))
                cell, weight = node * features * width * 2 + y.take(at).astype(np.intp), draws[:, i].take(at)
                for f in range(features):
                    add = np.bincount(cell + (f * width + flat.take(at * features + f)) * 2, weight, here.size)
                    here += add.astype(np.int64).reshape(here.shape)
        for i, s in sums.items():
            node, f, b = np.nonzero(s.sum(axis=3))
            ints = [np.full(len(node), i), node, f, b]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.astype(np.int32)) for x in ints), *(pa.array(s[node, f, b, k]) for k in (0, 1))],
                ["tree", "node", "feature", "bin", "c0", "c1"],
            )

    return run


def _best(counts: DataFrame, allowed: DataFrame) -> DataFrame:
    """The best split of each node, if any lowers the impurity."""
    # From here on everything is bounded: nodes x features x bins.
    of = W.partitionBy("tree", "node", "feature")
    upto = of.orderBy("bin")
    sums = counts.select(
        "tree", "node", "feature", "bin", F.sum("c0").over(upto).alias("l0"), F.sum("c1").over(upto).alias("l1"),
        F.sum("c0").over(of).alias("n0"), F.sum("c1").over(of).alias("n1"),
    ).withColumns({"r0": F.col("n0") - F.col("l0"), "r1": F.col("n1") - F.col("l1")})
    gain = (_purity("l") + _purity("r") - _purity("n")) / (F.col("n0") + F.col("n1")).cast("double")
    drawn = F.md5(F.concat_ws("|", F.lit("subset"), "tree", "node", "feature"))
    place = F.dense_rank().over(W.partitionBy("tree", "node").orderBy(drawn, "feature"))
    chosen = sums.join(allowed, ["tree", "feature"]).withColumn("_drawn", place).where("_drawn <= choice and r0 + r1 > 0")
    good = chosen.withColumn("gain", gain).where("gain > 1e-12")
    first = F.row_number().over(W.partitionBy("tree", "node").orderBy(F.desc("gain"), "feature", "bin"))
    return good.withColumn("_first", first).where("_first = 1").drop("_first", "_drawn", "choice")


def _purity(side: str) -> Column:
    a, b = F.col(f"{side}0").cast("double"), F.col(f"{side}1").cast("double")
    return (a * a + b * b) / (a + b)


def ml_nodes(model: PipelineModel) -> DataFrame:
    """The node table of a fitted Spark ML forest, from the table in which Spark stores it."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = new_folder(spark, "forest")
    model.stages[-1].write().save(path)
    stored = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    inner = F.col("leftChild") >= 0
    feature, threshold = F.col("split.featureIndex"), F.element_at("split.leftCategoriesOrThreshold", 1)
    return stored.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.when(inner, feature).alias("feature"),
        F.when(inner, threshold).alias("threshold"), F.when(inner, F.col("leftChild")).alias("left"),
        F.when(inner, F.col("rightChild")).alias("right"), F.col("impurityStats")[0].alias("n0"), F.col("impurityStats")[1].alias("n1"),
        F.when(inner, F.col("gain")).otherwise(0.0).alias("gain"),
    )


def scores(nodes: DataFrame, features: Sequence[str] = FEATURES) -> dict[int, Column]:
    """Per tree the share of attacks in a row's leaf, as an expression over the feature columns. The size of a node
    table is bounded by trees x 2^depth; it is read by the driver."""
    trees: dict[int, dict[int, tuple]] = {}
    for r in nodes.collect():
        trees.setdefault(r["tree"], {})[r["node"]] = r

    def text(tree: dict, node: int) -> str:
        r = tree[node]
        if r["feature"] is None:
            return f"{r['n1'] / (r['n0'] + r['n1'])!r}D"
        return f"CASE WHEN `{features[r['feature']]}` <= {r['threshold']!r}D THEN {text(tree, r['left'])} ELSE {text(tree, r['right'])} END"

    return {i: F.expr(text(tree, min(tree))) for i, tree in sorted(trees.items())}


def forest_score(nodes: DataFrame, features: Sequence[str] = FEATURES) -> Column:
    """The mean over all trees."""
    each = list(scores(nodes, features).values())
    return reduce(lambda a, b: a + b, each) / F.lit(float(len(each)))


def importances(nodes: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """(feature, importance): impurity drop times rows, adding up to 1 per tree that splits, then over all."""
    n = F.col("n0") + F.col("n1")
    per_tree = nodes.where("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * n).alias("drop"))
    per_tree = per_tree.withColumn("share", F.col("drop") / F.sum("drop").over(W.partitionBy("tree")))
    total = per_tree.groupBy("feature").agg(F.sum("share").alias("share"))
    named = nodes.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    whole = F.sum("share").over(W.partitionBy(F.lit(0)))
    out = named.join(total, "feature", "left").fillna(0.0, ["share"])
    return out.select(F.col("name").alias("feature"), F.coalesce(F.try_divide(F.col("share"), whole), F.lit(0.0)).alias("importance"))
