"""Samples and train / test splits that do not depend on partitioning.

Three kinds: hash buckets (a filter in the scan, no shuffle, approximate size), exact quotas of
the smallest key digests (one small histogram), and ordered cuts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlab.functions.hashing import SLOTS, bucket, edge, leading_bits, row_digest
from flowlab.operators.dedup import except_distinct
from flowlab.operators.ordering import CLASS, global_index, hash_cut, order_cut
from flowlab.schemas import TARGET
from flowlab.sources.staging import stage
from flowlab.sources.tables import scan_source

Split = tuple[DataFrame, DataFrame]
INDEX_DIGITS = 15


def _halves(flagged: DataFrame, flag: str) -> Split:
    return flagged.where(F.col(flag)).drop(flag), flagged.where(~F.col(flag)).drop(flag)


def hash_sample(df: DataFrame, fraction: float, keys: list[str], seed: str = "sample") -> DataFrame:
    """About `fraction` of the rows; samples of one seed are nested. 1.0 returns the input."""
    if fraction >= 1.0:
        return df
    return df.where(bucket(keys, seed) < edge(fraction))


def hash_split(df: DataFrame, keys: list[str], train: float = 0.8, seed: str = "split") -> Split:
    """About 80 / 20; exact copies fall on the same side."""
    b, cut = bucket(keys, seed), edge(train)
    return df.where(b < cut), df.where(b >= cut)


def largest_remainder(size: Callable[[str], str], group: str = CLASS) -> Callable[[DataFrame], DataFrame]:
    """Quotas that add up to `size` and follow the class shares: the floor of each share, then
    one more for the largest remainders. `size` writes the total as SQL over the row count."""

    def quota(totals: DataFrame) -> DataFrame:
        # One row per class; decimals, because the product of two counts can pass 2^63.
        whole = W.partitionBy(F.lit(0))
        sized = totals.withColumn("_all", F.sum("n").over(whole))
        sized = sized.withColumn("_size", F.least(F.expr(size("_all")).cast("bigint"), F.col("_all")))
        product = "cast(_size as decimal(19, 0)) * cast(n as decimal(19, 0))"
        base = sized.select(
            group,
            "_size",
            F.expr(f"{product} div cast(_all as decimal(19, 0))").alias("_floor"),
            F.expr(f"({product}) % _all").alias("_rest"),
        )
        order = W.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), group)
        spare = F.col("_size") - F.sum("_floor").over(whole)
        extra = (F.row_number().over(order) <= spare).cast("bigint")
        return base.select(group, (F.col("_floor") + extra).alias("quota"))

    return quota


def size_quotas(counts: DataFrame, source: str, label: str, sizes: Sequence[int]) -> DataFrame:
    """(source, dataset_size, label, quota): how many rows of each class a sample of each size takes from each
    source, class shares kept; sizes above a source's rows are left out. `counts` has one row (source, label, n) per
    class, so all sizes of all sources come from one pass over the data."""
    whole = W.partitionBy(source)
    size = F.explode(F.array(*(F.lit(int(s)).cast("bigint") for s in sizes))).alias("dataset_size")
    sized = counts.withColumn("_all", F.sum("n").over(whole)).select("*", size).where("dataset_size <= _all")
    product = "cast(dataset_size as decimal(19, 0)) * cast(n as decimal(19, 0))"
    base = sized.withColumns({"_floor": F.expr(f"{product} div cast(_all as decimal(19, 0))"), "_rest": F.expr(f"({product}) % _all")})
    rung = W.partitionBy(source, "dataset_size")
    spare = F.col("dataset_size") - F.sum("_floor").over(rung)
    extra = (F.row_number().over(rung.orderBy(F.desc("_rest"), label)) <= spare).cast("bigint")
    return base.select(source, "dataset_size", label, (F.col("_floor") + extra).alias("quota"))


def stratified_sample(df: DataFrame, n: int, keys: list[str], label: str = TARGET, seed: str = "") -> DataFrame:
    """Exactly n rows with the class shares kept, null being a class; the whole table if it has no
    more than n."""
    drawn = hash_cut(df, keys, largest_remainder(lambda _: str(int(n))), by=label, seed=seed)
    return drawn.where("in_draw").drop("in_draw")


def sample_with_replacement(df: DataFrame, n: int, order: list[str], seed: str = "draw") -> DataFrame:
    """n independent draws of a row position, looked up in the indexed table."""
    indexed = global_index(df, order)
    size = indexed.count()
    if size == 0:
        return df.withColumn("draw", F.lit(0).cast("bigint"))
    text = F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))
    pick = leading_bits(F.md5(text), INDEX_DIGITS) % F.lit(size)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), pick.alias("row_index"))
    return indexed.join(draws, "row_index").drop("row_index")


def slot_draws(df: DataFrame, n: int, keys: list[str], seed: str = "draw") -> DataFrame:
    """n independent draws with replacement, numbered `draw`; position p is that of the p-th row in order of
    the key digest, ties by all other columns.

    The histogram of digest slots is turned around: its running counts tell in which slot a position
    falls, and only rows of slots that are hit are put in order. df is scanned twice and never
    staged as a whole. Null is a value, copies share their positions, an empty table gives no draws.
    """
    spark = df.sparkSession
    digest = row_digest(keys, seed)
    marked = df.withColumns({"_digest": digest, "_slot": F.shiftright(leading_bits(digest), 16).cast("int")})
    slots = marked.groupBy("_slot").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0))
    slots = stage(slots, "slots")
    size = slots.agg(F.sum("n")).first()[0]
    if not size:
        return df.withColumn("draw", F.lit(0).cast("bigint"))
    # At most SLOTS rows pass through this window.
    first = F.sum("n").over(W.partitionBy("_all").orderBy("_slot")) - F.col("n")
    edges = slots.select("_slot", first.alias("_first"), (first + F.col("n")).alias("_end"))
    # Equal stretches of positions, as many as slots, bring a draw together with the few slots it may lie in.
    stretch = lambda position: (position * F.lit(SLOTS) / F.lit(size)).cast("int")
    near = F.explode(F.sequence(stretch(F.col("_first")), stretch(F.col("_end")))).alias("_near")
    edges = stage(edges.select("*", near), "edges")
    text = F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))
    pick = leading_bits(F.md5(text), INDEX_DIGITS) % F.lit(size)
    draws = spark.range(n).select(F.col("id").alias("draw"), pick.alias("_pick")).withColumn("_near", stretch(F.col("_pick")))
    draws = draws.join(edges, "_near").where("_first <= _pick and _pick < _end")
    draws = stage(draws.select("draw", "_slot", (F.col("_pick") - F.col("_first")).alias("_at")), "draws")
    hit = marked.join(draws.select("_slot").distinct(), "_slot", "left_semi")
    placed = global_index(hit, ["_digest"], by=["_slot"], index="_at")
    return placed.join(draws, ["_slot", "_at"]).select(*df.columns, "draw")


def mark_exact(df: DataFrame, keys: list[str], test: float = 0.2, seed: str = "") -> DataFrame:
    """Flags n - ceil(test * n) rows as `in_train`."""
    rows = f"n - cast(ceil(n * cast({float(test)} as double)) as bigint)"
    return hash_cut(df, keys, lambda t: t.withColumn("quota", F.expr(rows)), seed=seed, flag="in_train")


def split_exact(df: DataFrame, keys: list[str], test: float = 0.2, seed: str = "") -> Split:
    return _halves(mark_exact(df, keys, test, seed), "in_train")


def mark_stratified(
    df: DataFrame, keys: list[str], test: float = 0.2, label: str = TARGET, seed: str = ""
) -> DataFrame:
    """As mark_exact, with the class shares kept on both sides."""
    quota = largest_remainder(lambda n: f"{n} - ceil({n} * cast({float(test)} as double))")
    return hash_cut(df, keys, quota, by=label, seed=seed, flag="in_train")


def split_stratified(
    df: DataFrame, keys: list[str], test: float = 0.2, label: str = TARGET, seed: str = ""
) -> Split:
    return _halves(mark_stratified(df, keys, test, label, seed), "in_train")


def mark_ordered(df: DataFrame, order: list[str], train: float = 0.8) -> DataFrame:
    """Flags the first int(train * n) rows in the given order as `in_train`. The order must be
    total; ties may only be exact copies."""
    n = df.count()
    return order_cut(df, order, math.floor(n * train), n, flag="in_train")


def split_ordered(df: DataFrame, order: list[str], train: float = 0.8) -> Split:
    return _halves(mark_ordered(df, order, train), "in_train")


def split_head_except(
    df: DataFrame, order: list[str], train: float = 0.06, columns: Sequence[str] | None = None
) -> Split:
    """The head trains; the test side is every distinct row that the head does not hold."""
    columns = list(columns or df.columns)
    head = split_ordered(df, order, train)[0].select(columns)
    return head, except_distinct(df.select(columns), head)


def split_by_source(table: DataFrame, train: str, test: str) -> Split:
    return scan_source(table, train), scan_source(table, test)
