"""Total orders over data of any size: row index, running totals, exact cuts.

No window here spans an unbounded group. Rows are range-partitioned into slices, the slices are
staged, and only one small row per slice is looked at globally.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.functions.hashing import SLOTS, leading_bits, row_digest
from flowlab.sources.staging import stage

SLICE = "_slice"
COPIES = "_copies"
COPIES_PER_STEP = 10_000
# The class of a row as text; null is a class.
CLASS = "_class"
CUT_MARGIN = 0.001
SKETCH_ACCURACY = 10_000


def _before(c: str | Column, by: Sequence[str], order: Sequence[str]) -> Column:
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(c).over(w), F.lit(0))


def _slice_offsets(totals: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Per (group, slice): what lies in earlier slices of the group, and the group total.

    One input row per group and slice, so the window stays small whatever the data size.
    """
    if not by:
        totals, by = totals.withColumn("_all", F.lit(0)), ["_all"]
    whole = W.partitionBy(*by)
    return totals.select(
        *by,
        SLICE,
        *(_before(s, by, [SLICE]).alias(f"{s}_offset") for s in sums),
        *(F.sum(s).over(whole).alias(f"{s}_total") for s in sums),
    ).drop("_all")


def running_totals(df: DataFrame, by: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """Adds `<s>_before` (sum of s over earlier rows of the group) and `<s>_total`.

    (by, order) must be unique: pre-aggregate first, which also takes care of hot values.
    """
    return _within(_sliced(df, by + order), by, order, sums)


def _sliced(df: DataFrame, keys: list[str]) -> DataFrame:
    """Staged rows with the number of their range partition."""
    return stage(df.repartitionByRange(*keys).withColumn(SLICE, F.spark_partition_id()), "slices")


def _within(sliced: DataFrame, by: list[str], order: list[str], sums: list[str]) -> DataFrame:
    here = by + [SLICE]
    totals = sliced.groupBy(*here).agg(*(F.sum(s).alias(s) for s in sums))
    local = sliced.withColumns({f"{s}_before": _before(s, here, order) for s in sums})
    # Staged, so its size is known: a small table is broadcast, a large one is not.
    joined = local.join(stage(_slice_offsets(totals, by, sums), "offsets"), here)
    shifted = {f"{s}_before": F.col(f"{s}_before") + F.col(f"{s}_offset") for s in sums}
    return joined.withColumns(shifted).drop(SLICE, *(f"{s}_offset" for s in sums))


def counted(df: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies; copies are merged before the shuffle."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(COPIES))


def _total_order(df: DataFrame, order: list[str], by: list[str]) -> list[str]:
    """The order, continued by all other columns: what still ties are exact copies."""
    return order + [c for c in df.columns if c not in order and c not in by]


def _placed(df: DataFrame, order: list[str], by: list[str]) -> tuple[DataFrame, bool]:
    """Distinct rows with their copies and the rows before them; and whether any has so many
    copies that they must be written out in steps."""
    # Grouping makes -0.0 a 0.0; marks keep them apart and bring the original back.
    floats = [c for c in df.columns if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))]
    marks = {f"_minus_{i}": F.col(c).cast("string").eqNullSafe("-0.0") for i, c in enumerate(floats)}
    original = {
        c: F.when(F.col(m), F.lit(-0.0).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, m in zip(floats, marks)
    }
    merged = counted(df.withColumns(marks)) if marks else counted(df)
    total = _total_order(df, order, by) + list(marks)
    sliced = _sliced(merged, by + total)
    hot = not sliced.where(F.col(COPIES) > COPIES_PER_STEP).isEmpty()
    placed = _within(sliced, by, total, [COPIES])
    return (placed.withColumns(original).drop(*marks) if marks else placed), hot


def global_index(
    df: DataFrame, order: list[str], by: Sequence[str] = (), index: str = "row_index"
) -> DataFrame:
    """Position 0 .. n - 1 of each row in the order (within its group, if `by` is given)."""
    placed, hot = _placed(df, order, list(by))
    rows = repeat_rows(placed.drop(f"{COPIES}_total"), number="_copy", hot=hot)
    return rows.withColumn(index, F.col(f"{COPIES}_before") + F.col("_copy")).drop(f"{COPIES}_before", "_copy")


def _first_rows(df: DataFrame, order: list[str], by: list[str], need: Column, flag: str) -> DataFrame:
    """Flags the first `need` rows of each group; copies that straddle the cut are shared out."""
    out = [*df.columns, flag]
    placed, hot = _placed(df, order, by)
    inside = F.greatest(F.lit(0), F.least(F.col(COPIES), need - F.col(f"{COPIES}_before")))
    sides = F.array(
        F.struct(F.lit(True).alias(flag), inside.cast("bigint").alias("_n")),
        F.struct(F.lit(False).alias(flag), (F.col(COPIES) - inside).cast("bigint").alias("_n")),
    )
    rows = placed.select(*df.columns, F.inline(sides)).where("_n > 0")
    return repeat_rows(rows.withColumnRenamed("_n", COPIES), hot=hot).select(out)


def repeat_rows(
    df: DataFrame, copies: str = COPIES, number: str | None = None, hot: bool | None = None
) -> DataFrame:
    """Each row as often as its count says, numbered from 0 on request. Large counts are cut into
    steps that are spread over the cluster before they are written out; `hot` says whether there
    are any, if that is known."""
    out = [c for c in df.columns if c != copies]
    table = df if hot is False else stage(df, "copies")
    n, first, step = F.col(copies), F.lit(0).cast("bigint"), F.lit(COPIES_PER_STEP).cast("bigint")

    def written(rows: DataFrame, start: Column, stop: Column) -> DataFrame:
        rows = rows.select(*out, F.explode(F.sequence(start, stop - 1)).alias("_number"))
        return rows.withColumnRenamed("_number", number) if number else rows.select(*out)

    many = table.where(n > COPIES_PER_STEP)
    if hot is False or many.isEmpty():
        return written(table, first, n)
    many = many.select("*", F.explode(F.sequence(first, n - 1, step)).alias("_from")).repartition("_from", *out)
    many = written(many, F.col("_from"), F.least(n, F.col("_from") + step))
    return written(table.where(n <= COPIES_PER_STEP), first, n).unionByName(many)


def hash_cut(
    df: DataFrame,
    keys: list[str],
    quota: Callable[[DataFrame], DataFrame],
    by: str | None = None,
    seed: str = "",
    flag: str = "in_draw",
) -> DataFrame:
    """Marks exactly `quota` rows per group: those with the smallest key digests.

    `quota` maps a table (CLASS, n) to (CLASS, quota); null is a class of its own. A histogram over 65,536 digest slots finds
    the slot in which each quota falls; rows in other slots are decided by a comparison in the
    scan, and only the rows of that one slot are put in order. Keys must identify a row.
    """
    columns = df.columns
    group = CLASS
    label = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")) if by else F.lit("")
    digest = row_digest(keys, seed)
    marked = df.withColumns({
        "_digest": digest,
        "_slot": F.shiftright(leading_bits(digest), 16).cast("int"),
        group: label,
    })
    slots = stage(marked.groupBy(group, "_slot").agg(F.count(F.lit(1)).alias("n")), "slots")
    wanted = quota(slots.groupBy(group).agg(F.sum("n").alias("n"))).select(group, "quota")
    # At most SLOTS rows per group pass through this window.
    edges = (
        slots.withColumn("_before", _before("n", [group], ["_slot"]))
        .join(wanted, group)
        .where((F.col("_before") < F.col("quota")) & (F.col("quota") <= F.col("_before") + F.col("n")))
        .select(group, F.col("_slot").alias("_edge"), (F.col("quota") - F.col("_before")).alias("_need"), "n")
    )
    edges = stage(edges.drop("n"), "edges")
    # No edge: the quota is 0 (or less), nothing is drawn.
    if by:
        placed = marked.join(edges, [group], "left")
    else:
        edge = edges.select("_edge", "_need").first() or (None, None)
        placed = marked.withColumns({"_edge": F.lit(edge[0]).cast("int"), "_need": F.lit(edge[1]).cast("bigint")})
    sure = placed.where(F.coalesce(F.col("_slot") != F.col("_edge"), F.lit(True)))
    sure = sure.withColumn(flag, F.coalesce(F.col("_slot") < F.col("_edge"), F.lit(False)))
    close = placed.where(F.col("_slot") == F.col("_edge"))
    close = _first_rows(close, ["_digest", *keys], [group], F.col("_need"), flag)
    out = [*columns, flag]
    return sure.select(out).unionByName(close.select(out))


def order_cut(df: DataFrame, order: list[str], k: int, n: int, flag: str = "in_head") -> DataFrame:
    """Marks the first k of n rows in the given order.

    Quantiles of the leading column bracket the cut, so all but a sliver of the rows is decided
    by a comparison; the sliver is put in order. Without a usable leading column, or when the
    bracket misses, everything is. df is scanned four times.
    """
    out = [*df.columns, flag]
    lead = F.col(order[0])
    bracket = _bracket(df, order[0], k, n)
    if bracket is None:
        return _first_rows(df, order, [], F.lit(k), flag)
    low, high, below = bracket
    # Nulls sort first.
    sure = df.where(lead.isNull() | (lead < low) | (lead > high))
    sure = sure.withColumn(flag, lead.isNull() | (lead < low))
    close = _first_rows(df.where((lead >= low) & (lead <= high)), order, [], F.lit(k - below), flag)
    return sure.select(out).unionByName(close.select(out))


def _bracket(df: DataFrame, lead: str, k: int, n: int) -> tuple[Column, Column, int] | None:
    kind = df.schema[lead].dataType
    exact = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if not isinstance(kind, exact) or not 0 < k < n:
        return None
    c = F.col(lead)
    points = [max(0.0, k / n - CUT_MARGIN), min(1.0, k / n + CUT_MARGIN)]
    sketch = F.percentile_approx(c, points, SKETCH_ACCURACY)
    low, high = df.select(sketch.alias("q")).select(F.col("q")[0], F.col("q")[1]).first()
    if low is None:
        return None
    low, high = F.lit(low).cast(kind), F.lit(high).cast(kind)
    below, upto = df.agg(
        F.count_if(c.isNull() | (c < low)), F.count_if(c.isNull() | (c <= high))
    ).first()
    return (low, high, below) if below <= k <= upto else None
