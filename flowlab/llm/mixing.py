"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected to be taken target / size times. Expected copies are
summed along an order of the source's documents, one random offset is added, and a document is
taken once for each whole number its span crosses. Documents are ordered by size class, so each
class gets its share and the words taken come near the target.

The prefix sum spans no unbounded group: it is a sum over classes, one over the slots of a class
and one inside a slot. Expected copies are whole multiples of 2^-24, so sums do not depend on the
order in which they are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlab.llm.common import COPIES_PER_STEP, number, numbered_copies, words
from flowlab.operators.ordering import repeat_rows
from flowlab.sources.staging import stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
UNIT = 1 << 24
SLOTS = 256


def size_class(size: Column) -> Column:
    """Number of digits and the first two of them: at most 90 classes for each power of ten."""
    s = size.cast("string")
    return F.length(s) * 100 + F.substring(F.rpad(s, 2, "0"), 1, 2).cast("int")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, get the weights in turn. What a capped source cannot
    take goes to the others by weight: with sources in order of cap per weight, each either takes
    its cap or all from it on share the rest. One row per source passes through one task.
    """
    everything = W.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))) + 1)
    t = sizes.withColumn("_weight", weight.cast("double"))
    t = t.withColumn("_cap", F.col("source_size") * float(most))
    order = everything.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").isNull(), "source")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = F.max("_level").over(everything)
    t = t.withColumn("_level", left / F.sum("_weight").over(after))
    return t.select("source", "source_size", F.round(F.least("_cap", F.col("_weight") * level), 6).alias("target"))


def _before(c: str, by: Sequence[str], order: Sequence[str | Column]) -> Column:
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(c).over(w), F.lit(0))


def _ranked(
    df: DataFrame, key: str, text: str, source: str, seed: str, weights: Sequence[int], share: float, most: float,
    row: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Per distinct (doc_id, source, text): its copies, their first rank within the source, the expected
    copies of one row and the source's offset, both in units, and the source's size and target. With the
    hash of a whole row, the same per distinct row. Also the staged table of copies."""
    row_hash = [] if row is None else ["row_hash"]
    counted = df.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), F.size(words(text)).cast("bigint").alias("size"),
        F.xxhash64(text).alias("text_hash"), *([] if row is None else [row.alias("row_hash")]),
    )
    merged = counted.groupBy(*counted.columns).agg(F.count(F.lit(1)).alias("_copies"))
    digest = number(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))
    merged = stage(merged.withColumns({"_digest": digest, "_class": size_class(F.col("size"))}), "mix-documents")
    merged = merged.withColumn("_slot", F.pmod("_digest", F.lit(SLOTS)).cast("int"))
    # Null is a source: joins below are on a text that is never null.
    merged = merged.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    blocks = merged.groupBy("source", "_source", "_class", "_slot").agg(
        F.sum("_copies").alias("_rows"), F.sum(F.col("size") * F.col("_copies")).alias("_words")
    )
    blocks = stage(blocks, "mix-blocks")
    classes = blocks.groupBy("source", "_source", "_class").agg(F.sum("_rows").alias("_rows"), F.sum("_words").alias("_words"))
    classes = stage(classes, "mix-classes")
    aims = targets(classes.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, most)
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    offset = F.pmod(number(F.concat_ws("|", F.lit(seed), F.lit("offset"), "_source")), F.lit(UNIT))
    aims = aims.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"), "source_size", "target",
        F.least(F.round(ratio * UNIT), F.lit(float(most * UNIT))).cast("bigint").alias("_expected"),
    ).withColumn("_offset", offset)
    # At most a few hundred classes per source, at most SLOTS slots per class.
    classes = classes.select("_source", "_class", _before("_rows", ["_source"], ["_class"]).alias("_classes_before"))
    blocks = blocks.select(
        "_source", "_class", "_slot", _before("_rows", ["_source", "_class"], ["_slot"]).alias("_slots_before")
    )
    blocks = blocks.join(classes, ["_source", "_class"]).join(aims, "_source")
    block = ["_source", "_class", "_slot"]
    order = ["size", "_digest", "doc_id", "text_hash", *row_hash]
    rows = merged.withColumn("_before", _before("_copies", block, order)).join(blocks, block)
    rank = F.col("_classes_before") + F.col("_slots_before") + F.col("_before")
    plan = rows.select(
        "doc_id", "source", "text_hash", *row_hash, "size", "source_size", "target", "_copies", "_expected", "_offset",
        rank.alias("_rank"),
    )
    return plan, merged


def _times(first: Column, rows: Column) -> Column:
    """How often rows from a rank on are taken: whole numbers crossed by their span."""
    expected, offset, shift = F.col("_expected"), F.col("_offset"), UNIT.bit_length() - 1
    start, stop = first * expected + offset, (first + rows) * expected + offset
    return (F.shiftright(stop, shift) - F.shiftright(start, shift)).cast("bigint")


def mixed(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    `size` counts words; a null text has none. A null source is a source of its own. Repeated rows
    are separate documents. A text without words takes nothing. Sources without words have
    target 0. An empty table gives an empty one. The draw depends on keys, texts, sizes and seed
    only, so reruns agree. Other columns of df do not matter.
    """
    plan, _ = _ranked(df, key, text, source, seed, weights, share, most)
    rows = numbered_copies(plan, "_copies", "_copy")
    copies = _times(F.col("_rank") + F.col("_copy"), F.lit(1))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES,
) -> DataFrame:
    """The rows of df as often as the mix takes them; all columns are kept. Defined as `mixed`.

    Rows that agree in all columns are merged inside each task before texts are shuffled, and the span of
    all of them tells how often their one text is written. Large numbers are written by several tasks.
    """
    row = F.xxhash64(*df.columns)
    plan, documents = _ranked(df, key, text, source, seed, weights, share, most, row)
    hot = not documents.where(F.col("_copies") * most > COPIES_PER_STEP).isEmpty()
    # Keys that are never null, so that texts merged on them can be joined where they lie.
    same = ["__mix_id", "__mix_source", "__mix_text", "__mix_row"]

    def keys(of: str, origin: str) -> list[Column]:
        return [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(n) for c, n in zip((of, origin), same)]

    own = df.select(*keys(key, source), F.xxhash64(text).alias(same[2]), row.alias(same[3]), F.struct(*df.columns).alias("__mix_kept"))
    merged = own.groupBy(*same).agg(F.first("__mix_kept").alias("__mix_kept"))
    taken = _times(F.col("_rank"), F.col("_copies")).alias("__mix_times")
    plan = plan.select(*keys("doc_id", "source"), F.col("text_hash").alias(same[2]), F.col("row_hash").alias(same[3]), taken)
    rows = merged.join(plan.where("__mix_times > 0"), same).select("__mix_kept", "__mix_times")
    return repeat_rows(rows, "__mix_times", hot=hot).select("__mix_kept.*")
