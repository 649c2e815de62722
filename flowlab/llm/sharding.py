"""Shards of near equal bytes through fixed virtual slots.

Every record hashes into one of thousands of slots for good. Bytes are summed per slot, and a
small versioned table says which shard holds which slot; rebalancing edits that table, records
never hash anew. A slot that outweighs its fair share (one record repeated without end) is cut
into parts, which the table places one by one. Only the table of slots, whose length is bounded
by parameters, is seen as a whole.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlab.llm.common import numbered_copies
from flowlab.sources.staging import stage

SLOTS = 4096
# A slot is cut where it passes this share of a shard's fair weight.
PART_SHARE = 1 / 64
MAP_SCHEMA = "version int, virtual_slot int, part bigint, shard int, n_rows bigint, n_bytes bigint, first_slot bigint, part_bytes bigint"


def record_size(text: str | Column) -> Column:
    """UTF-8 bytes of the text plus one; one for null."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def records(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Distinct records (key, size, crc of the text) with their copies, slot and place in it.

    A slot holds evenly hashed distinct records, so the window spreads over thousands of groups.
    """
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    narrow = df.select(
        F.col(key).alias("doc_id"), record_size(F.col(text)).alias("size"), crc.alias("text_crc32"),
        F.xxhash64(F.col(text)).alias("_text"),
    )
    merged = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("_copies"))
    slot = F.pmod(F.xxhash64("doc_id", "_text", "size"), F.lit(slots)).cast("int")
    merged = merged.withColumn("virtual_slot", slot)
    order = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "_text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return merged.select(
        "*",
        F.coalesce(F.sum("_copies").over(before), F.lit(0)).alias("_before"),
        F.coalesce(F.sum(F.col("_copies") * F.col("size")).over(before), F.lit(0)).alias("_bytes_before"),
    )


def part_bytes(total: int, shards: int) -> int:
    return max(1, int(total * PART_SHARE / max(1, shards)))


def weighed(rows: DataFrame) -> DataFrame:
    """Rows and bytes of each part of a slot. A part is what starts within one span of `part_bytes`
    of its slot, so there are at most slots + 64 * shards of them that are not empty."""
    return rows.groupBy("virtual_slot", "part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes")
    )


def place(parts: list[tuple[int, int, int, int]], shards: int) -> list[int]:
    """A shard for each (slot, part, rows, bytes): the heaviest first, each to the shard that is
    lightest so far."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(parts)
    for i in sorted(range(len(parts)), key=lambda i: (-parts[i][3], parts[i][0], parts[i][1])):
        weight, shard = heapq.heappop(heap)
        out[i] = shard
        heapq.heappush(heap, (weight + parts[i][3], shard))
    return out


def grow(parts: list[tuple[int, int, int, int]], held: list[int], shards: int) -> list[int]:
    """The map edited for more shards: parts leave the heaviest shards, only for new ones."""
    old = max(held, default=-1) + 1
    out, loads = list(held), [0] * max(shards, old)
    for p, s in zip(parts, held):
        loads[s] += p[3]
    fair = sum(loads) / max(1, shards)
    order = sorted(range(len(parts)), key=lambda i: (-parts[i][3], parts[i][0], parts[i][1]))
    for i in order:
        new = min(range(old, shards), key=lambda s: loads[s], default=None)
        size = parts[i][3]
        if new is not None and loads[out[i]] - size >= fair * 0.999 and loads[new] + size <= fair * 1.001:
            loads[out[i]] -= size
            loads[new] += size
            out[i] = new
    return out


def map_table(
    spark: SparkSession, parts: list[tuple[int, int, int, int]], shards: list[int], version: int, span: int
) -> DataFrame:
    """One row per part, with the number of records before it in its shard and the bytes a part may span."""
    first: dict[int, int] = {}
    rows = []
    for (slot, part, n_rows, n_bytes), shard in zip(parts, shards):
        rows.append((version, slot, part, shard, n_rows, n_bytes, first.get(shard, 0), span))
        first[shard] = first.get(shard, 0) + n_rows
    return spark.createDataFrame(rows, MAP_SCHEMA)


def newest(spark: SparkSession, map_path: str) -> list:
    """The rows of the newest stored version, none if nothing is stored there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(map_path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    stored = spark.read.schema(MAP_SCHEMA).parquet(map_path)
    return sorted(stored.where(F.col("version") == stored.agg(F.max("version")).first()[0]).collect(), key=lambda r: (r.virtual_slot, r.part))


def place_new(parts: list[tuple[int, int, int, int]], held: dict[tuple[int, int], int], shards: int) -> list[int]:
    """Parts that the map holds stay where they are; others go to the lightest shard, the heaviest first."""
    loads = [0] * max([shards, *(s + 1 for s in held.values())])
    out = [held.get(p[:2], -1) for p in parts]
    for p, s in zip(parts, out):
        loads[s] += p[3] if s >= 0 else 0
    heap = [(w, s) for s, w in enumerate(loads)]
    heapq.heapify(heap)
    for i in sorted((i for i, s in enumerate(out) if s < 0), key=lambda i: (-parts[i][3], parts[i][:2])):
        weight, out[i] = heapq.heappop(heap)
        heapq.heappush(heap, (weight + parts[i][3], out[i]))
    return out


def assign(
    df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, slots: int = SLOTS,
    map_path: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot.

    `law` is `bytes`. `slot` numbers the records of a shard from 0 without gaps. `grown_shard` is
    null: it belongs to another law. Without a map at `map_path`, the map is written there (to a staged
    table if unset) as version 1. With one, its newest version places the records: parts that it
    holds stay in their shards, also after `rebalance`, new ones go where least is, and the counts
    are stored as the next version. Null keys and texts are records like others; repeated rows get slots of their own;
    an empty table gives an empty one. Columns of df other than key and text do not matter.
    """
    spark = df.sparkSession
    rows = numbered_copies(records(df, key, text, slots), "_copies", "_copy")
    rows = rows.withColumns({
        "_row": F.col("_before") + F.col("_copy"),
        "_at": F.col("_bytes_before") + F.col("_copy") * F.col("size"),
    }).select("doc_id", "size", "text_crc32", "virtual_slot", "_row", "_at")
    rows = stage(rows, "shard-records")
    total = rows.agg(F.sum("size")).first()[0] or 0
    stored = newest(spark, map_path) if map_path else []
    span = stored[0].part_bytes if stored else part_bytes(total, shards)
    rows = rows.withColumn("part", F.expr(f"_at div {span}"))
    # Bounded by the number of slots and parts, whatever the number of records.
    parts = sorted(tuple(r) for r in weighed(rows).collect())
    if stored:
        placed = place_new(parts, {(r.virtual_slot, r.part): r.shard for r in stored}, shards)
    else:
        placed = place(parts, shards)
    table = stage(map_table(spark, parts, placed, stored[0].version + 1 if stored else 1, span), "shard-map")
    if map_path:
        table.write.mode("append").parquet(map_path)
    # A part's first row in its slot: parts of a slot follow each other.
    ahead = W.partitionBy("virtual_slot").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    table = table.withColumn("_start", F.coalesce(F.sum("n_rows").over(ahead), F.lit(0)))
    # A few MB at most: its length is bounded by the parameters.
    placed = rows.join(F.broadcast(table), ["virtual_slot", "part"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first_slot") + F.col("_row") - F.col("_start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "part",
    )


def rebalance(spark: SparkSession, map_path: str, shards: int) -> DataFrame:
    """Edits the stored map for `shards` shards and adds it as the next version: parts move only
    from old shards to new ones. No record is read or hashed again."""
    stored = newest(spark, map_path)
    parts = [(r.virtual_slot, r.part, r.n_rows, r.n_bytes) for r in stored]
    shards_now = grow(parts, [r.shard for r in stored], shards)
    edited = map_table(spark, parts, shards_now, stored[0].version + 1, stored[0].part_bytes)
    edited.write.mode("append").parquet(map_path)
    return edited
