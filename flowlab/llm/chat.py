"""Conversations as prefix trees: turns that conversations share from the start are written once.

A node of a tree is a turn together with all turns before it. Its text is the formatted turn;
tokens are code points of the formatted text. Nodes are laid out depth first, so a subtree is one
stretch of the layout, and two intervals tell the whole attention pattern: a token sees those
nodes whose stretch [start, subtree_end) holds its own place, which are its ancestors, and what
stands before it in its own node. Position ids run along the path: a node's first token has the
length of the path above it.

The layout comes from sums, not from walking trees and not from whole paths: what a subtree holds is
summed from the conversations through its top, and a node starts after its path and the earlier
siblings along it. All sums run over range-partitioned slices, so a first turn that a third of all
conversations share, or a conversation without end, is no single task of them. Hashes along a path
are chained by one task per conversation, which reads its turns in order, as a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.common import bounded_batches
from flowlab.operators.ordering import running_totals
from flowlab.sources.staging import new_folder, stage

# The marks of the template, and control strings of common templates. None of them
# can stand in an escaped text.
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
# A backslash is put before what would let a control string stand, and before each backslash.
_SPLIT = r"\\|(?<=<)(?=\||/?s>)|(?<=\[)(?=/?INST\])"

# Groups of conversations among which a shared node is looked up.
SPREAD = 32


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _SPLIT, r"\\$0")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, content): the formatted turn and the escaped text in it. Null roles
    and texts are empty."""
    role, text = (escaped(F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text"))
    rows = df.select("conv_id", "turn", "role", role.alias("_role"), text.alias("content"))
    head = F.concat(F.lit(OPEN), F.col("_role"), F.lit(BREAK))
    return rows.select(
        "conv_id", "turn", "role", F.concat(head, "content", F.lit(CLOSE)).alias("body"),
        F.length(head).cast("bigint").alias("text_start"), F.length("content").cast("bigint").alias("text_chars"),
    )


def _named() -> Column:
    """The conversation as text; null is a conversation of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def _chained(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, above, chars, last): each turn's node, a hash of the path to it."""
    named = _named().alias("conv")
    keys = [F.xxhash64("body").alias("h1"), F.xxhash64(F.lit("second"), "body").alias("h2")]
    narrow = rows.select(named, "conv_id", "turn", *keys, F.length("body").cast("bigint").alias("chars"))
    order = ["conv", "turn", "h1", "h2"]
    narrow = narrow.repartition("conv").sortWithinPartitions(*order)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, node, depth, above = None, b"", 0, 0
        for b in batches:
            out = {"depth": [], "node": [], "parent": [], "above": []}
            for name, h1, h2, chars in zip(*(b.column(c).to_pylist() for c in ("conv", "h1", "h2", "chars"))):
                if name != conv:
                    conv, node, depth, above = name, b"", 0, 0
                parent, node = node, hashlib.blake2b(b"%b|%d|%d" % (node, h1, h2), digest_size=16).digest()
                for key, value in zip(out, (depth, node, parent, above)):
                    out[key].append(value)
                depth, above = depth + 1, above + chars
            columns = [b.column("conv_id"), b.column("h1"), b.column("h2"), b.column("chars")]
            columns += [pa.array(out["depth"], pa.int64()), pa.array(out["node"], pa.binary())]
            columns += [pa.array(out["parent"], pa.binary()), pa.array(out["above"], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "h1", "h2", "chars", "depth", "node", "parent", "above"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, h1 bigint, h2 bigint, chars bigint, depth bigint, node binary, parent binary, above bigint"
    return stage(narrow.mapInArrow(chain, schema), "chat-turns")


def _spread(steps: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """steps with columns of their nodes. A node that a third of all conversations share is looked up
    once for each of SPREAD groups of conversations, and each group is a task of its own."""
    steps = steps.withColumn("_part", F.pmod(F.xxhash64("conv"), F.lit(SPREAD)))
    near = steps.groupBy("node", "_part").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return steps.join(near.join(nodes.select("node", *columns), "node"), ["node", "_part"]).drop("_part")


def _placed(chained: DataFrame) -> DataFrame:
    """(node, parent, depth, above, h1, h2, chars, start, end, subtree_end): the depth-first layout,
    siblings in order of their hashes.

    A node's text is counted in the first conversation through it, so what a subtree holds is the sum,
    over the conversations through its top, of what they count from there on. A node starts after its
    path and after all earlier siblings of the nodes on its path. Every sum runs over slices.
    """
    named = chained.withColumn("conv", _named())
    # All conversations through a node are merged inside each task first.
    nodes = named.groupBy("node", "parent", "depth", "above", "h1", "h2", "chars").agg(F.min("conv").alias("conv"))
    nodes = stage(nodes, "chat-nodes")
    counts = nodes.select("conv", "node", F.col("chars").alias("own"))
    steps = named.select("conv", "depth", "node").join(counts, ["conv", "node"], "left").fillna(0, ["own"])
    steps = running_totals(steps, ["conv"], ["depth"], ["own"])
    # Copies of other conversations, and starts of them, count nothing.
    steps = stage(steps.where("own_total > 0"), "chat-steps")
    subtrees = steps.groupBy("node").agg(F.sum(F.col("own_total") - F.col("own_before")).alias("subtree"))
    sized = running_totals(nodes.drop("conv").join(subtrees, "node"), ["parent"], ["node"], ["subtree"])
    sized = stage(sized.withColumnRenamed("subtree_before", "shift"), "chat-siblings")
    along = _spread(steps.select("conv", "depth", "node"), sized, ["shift"])
    along = running_totals(along, ["conv"], ["depth"], ["shift"])
    starts = along.groupBy("node").agg(F.min(F.col("shift_before") + F.col("shift")).alias("shifts"))
    start = F.col("above") + F.col("shifts")
    return sized.join(starts, "node").select(
        "node", "parent", "depth", "above", "h1", "h2", "chars", start.alias("start"),
        (start + F.col("chars")).alias("end"), (start + F.col("subtree")).alias("subtree_end"),
    )


def formatted(conversations: DataFrame, path: str) -> None:
    """Writes the trees of (conv_id, turn, role, text) to a new folder.

    `nodes`: node, parent, depth, role, body, loss_start, loss_end (the assistant text within the body, equal
    if none), position (id of the first token), start, end and subtree_end (places in the layout).
    `paths`: conv_id, depth, node.

    Turns of a conversation are taken in order of turn, then of content; a repeated row is a turn
    of its own. A null conv_id is a conversation of its own. Empty input gives empty tables.
    Further columns do not matter.
    """
    bounded_batches(conversations.sparkSession)
    rows = turns(conversations)
    chained = _chained(rows)
    chained.select("conv_id", "depth", "node").write.parquet(f"{path}/paths")
    placed = _placed(chained)
    # The text of each node once: equal turns have equal hashes.
    texts = rows.groupBy(F.xxhash64("body").alias("h1"), F.xxhash64(F.lit("second"), "body").alias("h2")).agg(
        F.first("body").alias("body"), F.first("role").alias("role"), F.first("text_start").alias("text_start"),
        F.first("text_chars").alias("text_chars"),
    )
    masked = F.when(F.col("role") == "assistant", F.col("text_chars")).otherwise(F.lit(0))
    placed.join(texts, ["h1", "h2"]).select(
        "node", "parent", "depth", "role", "body", F.col("text_start").alias("loss_start"),
        (F.col("text_start") + masked).alias("loss_end"), F.col("above").alias("position"), "start", "end", "subtree_end",
    ).write.parquet(f"{path}/nodes")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Per conversation, from the files: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. A conversation is read as a stream in one task."""
    bounded_batches(spark)
    nodes = spark.read.parquet(f"{path}/nodes").select("node", "body", "loss_start", "loss_end")
    steps = spark.read.parquet(f"{path}/paths")
    rows = steps.join(nodes, "node").select(_named().alias("conv"), "conv_id", "depth", "body", "loss_start", "loss_end")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "depth")
    kind = steps.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            done = []
            for conv, *row in zip(*(b.column(c).to_pylist() for c in b.schema.names if c != "depth")):
                if now is None or now.conv != conv:
                    done += [now] if now else []
                    now = Digest(conv, row[0])
                now.add(*row[1:])
            yield _digests(done, b.schema.field("conv_id").type, names)
            kind_of_id = b.schema.field("conv_id").type
        if now:
            yield _digests([now], kind_of_id, names)

    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return rows.mapInArrow(digest, schema)


class Digest:
    """One conversation, turn by turn."""

    def __init__(self, conv: str, conv_id):
        self.conv, self.conv_id = conv, conv_id
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, body: str, loss_start: int, loss_end: int) -> None:
        role, text = body[len(OPEN) : loss_start - len(BREAK)], body[loss_start : -len(CLOSE)]
        self.all.update(f"{unescaped(role)}\n{unescaped(text)}\n".encode("utf-8", "surrogatepass"))
        learned = unescaped(body[loss_start:loss_end])
        self.loss.update(learned.encode("utf-8", "surrogatepass"))
        self.turns, self.chars, self.loss_chars = self.turns + 1, self.chars + len(body), self.loss_chars + len(learned)


def _digests(done: list[Digest], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = [
        pa.array([d.conv_id for d in done], kind), pa.array([d.turns for d in done], pa.int64()),
        pa.array([d.all.hexdigest() for d in done], pa.string()), pa.array([d.loss_chars for d in done], pa.int64()),
        pa.array([d.loss.hexdigest() for d in done], pa.string()), pa.array([d.chars for d in done], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names)


def formatted_and_read(conversations: DataFrame) -> DataFrame:
    """Writes the trees to a new folder and reads every conversation back."""
    path = new_folder(conversations.sparkSession, "chat-trees")
    formatted(conversations, path)
    return read_back(conversations.sparkSession, path)
