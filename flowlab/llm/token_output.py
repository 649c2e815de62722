"""Token ids as raw binary files with a minimal perfect hash index over document keys.

Layout of an output folder:

- `payload/<n>.ids`   the ids of a key range of documents, in key order, 2 or 4 bytes each, little-endian
- `payload/<n>.at`    where each document of that file starts: n + 1 unsigned 64-bit integers
- `index/<n>.mph`     one bucket of the index: displacements, a 32-bit fingerprint and the place of each key
- `shards`, `buckets` Parquet tables that list the files

A key hashes to its bucket; a displacement of the bucket turns the key's second hash into a slot
of its own, with as many slots as keys; the slot's fingerprint tells foreign keys, and its place
is a shard and a document number. So access by key reads one bucket and two slices.

Files are named by attempt, and the tables list only those of tasks that succeeded, so a lost
executor leaves at most an unlisted file. They are written through the file system that the
folder's scheme names.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from flowlab.llm.common import bounded_batches
from flowlab.sources.staging import new_folder

END_ID = 1
BUCKET_KEYS = 20_000
GROUP = 4
CACHED_WORDS = 600_000
CHUNK_CHARS = 4_000_000
READ_BYTES = 8_000_000
HEAD = "<u8"
PLACE = np.dtype([("shard", "<u4"), ("first", "<u8"), ("count", "<u8")])


def at_path(folder: str, *parts: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and a path in it."""
    if "://" not in folder and not folder.startswith("file:"):
        system, path = fs.LocalFileSystem(), folder
    else:
        system, path = fs.FileSystem.from_uri(folder)
    return system, "/".join([path.rstrip("/"), *parts])


# The rules under which a tokenizer works word by word.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}
# Latin letters that stay one letter in lower case and composed form, unlike the dotted I (U+0130)
# and letters that fall apart into a letter and a mark, which would take the full stop to itself.
_CUT = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([.,])(\s|$)"


class WordEncoder:
    """Encodes texts word by word: a tokenizer of WORD_RULES never joins across the six ASCII spaces,
    nor a plain Latin letter with a full stop or comma that ends a word, and it ignores case. So
    the ids of a text are those of its words, and words met before are looked up. The lookup is
    emptied when it is full, which bounds memory and changes no result. Any other tokenizer gets
    whole texts."""

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_file(file)
        rules = json.loads(self.tokenizer.to_str())
        self.by_word = all(rules[k] == v for k, v in WORD_RULES.items())
        self.model = self.tokenizer.model
        self.bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = array("H" if self.kind == "<u2" else "I"), array("q", [0])

    def _plain(self, word: str) -> str | None:
        """The word as the model sees it, if nothing is left to normalise or split: lower-case
        Latin letters in composed form."""
        if not (word.isalpha() and word.islower() and max(word) < "\u0250"):
            return None
        return word if word.isascii() else self.bytes.pre_tokenize_str(word)[0][0]

    def _learn(self, words: list[str]) -> None:
        seen = list(map(self._plain, words))
        other = [w for w, p in zip(words, seen) if p is None]
        encoded = iter(self.tokenizer.encode_batch_fast(other, add_special_tokens=False))
        for w, p in zip(words, seen):
            self.ids.extend(next(encoded).ids if p is None else [t.id for t in self.model.tokenize(p)])
            self.known[w] = len(self.ends) - 1
            self.ends.append(len(self.ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.by_word:
            coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(c.ids, self.kind) for c in coded]
        if len(self.known) > CACHED_WORDS:
            self._forget()
        plain = pa.array(texts, pa.large_string())
        # Special tokens are told apart by case.
        if not pc.any(pc.match_substring(plain, "<|")).as_py():
            plain = pc.ascii_lower(plain)
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, _CUT, r"\1 \2\3"))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([w for w in distinct if w not in self.known])
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        number = number[coded.indices.to_numpy()]
        flat, ends = np.frombuffer(self.ids, self.kind), np.frombuffer(self.ends, np.int64)
        sizes = ends[number + 1] - ends[number]
        upto = np.cumsum(sizes)
        out = flat[np.repeat(ends[number] - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)]
        del flat, ends  # else the lookup could not grow
        limits = np.concatenate(([0], upto))[np.asarray(split.offsets)]
        return [out[a:b] for a, b in zip(limits[:-1], limits[1:])]


_encoders: dict[str, WordEncoder] = {}


def encoder(file: str) -> WordEncoder:
    """One per Python worker."""
    if file not in _encoders:
        _encoders[file] = WordEncoder(file)
    return _encoders[file]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def key_hashes(key: str | Column) -> list[Column]:
    """Two 64-bit hashes of a key of any type; null is a key of its own."""
    named = F.coalesce(F.concat(F.lit("="), (F.col(key) if isinstance(key, str) else key).cast("string")), F.lit(""))
    return [F.xxhash64(named).alias("h1"), F.xxhash64(F.lit("second"), named).alias("h2")]


def _mix(a: np.ndarray, b: np.ndarray, seed) -> np.ndarray:
    x = a ^ (b + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Displacements that send n distinct keys (pairs of hashes) to slots 0 .. n - 1.

    Keys fall into groups; the largest groups first, each takes the first seed that puts its keys
    on free slots. Groups of one key take a free slot itself, written as -1 - slot.
    """
    n = len(h1)
    groups = max(1, -(-n // GROUP))
    shift = np.zeros(groups, np.int32)
    home = (_mix(h1, h2, 0) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    size = np.bincount(home, minlength=groups)
    first = np.cumsum(size) - size
    free = np.ones(n, bool)
    for g in np.argsort(-size, kind="stable"):
        if size[g] < 2:
            break
        keys = order[first[g] : first[g] + size[g]]
        seed = 1
        while True:
            seeds = np.arange(seed, seed + 64, dtype=np.uint64)[:, None]
            slots = (_mix(h1[keys][None, :], h2[keys][None, :], seeds) % np.uint64(n)).astype(np.int64)
            ranked = np.sort(slots, axis=1)
            good = free[slots].all(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                pick = int(good.argmax())
                shift[g] = seed + pick
                free[slots[pick]] = False
                break
            seed += 64
    single = np.flatnonzero(size == 1)
    shift[single] = -1 - np.flatnonzero(free)[: len(single)]
    return shift


def slots(h1: np.ndarray, h2: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key; any slot for keys that were not indexed."""
    d = shift[(_mix(h1, h2, 0) % np.uint64(len(shift))).astype(np.int64)]
    hashed = (_mix(h1, h2, np.maximum(d, 0).astype(np.uint64)) % np.uint64(n)).astype(np.int64)
    return np.where(d < 0, -1 - d.astype(np.int64), hashed)


def fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (_mix(h2, h1, 7) >> np.uint64(32)).astype("<u4")


def _payload(df: DataFrame, path: str, key: str, text: str, tokenizer: str) -> DataFrame:
    """Writes the payload files; one row per document: shard, file, number, tokens and key hashes."""
    bounded_batches(df.sparkSession)
    # The last column only spreads rows that are equal in key and text.
    rows = df.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(text).alias("hash"),
        F.pmod(F.monotonically_increasing_id(), F.lit(1024)).alias("spread"), *key_hashes(key),
    )
    order = ["doc_id", "hash", "spread"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, enc, counts = f"{uuid.uuid4().hex}", encoder(tokenizer), []
        system, folder = at_path(path, "payload")
        shard, out, number = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if out is None:
                system.create_dir(folder, recursive=True)
                out = system.open_output_stream(f"{folder}/{name}.ids")
            tokens, end = [], np.array([END_ID], enc.kind).tobytes()
            for part in _chunks(b.column("text").to_pylist()):
                for ids in enc.encode(part):
                    out.write(ids.tobytes() + end)
                    tokens.append(len(ids) + 1)
            counts.append(np.array(tokens, np.int64))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h1"), b.column("h2"), pa.array([shard] * n, pa.int32()),
                 pa.array([name] * n), pa.array(range(number, number + n), pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "h1", "h2", "shard", "file", "number", "tokens"],
            )
            number += n
        if out is not None:
            out.close()
            at = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(HEAD)
            with system.open_output_stream(f"{folder}/{name}.at") as places:
                places.write(at.tobytes())

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, h1 bigint, h2 bigint, shard int, file string, number bigint, tokens bigint"
    documents = f"{path}/documents"
    rows.mapInArrow(write, schema).write.parquet(documents)
    return df.sparkSession.read.parquet(documents)


def _bucket_file(keys: pa.Table, path: str) -> pa.Table:
    """Writes one bucket of the index."""
    h1 = keys.column("h1").to_numpy().view(np.uint64)
    h2 = keys.column("h2").to_numpy().view(np.uint64)
    pairs = np.stack((h1, h2), axis=1)
    distinct, back = np.unique(pairs, axis=0, return_inverse=True)
    back = back.ravel()
    n = len(distinct)
    shift = perfect_hash(distinct[:, 0], distinct[:, 1])
    slot = slots(distinct[:, 0], distinct[:, 1], shift, n)
    marks = np.zeros(n, "<u4")
    marks[slot] = fingerprint(distinct[:, 0], distinct[:, 1])
    # A key that runs over several shards has a place in each.
    order = np.lexsort((keys.column("shard").to_numpy(), slot[back]))
    places = np.zeros(len(back), PLACE)
    for name in ("shard", "first", "count"):
        places[name] = keys.column(name).to_numpy()[order]
    starts = np.concatenate(([0], np.cumsum(np.bincount(slot[back], minlength=n)))).astype(HEAD)
    head = np.array([n, len(shift), len(back)], HEAD)
    system, folder = at_path(path, "index")
    system.create_dir(folder, recursive=True)
    name = uuid.uuid4().hex
    with system.open_output_stream(f"{folder}/{name}.mph") as out:
        for part in (head, shift.astype("<i4"), marks, starts, places):
            out.write(part.tobytes())
    return pa.table({"bucket": keys.column("bucket").slice(0, 1), "index": pa.array([name])})


def _read_bucket(path: str, name: str):
    system, folder = at_path(path, "index")
    with system.open_input_stream(f"{folder}/{name}.mph") as f:
        raw = f.read()
    n, groups, m = np.frombuffer(raw, HEAD, 3).tolist()
    at, parts = 24, []
    for kind, count in (("<i4", groups), ("<u4", n), (HEAD, n + 1), (PLACE, m)):
        parts.append(np.frombuffer(raw, kind, count, at))
        at += parts[-1].nbytes
    return n, *parts


def write_corpus(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every text whole, appends the end id, and writes payload and index to a new folder.

    Documents stand in ascending key order (null first); equal keys by the hash of their text.
    Null and empty texts are the end id alone. An empty table gives an index without buckets.
    Other columns of df do not matter.
    """
    spark = df.sparkSession
    documents = _payload(df, path, key, text, tokenizer)
    # One row per file of the payload.
    shards = documents.groupBy("shard", "file").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    before = W.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(f"{path}/shards")
    keys = documents.groupBy("h1", "h2", "shard").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("count"))
    total = spark.read.parquet(f"{path}/shards").agg(F.sum("documents")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_KEYS))
    keys = keys.withColumn("bucket", F.pmod("h1", F.lit(buckets)))
    built = keys.groupBy("bucket").applyInArrow(lambda t: _bucket_file(t, path), "bucket bigint, index string")
    built.write.parquet(f"{path}/buckets")
    layout = json.dumps({"tokenizer": tokenizer, "buckets": buckets, "end_id": END_ID})
    spark.createDataFrame([(layout,)], "value string").coalesce(1).write.text(f"{path}/layout")


def _layout(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/layout").first()[0])


def keys_of(spark: SparkSession, path: str) -> DataFrame:
    """The distinct keys of a corpus."""
    return spark.read.parquet(f"{path}/documents").select("doc_id").distinct()


def located(keys: DataFrame, path: str) -> DataFrame:
    """(key, shard, first, count) of each key that the index holds: the run of documents with that
    key in a shard. `keys` has one column; each distinct key is looked up once. Each bucket is
    read by one task and only if a key falls into it."""
    spark, name = keys.sparkSession, keys.columns[0]
    wanted = keys.distinct().select(F.col(name).alias("doc_id"), *key_hashes(name))
    wanted = wanted.withColumn("bucket", F.pmod("h1", F.lit(_layout(spark, path)["buckets"])))
    wanted = wanted.join(spark.read.parquet(f"{path}/buckets"), "bucket")

    def look(t: pa.Table) -> pa.Table:
        n, shift, marks, starts, places = _read_bucket(path, t.column("index")[0].as_py())
        h1 = t.column("h1").to_numpy().view(np.uint64)
        h2 = t.column("h2").to_numpy().view(np.uint64)
        slot = slots(h1, h2, shift, n)
        known = np.flatnonzero(marks[slot] == fingerprint(h1, h2))
        size = (starts[slot[known] + 1] - starts[slot[known]]).astype(np.int64)
        ends = np.cumsum(size)
        spot = np.repeat(starts[slot[known]].astype(np.int64) - ends + size, size) + np.arange(size.sum())
        found = places[spot]
        return pa.table({
            "doc_id": t.column("doc_id").take(pa.array(np.repeat(known, size))),
            "shard": pa.array(found["shard"].astype(np.int32)), "first": pa.array(found["first"].astype(np.int64)),
            "count": pa.array(found["count"].astype(np.int64)),
        })

    kind = wanted.schema["doc_id"].dataType.simpleString()
    return wanted.groupBy("bucket").applyInArrow(look, f"doc_id {kind}, shard int, first bigint, count bigint")


def fetched(keys: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """Every document of the given keys, read from the files: doc_id, start (ids of all documents
    before it), n_tokens, and `ids` (raw bytes as stored) or, with `digest`, `ids_crc32` of the ids
    as unsigned 32-bit integers. Each shard is read by one task, in order, in slices."""
    spark = keys.sparkSession
    files = spark.read.parquet(f"{path}/shards").select("shard", "file", "start")
    places = located(keys, path).join(files, "shard").repartition("shard").sortWithinPartitions("shard", "first")
    kind_of_ids = WordEncoder(_layout(spark, path)["tokenizer"]).kind
    kind = places.schema["doc_id"].dataType.simpleString()
    last = "ids_crc32 bigint" if digest else "ids binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = at_path(path, "payload")
        open_file, at, ids = None, None, None
        for b in batches:
            rows = b.to_pydict()
            key, start, size, content, bytes_out = [], [], [], [], 0
            for i in range(b.num_rows):
                if rows["file"][i] != open_file:
                    open_file = rows["file"][i]
                    with system.open_input_stream(f"{folder}/{open_file}.at") as f:
                        at = np.frombuffer(f.read(), HEAD)
                    ids = Slices(system, f"{folder}/{open_file}.ids", np.dtype(kind_of_ids).itemsize)
                for n in range(rows["first"][i], rows["first"][i] + rows["count"][i]):
                    raw = ids.slice(int(at[n]), int(at[n + 1]))
                    wide = np.frombuffer(raw, kind_of_ids)
                    key.append(i)
                    start.append(rows["start"][i] + int(at[n]))
                    size.append(len(wide))
                    content.append(zlib.crc32(wide.astype("<u4").tobytes()) if digest else raw)
                    bytes_out += 0 if digest else len(raw)
                    if bytes_out > READ_BYTES or len(key) >= 10_000:
                        yield _documents(b, key, start, size, content, digest)
                        key, start, size, content, bytes_out = [], [], [], [], 0
            yield _documents(b, key, start, size, content, digest)

    return places.mapInArrow(read, f"doc_id {kind}, start bigint, n_tokens bigint, {last}")


def _documents(b: pa.RecordBatch, key: list, start: list, size: list, content: list, digest: bool) -> pa.RecordBatch:
    columns = [
        b.column("doc_id").take(pa.array(key, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
        pa.array(content, pa.int64() if digest else pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


class Slices:
    """Slices of a payload file. Reads ahead, so documents in order cost few reads."""

    def __init__(self, system: fs.FileSystem, path: str, width: int):
        self.file, self.width = system.open_input_file(path), width
        self.held, self.start = b"", 0

    def slice(self, a: int, b: int) -> bytes:
        low, high = a * self.width, b * self.width
        if low < self.start or high > self.start + len(self.held):
            self.file.seek(low)
            self.held, self.start = self.file.read(max(READ_BYTES, high - low)), low
        return self.held[low - self.start : high - self.start]


def written_and_read(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes df to a new folder and reads every document back by its key: doc_id, start, n_tokens,
    ids_crc32. Every input row has a row."""
    path = new_folder(df.sparkSession, "token-ids")
    write_corpus(df, path, tokenizer, key, text)
    return fetched(keys_of(df.sparkSession, path), path, digest=True)
