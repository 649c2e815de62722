"""Benchmark decontamination by q-gram filtering and banded alignment.

A passage of m characters that stands in a document with at most k edits leaves m - q + 1 - k * q
of its q-grams in place, all on diagonals (place in the document less place in the passage) that
lie within 2 * k + 1 of each other. So q-grams shared with a passage are counted in overlapping
bands of diagonals, bands below the bound are dropped, and the rest are verified by an alignment
confined to the band. The bound is exact: no passage within the edit budget is missed.

The benchmark is the stated query set: it is indexed in blocks of bounded size, each of which is
sent to the tasks and meets every document once. Documents are never shuffled; long ones are cut
into overlapping stretches inside the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowlab.llm.common import bounded_batches
from flowlab.sources.staging import stage

Q = 8
# Passages under SHORT characters are found by shorter q-grams.
SHORT, SHORT_Q = 40, 4
EDITS = 0.1
REPEATS = 4
# Longer passages are cut into pieces of this many characters, each a passage of its own.
PIECE = 2000
BLOCK_CHARS = 2_000_000
STRETCH = 1_000_000
ALIGNED = 256
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22


def normalised(text: str | None) -> np.ndarray:
    """Code points, lower-cased, runs of white space as one blank, none at the ends."""
    plain = " ".join((text or "").lower().split())
    return np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)


def q_grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on."""
    n = len(codes) - q + 1
    h = np.zeros(max(0, n), np.uint64)
    for j in range(q):
        h *= FACTOR
        h += codes[j : n + j] if n > 0 else codes[:0]
    return h


def budget(m: int) -> int:
    """Edits allowed for m characters: a tenth."""
    return int(EDITS * m)


class Passages:
    """The passages of one block of at least `low` and fewer than `high` characters, and where each q-gram stands
    in them.

    A q-gram that stands at more than REPEATS places of its passage says little about where a
    text would be aligned, and all its places in a text times all in the passage are many. Such
    places count as found, which only weakens the filter. Where that leaves nothing to find, the
    passage repeats itself: its bands are those with enough q-grams of the passage at any place.
    """

    def __init__(self, items: list[tuple[int, str]], q: int = Q, low: int = Q, high: int | None = None):
        self.q = q
        known: dict[bytes, int] = {}
        for item, text in sorted(items, key=lambda i: (i[0] is None, i[0])):
            codes = normalised(text)
            for at in range(0, len(codes), PIECE):
                # The last piece is as long as the others: a short rest would mark clean texts.
                start = min(at, max(0, len(codes) - PIECE))
                piece = codes[start : start + PIECE]
                if low <= len(piece) and (high is None or len(piece) < high):
                    known.setdefault(piece.tobytes(), item)
        self.codes = [np.frombuffer(b, np.uint32) for b in known]
        self.item = list(known.values())
        self.m = np.array([len(c) for c in self.codes], np.int64)
        self.k = np.array([budget(int(m)) for m in self.m], np.int64)
        self.need = self.m - q + 1 - self.k * q
        self.step = 2 * self.k + 1
        grams = [q_grams(c, q) for c in self.codes]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.int64) if grams else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams]).astype(np.int64) if grams else np.zeros(0, np.int64)
        order = np.lexsort((place, owner, every))
        every, owner, place = every[order], owner[order], place[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])
        run = np.cumsum(new) - 1
        repeated = np.bincount(run, minlength=1)[run] > REPEATS if len(run) else new
        self.enough = self.need - np.bincount(owner[repeated], minlength=len(self.m))
        loose = self.enough <= 0
        self.placed = Grams(every, np.flatnonzero(~repeated & ~loose[owner]), owner, place)
        self.loose = Grams(every, np.flatnonzero(new & loose[owner]), owner, place)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        for grams in (self.placed, self.loose):
            self.seen[self._slot(grams.gram)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def longest(self) -> int:
        return int((self.m + self.k).max(initial=0))

    def bands(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, passage, first diagonal), in this order, of the bands that hold enough q-grams. `starts` are the
        places in codes where the texts start."""
        grams = q_grams(codes, self.q)
        at = np.flatnonzero(self.seen[self._slot(grams)])
        parts = [self._placed_bands(grams, at, starts), self._loose_bands(grams, at, starts)]
        text, who, diagonal = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((diagonal, who, text))
        return text[order], who[order], diagonal[order]

    def _placed_bands(self, grams: np.ndarray, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, entry = self.placed.shared(grams, at)
        who, place = self.placed.owner[entry], self.placed.place[entry]
        text = np.searchsorted(starts, at, side="right") - 1
        reach = int(self.m.max(initial=0))
        band = (at - starts[text] - place + reach) // self.step[who]
        key = (text * len(self.m) + who) << 32
        # Band b covers steps b and b + 1, so any diagonals of one alignment share a band.
        keys = np.concatenate((key | band, key | np.maximum(band - 1, 0)))
        value, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        enough = self.enough[(value >> 32) % max(1, len(self.m))]
        good = count >= enough
        kept = good[back]
        # A q-gram of the passage counts once in a band; both are numbers below 2^32.
        pairs = np.unique((back[kept].astype(np.int64) << 32) | np.concatenate((place, place))[kept])
        distinct = np.bincount(pairs >> 32, minlength=len(value))
        value = value[good & (distinct >= enough)]
        who = (value >> 32) % max(1, len(self.m))
        diagonal = (value & 0xFFFFFFFF) * self.step[who] - reach
        return (value >> 32) // max(1, len(self.m)), who, diagonal

    def _loose_bands(self, grams: np.ndarray, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, entry = self.loose.shared(grams, at)
        who, text = self.loose.owner[entry], np.searchsorted(starts, at, side="right") - 1
        order = np.lexsort((at, who, text))
        at, who, text = (at - starts[text])[order], who[order], text[order]
        edge = np.flatnonzero((np.diff(who) != 0) | (np.diff(text) != 0)) + 1
        out = [(np.zeros(0, np.int64),) * 3]
        for a, z in zip([0, *edge], [*edge, len(at)]):
            if a == z:
                continue
            w, places = int(who[a]), at[a:z]
            step, m = int(self.step[w]), int(self.m[w])
            diagonal = np.arange((places[0] - m) // step - 1, places[-1] // step + 1) * step
            inside = np.searchsorted(places, diagonal + 2 * step + m) - np.searchsorted(places, diagonal)
            diagonal = diagonal[inside >= self.need[w]]
            out.append((np.full(len(diagonal), text[a]), np.full(len(diagonal), w), diagonal))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))

    def aligned(self, texts: list[np.ndarray], who: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end) of the best alignment of each passage in its text on the diagonals of its
        band and k beyond on both sides; all pairs of a call advance together, row by row."""
        m, k = self.m[who], self.k[who]
        first = diagonal - k
        width = int((2 * self.step[who] + 2 * k).max())
        rows = int(m.max())
        passage = np.zeros((len(who), rows), np.uint32)
        window = np.zeros((len(who), rows + width), np.uint32)
        for i, (t, w) in enumerate(zip(texts, who)):
            passage[i, : m[i]] = self.codes[w]
            low, high = max(0, first[i]), min(len(t), first[i] + rows + width)
            if low < high:
                window[i, low - first[i] : high - first[i]] = t[low:high]
        slope = np.arange(width, dtype=np.int32)
        d = np.zeros((len(who), width), np.int32)
        best, end = np.full(len(who), 1 << 20), np.zeros(len(who), np.int64)
        over = np.full((len(who), 1), 1 << 20, np.int32)
        for row in range(rows):
            change = d + (window[:, row : row + width] != passage[:, row, None])
            missing = np.concatenate((d[:, 1:], over), axis=1) + 1
            d = np.minimum(change, missing)
            d = np.minimum.accumulate(d - slope, axis=1) + slope
            done = np.flatnonzero(m == row + 1)
            if len(done):
                c = d[done].argmin(axis=1)
                best[done], end[done] = d[done, c], first[done] + c + row + 1
        return best, end

    def found(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(text, passage, edits, end) for each pair within its budget, the best of each."""
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        codes = np.zeros(sum(len(t) + 1 for t in texts), np.uint64)
        for t, at in zip(texts, starts):
            codes[at : at + len(t)] = t
        text, who, diagonal = self.bands(codes, starts)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        rest = np.arange(len(text))
        while len(rest):
            part, rest = rest[:ALIGNED], rest[ALIGNED:]
            edits, end = self.aligned([texts[t] for t in text[part]], who[part], diagonal[part])
            exact = set()
            for t, w, e, at in zip(text[part].tolist(), who[part].tolist(), edits.tolist(), end.tolist()):
                if e <= self.k[w]:
                    best[t, w] = min(best.get((t, w), (e, at)), (e, at))
                if e == 0:
                    exact.add((t, w))
            # Bands come in order of their diagonal: after an exact place none is better.
            if exact:
                rest = rest[[(t, w) not in exact for t, w in zip(text[rest].tolist(), who[rest].tolist())]]
        return [(t, w, e, at) for (t, w), (e, at) in sorted(best.items())]


class Grams:
    """Some entries of a list of q-grams sorted by gram: each gram, and the entries it has."""

    def __init__(self, every: np.ndarray, chosen: np.ndarray, owner: np.ndarray, place: np.ndarray):
        self.owner, self.place = owner[chosen], place[chosen]
        self.gram, self.first, self.often = np.unique(every[chosen], return_index=True, return_counts=True)

    def shared(self, grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, entry) of those places whose gram has entries."""
        if not len(self.gram):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.searchsorted(self.gram, grams[at])
        which[which == len(self.gram)] = 0
        same = self.gram[which] == grams[at]
        at, which = at[same], which[same]
        often = self.often[which]
        entry = np.repeat(self.first[which] - np.cumsum(often) + often, often) + np.arange(often.sum())
        return np.repeat(at, often), entry


def _stretches(texts: list[str | None], overlap: int) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """Lots of (text number, place, codes) of about STRETCH characters; long texts are cut with an
    overlap that holds any passage whole."""
    number, place, codes, size = [], [], [], 0
    for i, text in enumerate(texts):
        whole = normalised(text)
        for at in range(0, max(1, len(whole)), STRETCH):
            number.append(i)
            place.append(at)
            codes.append(whole[at : at + STRETCH + overlap])
            size += len(codes[-1])
            if size >= STRETCH:
                yield number, place, codes
                number, place, codes, size = [], [], [], 0
    if number:
        yield number, place, codes


Hits = dict[tuple[int, int], tuple[int, int]]


def hits(texts: list[str | None], passages: Passages) -> Hits:
    """(text, passage) to (edits, end)."""
    best: Hits = {}
    if passages.codes:
        for number, place, codes in _stretches(texts, passages.longest() + 1):
            for t, w, e, end in passages.found(codes):
                at = number[t], w
                best[at] = min(best.get(at, (e, end + place[t])), (e, end + place[t]))
    return best


def both_lengths(items: list[tuple[int, str]]) -> list[Passages]:
    """Short passages by short q-grams, as a tenth of their characters would leave no q-gram of eight."""
    return [p for p in (Passages(items, SHORT_Q, Q, SHORT), Passages(items, Q, SHORT)) if p.codes]


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[tuple[bool, list[Passages]]]:
    """The benchmark in blocks of about BLOCK_CHARS characters, dealt by a hash of the text: equal texts
    come together and count as the one of the smallest id. Says whether a block is the last."""
    items = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text is not null")
    items = items.groupBy("text").agg(F.min("item").alias("item"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for block in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == block)
        yield block == n - 1, both_lengths([(r["item"], r["text"]) for r in part.collect()])


def found(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, edits, item_chars, end) for each document and passage within its budget.

    A passage of m characters may differ by a tenth of them, lower-cased and with white space
    folded. `end` is the place in the folded text after the passage. Documents without a
    passage have no row; null and empty texts hold none; repeated rows give repeated results; a
    null key is carried along. Null benchmark texts and those under eight characters mark nothing.
    Empty tables on either side give an empty table.
    """
    bounded_batches(df.sparkSession)
    narrow = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kinds = narrow.schema["doc_id"].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, item_chars int, end bigint"
    item_kind = to_arrow_type(benchmark.schema[item].dataType)
    out = df.sparkSession.createDataFrame([], schema)
    for last, passages in blocks(benchmark, item, item_text):
        sent = df.sparkSession.sparkContext.broadcast(passages)
        rows = narrow.mapInArrow(lambda b, sent=sent: _rows(b, sent.value, item_kind), schema)
        if not last:
            # One block at a time is held by driver and executors.
            rows = stage(rows, "found")
            sent.destroy()
        out = out.unionByName(rows)
    return out


def _rows(batches: Iterator[pa.RecordBatch], lengths: list[Passages], item_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        for passages in lengths:
            best = hits(texts, passages)
            text, who = pa.array([t for t, _ in best], pa.int64()), pa.array([w for _, w in best], pa.int64())
            chars = passages.m[who.to_numpy(zero_copy_only=False)]
            columns = [
                b.column("doc_id").take(text), pa.array(passages.item, item_kind).take(who), pa.array([e for e, _ in best.values()], pa.int32()),
                pa.array(chars, pa.int32()), pa.array([e for _, e in best.values()], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "edits", "item_chars", "end"])


def cleaned(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """df without the rows that hold a passage, in one pass per block and without a shuffle; all
    columns are kept. Null and empty texts stay."""
    bounded_batches(df.sparkSession)
    at, out = df.columns.index(text), df
    for last, passages in blocks(benchmark, item, item_text):
        sent = df.sparkSession.sparkContext.broadcast(passages)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(at).to_pylist()
                held = {t for passages in sent.value for t, _ in hits(texts, passages)}
                yield b.filter(pa.array([i not in held for i in range(b.num_rows)], pa.bool_()))

        out = out.mapInArrow(clean, df.schema)
        if not last:
            out = stage(out, "cleaned")
            sent.destroy()
    return out
