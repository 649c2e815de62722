"""Near copies of the pipeline against five-word Jaccard similarity of all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
from flowlab.llm import near_copies, simhash
from flowlab.sources.staging import stage
from tests.conftest import SMALL


def shingled(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows: list[tuple[int, str | None]]) -> set[int]:
    """The smallest key of each group, from all pairs."""
    sets, root = {k: shingled(t) for k, t in rows}, {k: k for k, _ in rows}

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and (sets[i] == sets[j] or 5 * both >= 4 * len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(k) for k in root}


def test_stage_takes_one_of_each_group_at_five_words(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for family in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice((60, 120, 240)))]
        rows.append(" ".join(base))
        for changes in (1, 2, 3, 4, 6, 9, 14):
            w = list(base)
            for at in r.sample(range(len(w)), changes):
                w[at] = r.choice(vocabulary)
            rows.append(" ".join(w))
    # A chain: each step is near the next, its ends are far apart.
    chain = [r.choice(vocabulary) for _ in range(100)]
    for _ in range(12):
        chain = [*chain[6:], *(r.choice(vocabulary) for _ in range(6))]
        rows.append(" ".join(chain))
    rows += [None, "", " ", "one two", "One  two", "one two three", "a b c d e"]
    keyed = list(enumerate(rows))
    docs = spark.createDataFrame(keyed, "doc_id bigint, text string")
    wanted = groups(keyed)
    got = corpus_pipeline.near_dedup(spark, docs, SMALL)
    assert got.columns == docs.columns and sorted(x.doc_id for x in got.collect()) == sorted(wanted)
    # Three bits at three words leave most of these copies.
    assert simhash.representatives(docs).count() > len(wanted)
    empty = near_copies.representatives(docs.limit(0))
    assert empty.columns == docs.columns and empty.count() == 0


def test_repeated_rows_and_null_keys_are_one_row(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (4, text), (4, text), (9, text.upper()), (None, "other words of another text here")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = near_copies.representatives(docs).collect()
    assert sorted((x.doc_id is None, x.text) for x in out) == [(False, text), (True, "other words of another text here")]


def test_small_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    keyed = [(x.doc_id, x.text) for x in docs.collect()]
    assert {x.doc_id for x in near_copies.representatives(docs).collect()} == groups(keyed)


def test_unlike_texts_with_a_common_passage_make_few_pairs(spark, monkeypatch):
    """One passage in 2,000 texts, a family whose members are mostly unlike one another, and both linked by nothing but the passage."""
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [f"{passage} " + " ".join(f"u{i}x{j}" for j in range(40)) for i in range(2000)]
    base = [f"b{i}" for i in range(150)]
    for _ in range(150):
        w = list(base)
        for at in r.sample(range(150), r.choice((2, 5, 7, 9))):
            w[at] = f"e{r.random()}"
        rows.append(" ".join(w))
    keyed = list(enumerate(rows))
    docs = spark.createDataFrame(keyed, "doc_id bigint, text string")
    compared = []
    plain = near_copies._verified

    def counted(pairs, sets):
        compared.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(near_copies, "_verified", counted)
    got = {x.doc_id for x in near_copies.representatives(docs).collect()}
    assert {k for k in got if k < 2000} == set(range(2000))
    assert {k for k in got if k >= 2000} == groups(keyed[2000:])
    assert sum(compared) < 3000


def test_simhash_groups_are_compared(spark, monkeypatch):
    """Units of one fingerprint group are candidates, and links among them count without any shared MinHash key."""
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(1500)]
    near, other = base[:-1] + ["changed"], [f"v{r.randrange(5000)}" for _ in range(1500)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other))]
    assert (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).bit_count() <= simhash.BITS
    units = [(near_copies._unit(near_copies.shingles(t)), simhash.fingerprint(t)) for _, t in rows]
    pairs = near_copies.fingerprint_pairs(spark.createDataFrame(units, "unit string, fp bigint")).collect()
    assert [(p.a, p.b) for p in pairs] == [(max(units[0][0], units[1][0]), min(units[0][0], units[1][0]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(near_copies, "_indexed", lambda sets: stage(spark.createDataFrame([], "token bigint, unit string, m int, p int"), "none"))
    assert {x.doc_id for x in near_copies.representatives(df).collect()} == {1, 3}
