"""The pipeline and the registered queries on the small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from flowlab.llm import decontaminate, quality
from flowlab.llm.queries import REGISTRY
from tests.compare import difference, spark_table, sql_table
from tests.conftest import SMALL
from tests.llm.test_decontaminate import wanted
from tests.llm.test_near_copies import groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_apply_their_operators(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "qgram_decontamination", "systematic_mixing", "token_ids"]
    kept = corpus_pipeline.quality_rules(spark, docs, SMALL)
    good = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == docs.columns
    single = corpus_pipeline.near_dedup(spark, kept, SMALL)
    assert {r.doc_id for r in single.collect()} == groups([(r.doc_id, r.text) for r in kept.collect()])
    clean = corpus_pipeline.decontamination(spark, single, SMALL)
    held = {r.doc_id for r in decontaminate.found(single, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - held
    mixed = corpus_pipeline.source_mixing(spark, clean, SMALL)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.token_ids(spark, mixed, SMALL)
    assert out.count() == mixed.count()


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY if n != "pipeline") == list(range(1, 14))


def test_queries_equal_sql(spark, duck):
    from flowlab.llm.oracles import SQL

    for name, sql in SQL.items():
        assert difference(spark_table(REGISTRY[name](spark, SMALL)), sql_table(duck, sql)) == ""


def good(text: str | None) -> bool:
    """The quality rules, written out."""
    text = text or ""
    w = WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:]))
    seen = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    if len(w) < 50 or 100 * len(repeated) > 50 * len(w):
        return False
    lines = [x for x in text.split("\n") if WORD.search(x)]
    copies, bullets, ellipses = (
        len(lines) - len(set(lines)),
        sum(bool(re.search(r"^\s*[-*•‣]\s", x)) for x in lines),
        sum(bool(re.search(r"(\.\.\.|…)\s*$", x)) for x in lines),
    )
    return (
        3 <= sum(map(len, w)) / len(w) <= 10 and len(re.findall(r"[#*$%&|<>]", text)) / len(w) <= 0.1
        and len(set(w) & set(quality.STOP_WORDS)) >= 2 and copies / len(lines) <= 0.5 and bullets / len(lines) <= 0.9
        and ellipses / len(lines) <= 0.3
    )


def mixture(docs: list[tuple]) -> list[tuple]:
    """(doc_id, text) as often as systematic sampling takes each document."""
    draw = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)
    size = {i: len(WORD.findall(t)) for i, t, _ in docs}
    total = defaultdict(int)
    for i, _, s in docs:
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, free, target = 1.5 * sum(total.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * total[s]}
        target.update({s: 2.0 * total[s] if over else weight[s] * level for s in over or free})
        left -= sum(target[s] for s in over)
        free -= over or free
    out = []
    for s in order:
        expected = min(round(target[s] / total[s] * 2**24), 2 * 2**24)
        at = draw("mix", "offset", "" if s is None else f"={s}") % 2**24
        rows = [(len(str(size[i])), str(size[i]).ljust(2, "0")[:2], draw("mix", i) % 256, size[i], draw("mix", i), i, t) for i, t, o in docs if o == s]
        for *_, i, t in sorted(rows):
            out += [(i, t)] * ((at + expected) // 2**24 - at // 2**24)
            at += expected
    return out


def test_run_equals_plain_python(spark, tmp_path):
    r = random.Random(9)
    common, rare = quality.STOP_WORDS[:12], ["".join(r.choice("abcdefghikmnoprstu") for _ in range(r.randint(3, 8))) for _ in range(400)]
    prose = lambda n: [r.choice(common if r.random() < 0.3 else rare) for _ in range(n)]
    items = [" ".join(prose(n)) for n in (8, 12, 12, 15)] + ["short", None]
    texts = [prose(r.randint(50, 110)) for _ in range(36)]
    texts += [prose(r.randint(20, 49)) for _ in range(4)]
    # Exact copies, near copies, and passages with and without an edit.
    texts += [list(texts[k]) for k in (0, 0, 1)]
    for k in (2, 3, 4, 4):
        texts.append(list(texts[k]))
        texts[-1][r.randrange(50)] = "changed"
    for k, item in enumerate(items[:4]):
        quoted = item.replace(item.split()[1], "x" + item.split()[1][1:], 1) if k % 2 else item
        texts.append([*prose(45), *quoted.split(), *prose(20)])
    lines = [" ".join(w) for w in texts]
    lines += ["\n".join(f"- {' '.join(prose(6))}" for _ in range(12)), "\n".join(f"{' '.join(prose(6))} ..." for _ in range(12))]
    lines += [" ".join(f"{w} #" for w in prose(60)), " ".join(rare[:70]), " ".join(prose(10) * 8), "", None]
    sources = ["web", "web", "web", "books", "news", None]
    rows = [(3 * i + 1, t, "en", r.choice(sources), len(t or "")) for i, t in enumerate(lines)]
    r.shuffle(rows)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(i, t, s) for i, t, _, s, _ in rows if good(t)]
    least = groups([(i, t) for i, t, _ in kept])
    single = [x for x in kept if x[0] in least]
    held = {t for t, _ in wanted([t for _, t, _ in single], [x or "" for x in items])}
    clean = [x for k, x in enumerate(single) if k not in held]
    mixed = sorted(mixture(clean))
    # Every stage takes something away, and the mix repeats documents.
    assert len(rows) > len(kept) > len(single) > len(clean) > 20 and len(held) == 4 and len(mixed) > len(set(mixed))
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER)), 0, []
    for i, t in mixed:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
