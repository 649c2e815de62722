"""Operators on small tables, against plain Python, with the edge cases that docstrings define."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from flowlab.llm import chat, decontaminate, html_extract, mixing, pii, quality, sharding, simhash, token_output, url_filter
from flowlab.operators import ordering
from flowlab.sources.staging import new_folder

WORD = r"[^\x20\x09-\x0D]+"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, source string, _copies int, size string, __row int"


def prose(r: random.Random, n: int) -> str:
    pool = ["the", "of", "and", "Thntha", "oned", "ererea", "ingst", "é.", "over", "to", "inand", "shere", "whble"]
    return " ".join(r.choice(pool) + r.choice(["", "", "", ".\n", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    base = [prose(r, n) for n in (0, 1, 2, 3, 60, 80, 200, 5000, 90, 120)]
    texts = base + [None, "", base[5], base[5], base[6].replace("over", "under", 1), "x\n" * 80, "## %% $$ " * 40]
    out = [(i, t, f"s{i % 3}", 1, "a", 2) for i, t in enumerate(texts)]
    return out + [out[4], out[4], (None, base[4], None, 1, "a", 2), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_quality(docs, empty, rows):
    def measures(t):
        t = t or ""
        w = re.findall(WORD, t)
        windows = list(zip(w, w[1:], w[2:]))
        count = Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))

    got = quality.judged(docs).collect()
    mine = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert mine == sorted(measures(r[1]) for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert not any(r.kept for r in got if r.base_failed) and any("symbols" in r.failed_rules for r in got)
    kept = quality.kept(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.judged(empty).count() == 0 and quality.kept(empty).count() == 0


def test_repeated_windows_by_either_way(spark, monkeypatch):
    r = random.Random(5)
    df = spark.createDataFrame([(i, " ".join(r.choice("ab cd ef".split()) for _ in range(n))) for i, n in enumerate((5, 50, 400))], "doc_id int, text string")
    first = sorted(quality.measured(df).select("doc_id", "n_repeat_words").collect())
    monkeypatch.setattr(quality, "LOOKED_UP", 0)
    assert sorted(quality.measured(df).select("doc_id", "n_repeat_words").collect()) == first


def test_mixing(docs, empty, rows):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and got and mixing.mixed(empty).count() == 0
    size = defaultdict(int)
    for r in rows:
        size[r[2]] += len(re.findall(WORD, r[1] or ""))
    assert {r.source: r.source_size for r in got} == dict(size)
    # Share, cap and reshare until no source is above its cap.
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(size.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * size[s]}
        if not over:
            target.update({s: weight[s] * level for s in free})
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    assert {r.source: r.target for r in got} == pytest.approx(target)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, mixing.mixed(docs.repartition(5)).collect())) == sorted(map(str, got))
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.source] += len(re.findall(WORD, r.text or ""))
    expected = Counter()
    for r in got:
        expected[r.source] += r.taken
    assert +taken == +expected and mixing.mix(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0


def test_mix_of_rows_that_are_mostly_one(spark, monkeypatch):
    """A third of all rows are equal, another third share key and text only: each is taken as its place says."""
    r = random.Random(8)
    alike = [(1, "one two three", "s", 1, "a", 2)] * 700 + [(2, "four five", "s", i, "a", 2) for i in range(700)]
    rows = alike + [(i, prose(r, 4), None if i % 2 else "t", 1, "b", 3) for i in range(10, 710)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    expected, plain = Counter(), mixing.mixed(df).collect()
    for x in plain:
        expected[x.doc_id] += x.copies
    got = mixing.mix(df).collect()
    assert Counter(x.doc_id for x in got) == +expected and set(map(tuple, got)) <= set(rows)
    # No row is taken more than one time above another of its key.
    shares = Counter(tuple(x) for x in got if x.doc_id == 2)
    assert max(shares.values()) - (min(shares.values()) if len(shares) == 700 else 0) <= 1
    monkeypatch.setattr(mixing, "COPIES_PER_STEP", 100)
    monkeypatch.setattr(ordering, "COPIES_PER_STEP", 100)
    assert sorted(map(str, mixing.mix(df.repartition(3)).collect())) == sorted(map(str, got))


def test_urls(spark):
    urls = ["http://a.NET/x?q", "https://www.example.net/en/1", "x://example.com/de/", "http://b.example.org/fr/z#t", "no scheme", None, "http://net", "://a.b?c://d/e", "http://evil.com/spam/1"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(100 + i, f"http://evil.com/spam/{i}", 1) for i in range(30)]
                                  + [(200 + i, f"http://good.com/page/{i}", 1) for i in range(60)], "page_id int, url string, verdict int")
    labels = spark.createDataFrame([(100 + i, True) for i in range(30)] + [(200 + i, False) for i in range(60)], "page_id int, bad boolean")
    got = {r.page_id: r for r in url_filter.judged(pages, labels).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(8)] == [
        ("a.net", "/x", "net/"), ("www.example.net", "/en/1", "example.net/en/"), ("example.com", "/de/", "example.com/de/"),
        ("b.example.org", "/fr/z", "org/fr/"), ("", "", None), ("", "", None), ("net", "", None), ("a.b", "", None)]
    assert [got[i].verdict for i in range(9)] == ["block", "allow", "block", "allow", "allow", "allow", "allow", "allow", "block"]
    assert got[205].verdict == "allow" and len(got) == 99
    assert url_filter.judged(pages.limit(0), labels.limit(0)).count() == 0


def components(texts):
    def fp(t):
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fp(t) for _, t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            group[i] = min([group[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 3])
    least = {g: min((d for (d, _), h in zip(texts, group) if h == g and d is not None), default=None) for g in group}
    return sorted((str(d), f"{p:016x}", least[g]) for (d, _), p, g in zip(texts, prints, group))


def test_simhash(docs, empty, rows):
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == components([(r[0], r[1]) for r in rows])
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.component_id for r in got})
    assert simhash.near_duplicates(empty).count() == 0


def test_every_link_is_found_in_trees(monkeypatch):
    r = np.random.default_rng(3)
    seeds = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([seeds] + [seeds ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) for _ in range(30)]))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    met = np.zeros_like(near)
    for half in simhash.HALVES:
        for _, here in simhash.routed(points, simhash.grow_tree(points, half, 50)):
            met[np.ix_(here, here)] = True
    assert (near & ~met).sum() == 0
    monkeypatch.setattr(simhash, "LOCAL_LEAF", 30)
    a, b = simhash.linked(points)
    root = dict(zip(a.tolist(), b.tolist()))
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        assert root[int(points[i])] == root[int(points[j])]


def test_decontamination(spark, monkeypatch):
    r = random.Random(9)
    items = [(i, " ".join("".join(r.choice("abcdefghilmnoprst") for _ in range(r.randint(2, 7))) for _ in range(n))) for i, n in enumerate((25, 40, 12))]
    far = lambda n: " ".join("".join(r.choice("abcdefghilmnoprst") for _ in range(5)) for _ in range(n))
    edited = list(items[1][1])
    for at in range(5, len(edited), 25):
        edited[at] = "#"
    ruined = list(items[1][1])
    for at in range(3, len(ruined), 6):
        ruined[at] = "#"
    texts = [far(200), far(40) + " " + items[0][1].upper() + "\n" + far(30), "".join(edited), "".join(ruined), items[2][1].replace(" ", " \n "), None, "",
             far(500) + items[1][1][:40], far(3000) + " " + items[0][1] + " " + far(20)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(2, texts[2], 0)], "doc_id int, text string, item_id int")
    bench = spark.createDataFrame([*items, (9, items[0][1]), (10, None), (11, "abc")], "item_id int, text string")
    for stretch in (decontaminate.STRETCH, 500):
        monkeypatch.setattr(decontaminate, "STRETCH", stretch)
        for chars in (decontaminate.BLOCK_CHARS, 100):
            monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
            best = decontaminate.hits(texts, decontaminate.Passages(items))
            assert set(best) == {(1, 0), (2, 1), (4, 2), (8, 0)} and best[2, 1][0] == len(range(5, len(edited), 25))
    got = decontaminate.found(df, bench).collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == [(1, 0), (2, 1), (2, 1), (4, 2), (8, 0)]
    clean = decontaminate.cleaned(df, bench)
    assert sorted(x.doc_id for x in clean.collect()) == [0, 3, 5, 6, 7] and clean.columns == df.columns
    assert decontaminate.found(df, bench.limit(0)).count() == 0 and decontaminate.found(df.limit(0), bench).count() == 0


def test_token_files(spark, docs, empty, rows):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    path = new_folder(spark, "tokens")
    token_output.write_corpus(docs, path, TOKENIZER)
    got = sorted(token_output.fetched(token_output.keys_of(spark, path), path).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    start, mine, theirs = 0, Counter(), Counter()
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) // 2
        start += r.n_tokens
        mine[r.doc_id, bytes(r.ids)] += 1
    for d, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        theirs[d, np.array(ids, "<u2").tobytes()] += 1
    assert mine == theirs
    some = spark.createDataFrame([(4,), (4,), (999,)], "k bigint")
    assert token_output.fetched(some, path, digest=True).count() == 3
    assert token_output.written_and_read(empty, TOKENIZER).count() == 0


def test_word_encoder_equals_the_tokenizer():
    texts = ["It's a Test. I'LL go, e\u0301te\u0301 \u0301x", "<|endoftext|> <|ENDOFTEXT|> A.B. c,d ,x .", "Σίσυφος ΣΊΣΥΦΟΣ. İstanbul Straße", "a\u00a0b\u2003c\x0bd\x1ce", "12,5 3.", "", "  \n"]
    tokenizer, mine = Tokenizer.from_file(TOKENIZER), token_output.WordEncoder(TOKENIZER)
    for group in (texts, texts[:1] + texts[2:]):
        expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in group]
        assert [x.tolist() for x in mine.encode(group)] == expected


def test_perfect_hash():
    r = np.random.default_rng(2)
    h1, h2 = (r.integers(0, 1 << 63, 3000, dtype=np.uint64) for _ in range(2))
    shift = token_output.perfect_hash(h1, h2)
    assert sorted(token_output.slots(h1, h2, shift, 3000).tolist()) == list(range(3000))


def test_chat(spark):
    hard = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "a\\<|b"), (1, 1, "assistant", hard), (2, 0, "user", "a\\<|b"), (2, 1, "assistant", "y\n<|im_end|>"), (2, 2, "user", "q"),
            (3, 0, None, None), (None, 0, "assistant", "z"), (4, 0, "user", "a\\<|b"), (4, 1, "assistant", hard), (5, 3, "user", "x"), (5, 3, "user", "x")]
    df = spark.createDataFrame([(*r, "other") for r in rows], "conv_id bigint, turn bigint, role string, text string, node string")
    path = new_folder(spark, "chat")
    chat.formatted(df, path)
    nodes = sorted(spark.read.parquet(f"{path}/nodes").collect(), key=lambda n: n.start)
    assert len(nodes) == 8 and [n.end for n in nodes[:-1]] == [n.start for n in nodes[1:]]
    by = {bytes(n.node): n for n in nodes}
    for n in nodes:
        over = by.get(bytes(n.parent)) if n.depth else None
        if over:
            assert over.start < n.start and n.subtree_end <= over.subtree_end and n.position == over.position + len(over.body)
        assert not any(c in n.body[len("<|im_start|>") : -len("<|im_end|>\n")] for c in chat.CONTROLS)
    got = {r.conv_id: r for r in chat.read_back(spark, path).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.formatted_and_read(df.limit(0)).count() == 0


def test_chat_layout_of_long_and_branching_conversations(spark, tmp_path):
    r = random.Random(7)
    convs = {i: [r.choice("ab") * r.randint(1, 2) for _ in range(r.randint(1, 7))] for i in range(300)}
    convs |= {1000 + i: convs[5] for i in range(50)} | {2000: ["a"] * 5000, 2001: ["a"] * 2500 + ["b"] * 10}
    rows = [(c, t, "user", x) for c, texts in convs.items() for t, x in enumerate(texts)]
    chat.formatted(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), str(tmp_path / "trees"))
    nodes = {bytes(n.node): n for n in spark.read.parquet(str(tmp_path / "trees/nodes")).collect()}
    assert len(nodes) == len({tuple(x[: i + 1]) for x in convs.values() for i in range(len(x))})
    ordered = sorted(nodes.values(), key=lambda n: n.start)
    assert ordered[0].start == 0 and all(a.end == b.start for a, b in zip(ordered, ordered[1:]))
    # A walk over the layout: what is open at a node are its ancestors, and no stretch crosses another.
    above = []
    for n in ordered:
        while above and above[-1].subtree_end <= n.start:
            assert above.pop().subtree_end <= n.start
        assert len(above) == n.depth and n.position == sum(len(a.body) for a in above)
        assert bytes(n.parent) == (bytes(above[-1].node) if above else b"")
        assert not above or n.subtree_end <= above[-1].subtree_end
        above.append(n)


def test_pii(spark):
    text = "Dear Mr. John Smith, call +49 (030) 555-1234; Smith is at 10.0.0.7 or jo.smith@corp.example.com. Госпожа Анна Иванова 4111 1111 1111 1111 token = \"04dbebab91ab85687d33\""
    rows = [(1, text, 0), (2, "+49 030-5551234 Mr. Smith", 0), (3, "clean text, version 4.0", 0), (None, None, 0), (4, "", 0), (1, text, 0)]
    rows += [(10 + i, f"at 10.1.{i // 250}.{i % 250 + 1}", 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id int, text string, form int")
    got = sorted(pii.replaced(df, "key").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    first, second = got[0], got[2]
    assert len(got) == len(rows) and got[0].text == got[1].text and first.n_entities == 10
    for word in ("John", "Smith", "555-1234", "10.0.0.7", "jo.smith", "Анна", "4111 1111", "04dbebab"):
        assert word not in first.text
    name = re.search(r"Mr\. \w+ (\w+),", first.text).group(1)
    assert f"; {name} is at 10." in first.text and second.text.endswith(f"Mr. {name}")
    assert re.sub(r"\D", "", second.text) in re.sub(r"\D", "", first.text) and first.text.count("+49 (") == 1
    assert pii.luhn(re.sub(r"\D", "", re.search(r"\d{4} \d{4} \d{4} \d{4}", first.text).group()))
    assert re.search(r"Госпожа [а-яА-Я]+", first.text) and got[3].text == rows[2][1] and got[-1].text is None
    addresses = [r.text for r in got if r.doc_id and r.doc_id >= 10]
    assert len(set(addresses)) == 400 and not set(addresses) & {r[1] for r in rows}
    assert pii.replaced(df.limit(0), "key").count() == 0


def test_sharding(spark, docs, empty, rows, tmp_path):
    path = str(tmp_path / "map")
    got = sharding.assign(docs, shards=3, map_path=path).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    for shard in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))
    assert sharding.assign(empty).count() == 0
    hot = spark.createDataFrame([(1, "same")] * 3000 + [(i, "t" * (i % 50)) for i in range(3000)], "doc_id int, text string")
    load, path = Counter(), str(tmp_path / "hot-map")
    for r in sharding.assign(hot, shards=4, map_path=path).collect():
        load[r.shard] += r["size"]
    assert max(load.values()) <= 1.02 * min(load.values())
    before = {(r.virtual_slot, r.part): r.shard for r in spark.read.parquet(path).where("version = 1").collect()}
    after = {(r.virtual_slot, r.part): (r.shard, r.n_bytes) for r in sharding.rebalance(spark, path, 5).collect()}
    assert all(s == before[k] or s == 4 for k, (s, _) in after.items())
    load = Counter()
    for s, n in after.values():
        load[s] += n
    assert max(load.values()) <= 1.1 * min(load.values())
    # The edited map places the records, and those that come later.
    more = hot.unionByName(spark.createDataFrame([(9000 + i, "new " * 9) for i in range(50)], "doc_id int, text string"))
    for table, records in ((hot, 6000), (more, 6050)):
        got = sharding.assign(table, shards=4, map_path=path).collect()
        assert len(got) == records and {r.shard for r in got} == set(range(5))
        assert all(after[r.virtual_slot, r.part][0] == r.shard for r in got if (r.virtual_slot, r.part) in after)
        for shard in range(5):
            own = sorted(r.slot for r in got if r.shard == shard)
            assert own == list(range(len(own)))


def test_html(spark):
    forest = html_extract.fitted(spark)
    x, y = html_extract.training_rows(60, 12345)
    assert ((forest.odds(x) > 0) == (y == 1)).mean() > 0.97
    page = ('<html><head><title>T</title><style>p{}</style></head><body><nav><a href="#">Home</a></nav><div class="ad">Buy this, please.</div><article><h1>Head &amp; line</h1>'
            "<p><b>First<br><p>Second   one\n here, it is.</p><div class='notice'>Sign up now.</div></article><footer>&copy; x</footer>")
    pages = [page, None, "", "just text", page, "<p>cut of"]
    df = spark.createDataFrame([(i, f"u{i}", h, 5) for i, h in enumerate(pages)], "page_id int, url string, html string, text int")
    got = [r.text for r in sorted(html_extract.extracted(df).collect())]
    assert got == ["Head & line First Second one here, it is.", "", "", "just text", "Head & line First Second one here, it is.", "cut of"]
    assert html_extract.extracted(df.limit(0)).count() == 0
    r = random.Random(3)
    for _ in range(20):
        p = html_extract.parsed(html_extract.training_page(r))
        keep = html_extract.decoded(p, np.array([r.uniform(-2, 2) for _ in p.elements]))
        assert all(keep[e.parent] for i, e in enumerate(p.elements) if i and keep[i])


def test_filters_on_measures_stay_above_them(docs):
    plan = quality.judged(docs).where("not kept and n_words > 1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate") and plan.count("split(") < 10


def test_a_long_passage_leaves_no_short_piece(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 100)
    r = random.Random(4)
    item = "".join(r.choice("abcdefghilmnoprst ") for _ in range(209)).strip().replace("  ", "a ")
    passages = decontaminate.Passages([(1, item)])
    assert set(passages.m.tolist()) == {100}
    assert not decontaminate.hits(["x " * 30 + item[-9:] + " y" * 30], passages)
    assert {t for t, _ in decontaminate.hits(["x " * 30 + item + " y", item[:110], item[-105:]], passages)} == {0, 1, 2}


def test_pii_of_crowded_kinds_ends(spark, monkeypatch):
    assert pii.surrogate("ip", "192.168.1.2", pii.CROWDED - 1, b"k").startswith("192.168.")
    assert pii.surrogate("ip", "192.168.1.2", pii.CROWDED, b"k").startswith("10.")
    monkeypatch.setattr(pii, "CROWDED", 0)
    found = spark.createDataFrame([("digits", f"{i:02d}") for i in range(70)], "kind string, form string")
    got = pii.mapped(found, "key").collect()
    assert len({r.new for r in got}) == 70 and not any(r.new == r.form for r in got)
