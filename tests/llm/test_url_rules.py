"""Mined URL rules against the enumeration of all token sets."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

from flowlab.llm import url_filter
from flowlab.llm.queries import REGISTRY


def enumerated(baskets: list[tuple[frozenset, bool]], min_rows: int, confidence: float) -> dict[tuple, tuple[float, int]]:
    every, bad = Counter(), Counter()
    for items, is_bad in baskets:
        for size in range(1, len(items) + 1):
            for s in combinations(sorted(items), size):
                every[s] += 1
                bad[s] += is_bad
    return {s: (n / every[s], every[s]) for s, n in bad.items() if n >= min_rows and n / every[s] >= confidence}


def urls(r: random.Random, n: int) -> list[tuple[str, bool | None]]:
    out = []
    for _ in range(n):
        host, path = r.choice(("casino", "news", "blog")), r.choice(("spam", "en", "de"))
        bad = r.random() < (0.95 if (host, path) == ("casino", "spam") else 0.3 if host == "casino" else 0.1)
        out.append((f"https://{host}.test/{path}/{r.randrange(9)}" + r.choice(("", "?ref=1", "?page=2&ref=x")), bad))
    return out + [(out[0][0], None), ("", True), (None, True)]


def test_rules_equal_the_enumeration(spark):
    for seed, rows, least in ((1, 600, 10), (2, 90, 3), (3, 2500, 60)):
        labelled = urls(random.Random(seed), rows)
        df = spark.createDataFrame(labelled, "url string, bad boolean")
        items = df.where("bad is not null").select(url_filter.tokens("url").alias("t"), "bad").collect()
        wanted = enumerated([(frozenset(x.t), x.bad) for x in items], least, 0.8)
        got = {tuple(x.tokens): (x.confidence, x.n_rows) for x in url_filter.mined_rules(df, 0.8, least).collect()}
        assert got == wanted and wanted
    assert url_filter.mined_rules(df.where("not bad")).count() == 0


def test_a_rule_of_some_rows_holds_at_every_size(spark):
    bad = [(f"https://evil.test/x/{i}", True) for i in range(12)]
    for others in (50, 20_000):
        df = spark.createDataFrame(bad + [(f"https://fine.test/y/{i}", i % 50 == 0) for i in range(others)], "url string, bad boolean")
        assert ["host=evil"] in [x.tokens for x in url_filter.mined_rules(df).collect()]


def test_query_takes_labels_by_the_document_of_the_page(spark, tmp_path):
    pages = [(i, f"https://{'dark' if i % 3 == 0 else 'light'}.test/en/{1000 + i}" + (".html", "/", "#top", "?page=7")[i % 4], "x") for i in range(120)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(1000 + i, 0 if i % 3 == 0 else 1, 0) for i in range(0, 90)] + [(i, 1, 0) for i in range(90)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.page_id: x for x in REGISTRY["op3_association_url_filter"](spark, str(tmp_path)).collect()}
    assert all((got[i].verdict == "block") == (i % 3 == 0) for i in range(120)) and got[117].mined_rule
