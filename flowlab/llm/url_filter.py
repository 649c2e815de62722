"""URL filtering by fixed host rules and by association rules mined from labels.

A host rule fits its host, all subdomains and every path that starts with its path; the longest
fitting rule decides. Where none fits, rules mined by FP-growth decide: URLs are sets of tokens
(host labels, path words, query keys), and a combination of tokens that stands in enough bad URLs
and among all labelled URLs that hold it leads to the bad label often enough blocks. FP-growth
runs over the bad URLs, where the support of a rule is counted; its confidence needs all labelled
URLs. Rules are matched through an inverted index: each is filed under its rarest token, and a URL
looks up its own tokens only. All steps are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import numbered_copies
from flowlab.sources.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CONFIDENCE = 0.8
# A rule needs so many bad URLs, at every size of the table.
MIN_ROWS = 10


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)


def host(url: str | Column) -> Column:
    """What stands between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(rules: Sequence[HostRule], host: Column, path: Column) -> Column:
    """The longest fitting rule as struct(size, rule, verdict); null if none fits."""
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None)


def tokens(url: str | Column) -> Column:
    """The distinct tokens of a URL; numbers are one token. None for null."""
    url = F.col(url) if isinstance(url, str) else url
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))

    def parts(text: Column, pattern: str, kind: str) -> Column:
        whole = F.filter(F.split(F.lower(text), pattern), lambda x: x != "")
        return F.transform(whole, lambda x: F.concat(F.lit(kind), F.regexp_replace(x, "[0-9]+", "0")))

    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_replace(x, "(?s)=.*$", ""))
    named = F.transform(F.filter(keys, lambda x: x != ""), lambda x: F.concat(F.lit("query="), x))
    every = F.concat(parts(host(url), "[.:@-]", "host="), parts(path(url), "[/._-]", "path="), named)
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


def fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of `urls` (with _tokens) beside each of the `rules` (with tokens) whose tokens they all hold. A rule is looked up
    under the rarest of its tokens."""
    often = urls.select(F.explode("_tokens").alias("token")).groupBy("token").count()
    filed = rules.select("*", F.explode("tokens").alias("token")).join(often, "token")
    filed = filed.groupBy(*rules.columns).agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    looked = urls.select("*", F.explode("_tokens").alias("token")).join(filed, "token").drop("token")
    return looked.where(F.size(F.array_except("tokens", "_tokens")) == 0)


def mined_rules(urls: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """(tokens, confidence, n_rows) of the combinations that stand in `min_rows` bad URLs or more and lead to the bad label
    with the least confidence or more; n_rows are all labelled URLs that hold them. From (url, bad).

    Every labelled URL counts. An input without bad URLs gives no rules.
    """
    rows = urls.where("bad is not null").groupBy(tokens("url").alias("_tokens")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad")
    )
    rows = stage(rows.where(F.size("_tokens") > 0), "baskets")
    # One basket per bad URL, as the miner counts baskets.
    bad = numbered_copies(rows.where("n_bad > 0").select(F.col("_tokens").alias("items"), "n_bad"), "n_bad", "_copy").select("items")
    n = bad.count()
    if n < min_rows:
        return rows.sparkSession.createDataFrame([], "tokens array<string>, confidence double, n_rows bigint")
    # Half a basket less, so that rounding does not ask for one more.
    model = FPGrowth(itemsCol="items", minSupport=(min_rows - 0.5) / n).fit(bad)
    sets = stage(model.freqItemsets.select(F.array_sort("items").alias("tokens")), "frequent")
    counted = fitting(rows, sets).groupBy("tokens").agg(F.sum("n").alias("n_rows"), F.sum("n_bad").alias("n_bad"))
    confidence = F.col("n_bad") / F.col("n_rows")
    return counted.select("tokens", confidence.alias("confidence"), "n_rows").where(F.col("confidence") >= min_confidence)


def judged(
    pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[HostRule] = HOST_RULES,
    min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined_rule.

    `labels` holds (page_id, bad) for some pages. A null or malformed URL has an empty host and
    path and is allowed; repeated rows are judged alike; empty tables give an empty one, or no
    mined rules. Other columns of pages do not matter.
    """
    narrow = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    marks = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    labelled = narrow.join(marks, "page_id").select("url", F.col("bad").cast("boolean").alias("bad"))
    mined = stage(mined_rules(labelled, min_confidence, min_rows), "url-rules")
    # Rows of the same URL are judged once.
    urls = narrow.where("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("_n"))
    urls = urls.select("url", tokens("url").alias("_tokens"))
    named = F.struct("confidence", "n_rows", F.array_join("tokens", " ").alias("name"))
    best = fitting(urls, mined).groupBy("url").agg(F.max(named)["name"].alias("mined_rule"))
    out = narrow.withColumns({"host": host("url"), "path": path("url")})
    out = out.withColumn("_fixed", host_rule(rules, F.col("host"), F.col("path"))).join(best, "url", "left")
    verdict = F.coalesce(F.col("_fixed.verdict"), F.when(F.col("mined_rule").isNotNull(), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("_fixed.rule").alias("rule"), verdict.alias("verdict"), "mined_rule")
