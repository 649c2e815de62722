"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

The measures of a text (words, symbols, stop words, lines, repeated word windows) are column
expressions; each rule of the table bounds one of them. No user function and no shuffle takes
part, so the operator runs inside the scan whatever the sizes. Repeated windows are found by
one 64-bit hash per window inside the row; a text of n words costs n log n at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import words

# The symbols that count, and common words of the corpus languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
    "de la le et les en un du une que pour est dans qui par sur pas au avec "
    "el y los se las del por con no una su para al es"
).split()
LOOKED_UP = 64
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """A measure, written in SQL over the measured columns, and the bounds it must keep."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def broken(self) -> Column:
        value = F.expr(self.measure)
        bounds = [value < self.low] if self.low is not None else []
        bounds += [value > self.high] if self.high is not None else []
        test = bounds[0]
        for bound in bounds[1:]:
            test = test | bound
        # No value (no word, no line) breaks nothing: the base rules see to empty texts.
        return F.coalesce(test, F.lit(False))


RULES = (
    Rule("word length", "try_divide(word_chars, n_words)", 3.0, 10.0),
    Rule("symbols", "try_divide(n_symbols, n_words)", None, 0.1),
    Rule("stop words", "n_stop_words", 2, None),
    Rule("duplicate lines", "try_divide(n_dup_lines, n_lines)", None, 0.5),
    Rule("bullet lines", "try_divide(n_bullet_lines, n_lines)", None, 0.9),
    Rule("ellipsis lines", "try_divide(n_ellipsis_lines, n_lines)", None, 0.3),
)


def _window_hashes(w: Column, n: Column) -> Column:
    hashed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(n >= 3, hashed)


def _named(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: a one-element array gives it a name."""
    return F.transform(F.array(value), body)[0]


def _starts(hashes: Column) -> Column:
    """Where the windows found twice or more start, in order."""

    def few(twice: Column) -> Column:
        spots = F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i))
        return F.array_compact(spots)

    def many(z: Column) -> Column:
        def same(e: Column, k: Column) -> Column:
            return F.coalesce(F.get(z, k)["h"] == e["h"], F.lit(False))

        both = F.filter(z, lambda e, k: same(e, k + 1) | same(e, k - 1))
        return F.sort_array(F.transform(both, lambda e: e["i"]))

    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    twice = _named(
        F.sort_array(hashes),
        lambda z: F.array_distinct(F.filter(z, lambda h, k: F.coalesce(F.get(z, k + 1) == h, F.lit(False)))),
    )
    # The same starts either way; looking up a short list beats sorting all windows with their places.
    return _named(twice, lambda t: F.when(F.size(t) <= LOOKED_UP, few(t)).otherwise(_named(F.sort_array(placed), many)))


def _repeated_words(hashes: Column) -> Column:
    """Words that lie in a window found twice or more. The distinct hashes tell which texts have
    such windows at all."""
    covered = F.aggregate(
        _starts(hashes),
        F.struct(F.lit(0).alias("words"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["words"] + F.least(F.lit(3), p - a["last"])).alias("words"), p.alias("last")),
    )["words"]
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(0)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measures of its texts; columns of these names are replaced.

    A null text counts as an empty one: every measure is 0. The measures come out of a generator:
    a later filter on them cannot be pushed below, which would repeat them, per word in the worst case.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, n, ln = F.col("_words"), F.col("n_words"), F.col("_lines")
    base = df.withColumns({"_words": words(text), "_lines": lines}).withColumn("n_words", F.size(w))
    base = base.withColumn("_windows", _window_hashes(w, n))

    def count(condition) -> Column:
        return F.size(F.filter(ln, condition)).cast("bigint")

    measures = {
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
        "n_symbols": (F.octet_length(t) - F.octet_length(F.regexp_replace(t, f"[{SYMBOLS}]", ""))).cast("bigint"),
        "n_lines": F.size(ln).cast("bigint"),
        "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("bigint"),
        "n_repeat_words": _repeated_words(F.col("_windows")).cast("bigint"),
        "n_stop_words": F.size(F.array_intersect(w, F.array(*map(F.lit, STOP_WORDS)))).cast("bigint"),
        "n_bullet_lines": count(lambda x: x.rlike("^\\s*[-*•‣]\\s")),
        "n_ellipsis_lines": count(lambda x: x.rlike("(\\.\\.\\.|…)\\s*$")),
    }
    one = F.struct(*(c.alias(name) for name, c in measures.items()))
    own = [c for c in df.columns if c not in measures and c not in ("_words", "_lines", "_windows", "_measures")]
    return base.select(*own, F.explode(F.array(one)).alias("_measures")).select(*own, "_measures.*")


def judged(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """df with its measures, `base_failed`, `failed_rules` and `kept`.

    `base_failed`: under 50 words, or over half of the words in repeated three-word windows.
    `kept`: the base holds and no rule is broken. Empty and null texts fail the base; repeated
    rows are judged alike; an empty table gives an empty one.
    """
    # Whole numbers on both sides, no rounding.
    too_alike = 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    failed = F.array_compact(F.array(*(F.when(r.broken(), F.lit(r.name)) for r in rules)))
    out = measured(df, text).withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | too_alike,
        "failed_rules": failed,
    })
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def kept(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of df that `judged` keeps, with their own columns only, whatever their names."""
    own = df.select(F.col(text).alias("text"), F.struct(*df.columns).alias("__row"))
    return judged(own, "text", rules).where("kept").select("__row.*")
