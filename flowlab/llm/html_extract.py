"""Main text of web pages: boosted trees judge every DOM element, a tree decoding makes the verdicts agree.

A page becomes a tree of elements. Each element gets features: its tag, the tokens of its class,
id and role, depth, density of text, links and tags in its subtree, its place among its siblings,
and what stands above it. Gradient-boosted trees give each element a log-odds of being main text.
The decoding then picks the subtree of the page with the largest sum of log-odds, weighted by
text, under one rule: below a dropped element everything is dropped. So a kept paragraph never
hangs in a dropped ancestor, and one odd verdict inside a region is outvoted by the region.

The trees are fitted by Spark ML on elements of pages composed from a fixed set of block kinds
(TRAINING_PAGES of them, a documented bound; the given pages carry no labels). Judging is one pass
without a shuffle over whole pages.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.common import bounded_batches

TRAINING_PAGES = 400
SEED = 7
TREES, DEPTH = 24, 4

# Kinds of tags and the tokens that name regions.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg xmp".split())
# Of these an end tag that is missing takes the rest of the page with it.
RAW_TEXT = set("script style textarea title".split())
BLOCK = set(
    "html body head address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul "
    "select option button label caption center".split()
)
ASIDE = set("nav footer aside form menu dialog button select label fieldset head".split())
CLOSED_BY = {
    "p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
CLOSES = {name: [t for t, by in CLOSED_BY.items() if name in by] for by in CLOSED_BY.values() for name in by}
BAD_TOKENS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs sidebar side aside rail widget footer foot bottom header masthead topbar toolbar "
    "top logo cookie cookies consent gdpr notice notices alert warning popup modal overlay newsletter subscribe "
    "subscription signup login register search form comment comments commentlist respond reply replies discussion disqus "
    "feedback share sharing social follow related recommended recommendation recommendations trending popular tags "
    "pagination pager copyright legal disclaimer skip hidden print paywall teaser outbrain taboola contentinfo "
    "complementary search".split()
)
GOOD_TOKENS = set(
    "article articlebody content contents main maincontent post entry story body text blog prose markdown paragraph "
    "lead summary abstract".split()
)
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|data-y|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# A slash at the end of a value without quotes belongs to the value.
UNQUOTED_END = re.compile(r"=\s*[^\s\"'][^\s]*/\Z")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Element:
    tag: str
    parent: int
    depth: int
    tokens: list[str]
    mark: str | None = None
    children: list[int] = field(default_factory=list)
    chars: int = 0
    link_chars: int = 0
    stops: int = 0
    tags: int = 1
    in_link: bool = False


@dataclass
class Page:
    elements: list[Element]
    # (element, block number, text) in page order
    pieces: list[tuple[int, int, str]]


def parsed(source: str) -> Page:
    """The element tree. Unclosed and misnested tags close as in browsers for the common cases; a
    page cut short closes where it ends."""
    elements, pieces, block = [Element("html", -1, 0, [])], [], 0
    stack, at, endless = [0], 0, set()
    # Behind the last > no tag ends, so nothing is searched there again and again.
    last = source.rfind(">") + 1
    # Open elements by tag: a deep stack is searched only for what is on it.
    opened: Counter[str] = Counter()

    def text(raw: str) -> None:
        if raw and (not raw.isspace() or pieces):
            pieces.append((stack[-1], block, html.unescape(raw)))

    def close(position: int) -> None:
        nonlocal block
        if any(elements[i].tag in BLOCK for i in stack[position:]):
            block += 1
        for i in stack[position:]:
            opened[elements[i].tag] -= 1
        del stack[position:]

    while at < len(source):
        m = TAG.search(source, at, last) if at < last else None
        if not m:
            # A comment or tag cut off by the end of the page is markup.
            tail = source[at:].partition("<!--")[0]
            cut = re.search(r"<[a-zA-Z/!?]", tail[max(0, last - at) :])
            text(tail[: max(0, last - at) + cut.start()] if cut else tail)
            break
        text(source[at : m.start()])
        at = m.end()
        if m.group().startswith("<!--") and not m.group().endswith("-->"):
            break
        slash, name, rest = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if name is None:
            continue
        name = name.lower()
        if slash:
            for i in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if elements[stack[i]].tag == name:
                    close(i)
                    break
                if name not in BLOCK and elements[stack[i]].tag in BLOCK:
                    break
            continue
        if name == "br":
            pieces.append((stack[-1], block, " "))
        if name in RAW:
            elements[stack[-1]].tags += 1
            if name in endless or name == "svg" and rest.endswith("/") and not UNQUOTED_END.search(rest):
                continue
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at, last)
            if end:
                at = end.end()
            elif name in RAW_TEXT:
                at = len(source)
            else:
                endless.add(name)
            continue
        for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in CLOSES.get(name, ())) else ():
            tag = elements[stack[i]].tag
            if name in CLOSED_BY.get(tag, ()):
                close(i)
                break
            if tag in BLOCK and tag not in CLOSED_BY:
                break
        if name in BLOCK:
            block += 1
        if name in VOID or name == "html":
            continue
        found = {a.lower(): v or w or x or "" for a, v, w, x in ATTRIBUTE.findall(rest)} if rest else {}
        named = " ".join(found.get(a, "") for a in ("class", "id", "role", "aria-label"))
        tokens = [w.lower() for w in WORD.findall(named)] if named.strip() else []
        if "hidden" in found or "display:none" in found.get("style", "").replace(" ", ""):
            tokens.append("hidden")
        parent = stack[-1]
        elements.append(Element(name, parent, len(stack), tokens, found.get("data-y")))
        elements[-1].in_link = name == "a" or elements[parent].in_link
        elements[parent].children.append(len(elements) - 1)
        stack.append(len(elements) - 1)
        opened[name] += 1
    return Page(elements, pieces)


def features(page: Page) -> np.ndarray:
    """One row per element."""
    e = page.elements
    own = np.zeros(len(e))
    for i, _, t in page.pieces:
        n = len(t.strip())
        own[i] += n
        e[i].chars += n
        e[i].stops += t.count(".") + t.count(",")
        e[i].link_chars += n if e[i].in_link else 0
    for i in range(len(e) - 1, 0, -1):
        p = e[e[i].parent]
        p.chars, p.link_chars, p.stops, p.tags = p.chars + e[i].chars, p.link_chars + e[i].link_chars, p.stops + e[i].stops, p.tags + e[i].tags
    whole = max(1, e[0].chars)
    rows = np.zeros((len(e), len(FEATURES)))
    above = [(0, 0, 0, 0)] * len(e)
    place, alike = np.zeros(len(e), np.int64), np.ones(len(e), np.int64)
    for x in e:
        same = Counter(e[c].tag for c in x.children)
        for n, c in enumerate(x.children):
            place[c], alike[c] = n, same[e[c].tag]
    for i, x in enumerate(e):
        bad, good = sum(t in BAD_TOKENS for t in x.tokens), sum(t in GOOD_TOKENS for t in x.tokens)
        over = above[x.parent] if i else (0, 0, 0, 0)
        aside, article = x.tag in ASIDE, x.tag in ("article", "main")
        header = x.tag == "header" and not over[3]
        above[i] = (over[0] + (aside or header), over[1] + min(1, bad), over[2] + min(1, good), over[3] + article)
        siblings = e[x.parent].children if i else [0]
        chars = max(1, x.chars)
        rows[i] = (
            aside or header, article, x.tag == "p", x.tag[0] == "h" and x.tag[1:].isdigit(), x.tag in ("li", "ul", "ol", "dl"),
            x.tag in ("div", "section", "body", "html"), x.tag in ("table", "td", "tr", "th", "tbody"), x.tag not in BLOCK,
            x.in_link, min(3, bad), min(3, good), *over, x.depth, math.log1p(x.chars), math.log1p(own[i]),
            x.link_chars / chars, x.chars / x.tags, x.stops / chars, len(x.children), place[i] / len(siblings),
            len(siblings), alike[i] / len(siblings),
            x.chars / max(1, e[x.parent].chars if i else whole), x.chars / whole,
        )
    return rows


FEATURES = (
    "aside_tag article_tag p heading list container table inline in_link bad_tokens good_tokens aside_above bad_above "
    "good_above article_above depth log_chars log_own link_density text_density stop_density children place siblings "
    "alike_siblings parent_share page_share"
).split()


def decoded(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which elements are kept: the best sum of log-odds, weighted by own text, of a tree that hangs
    together from the root."""
    e = page.elements
    weight = np.full(len(e), 0.1)
    for i, _, t in page.pieces:
        weight[i] += len(t.split())
    best = odds * weight
    # Children come after their parents.
    for i in range(len(e) - 1, 0, -1):
        if best[i] > 0:
            best[e[i].parent] += best[i]
    keep = np.zeros(len(e), bool)
    keep[0] = True
    for i in range(1, len(e)):
        keep[i] = keep[e[i].parent] and best[i] > 0
    return keep


def written(page: Page, keep: np.ndarray) -> str:
    """The kept text: white space folded within blocks, blocks joined by one blank."""
    blocks: list[list[str]] = []
    last = None
    for i, block, t in page.pieces:
        if keep[i]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(t)
    folded = (" ".join("".join(b).split()) for b in blocks)
    return " ".join(b for b in folded if b)


class Forest:
    """Fitted trees as arrays: an element walks all trees at once."""

    def __init__(self, trees: list[list[tuple]], weights: list[float]):
        # A node is (feature, threshold, left, right, value); leaves point to themselves.
        self.trees = [tuple(np.array(c) for c in zip(*t)) for t in trees]
        self.weights = weights

    def odds(self, rows: np.ndarray) -> np.ndarray:
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for (feature, limit, left, right, value), w in zip(self.trees, self.weights):
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                at = np.where(rows[each, feature[at]] <= limit[at], left[at], right[at])
            total += w * value[at]
        return 2 * total


def _nodes(node, out: list[tuple]) -> int:
    """Flattens a Spark ML tree; returns the node's number."""
    at = len(out)
    out.append((0, 0.0, at, at, 0.0))
    if node.subtreeDepth() == 0:
        out[at] = (0, 0.0, at, at, float(node.prediction()))
    else:
        split = node.split()
        left, right = _nodes(node.leftChild(), out), _nodes(node.rightChild(), out)
        out[at] = (int(split.featureIndex()), float(split.threshold()), left, right, 0.0)
    return at


# Block kinds of training pages, as (tag, class) choices.
SIDE_KINDS = {
    "links": [("nav", ""), ("nav", "menu"), ("div", "navbar"), ("ul", "menu"), ("div", "breadcrumbs"), ("div", "pagination"), ("div", "social-share"), ("div", "tags")],
    "header": [("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead top")],
    "footer": [("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright")],
    "prose": [("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "ad"), ("div", "advert"), ("section", "promo"), ("div", "sponsored"), ("div", "cookie-notice"), ("div", "notice"), ("div", "alert"), ("div", "newsletter"), ("div", "related"), ("div", "popup")],
    "form": [("form", ""), ("form", "search"), ("form", "signup"), ("div", "login-form")],
    "comments": [("section", "comments"), ("div", "comments"), ("ol", "commentlist"), ("div", "discussion"), ("aside", "comments")],
}
MAIN_KINDS = [("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "entry-content"), ("div", ""), ("section", ""), ("div", "story"), ("div", "post-body"), ("article", "entry")]


def training_page(r: random.Random) -> str:
    """A page of random blocks; `data-y` marks main text (1) and what is not (0)."""

    def words(a: int, b: int) -> str:
        n = r.randint(a, b)
        return " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) + ("," if r.random() < 0.08 else ". " if r.random() < 0.08 else "") for _ in range(n))

    def wrap(kind: tuple[str, str], inner: str, mark: int) -> str:
        tag, name = kind
        attribute = r.choice(["class", "class", "id"])
        return f'<{tag}{f" {attribute}={chr(34)}{name}{chr(34)}" if name else ""} data-y="{mark}">{inner}</{tag}>'

    def links() -> str:
        items = [f'<a href="#">{words(1, 3)}</a>' for _ in range(r.randint(2, 9))]
        return r.choice(["<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " | ".join(items)])

    def prose(a: int, b: int) -> str:
        return "".join(f"<p>{words(a, b)}</p>" for _ in range(r.randint(1, 4)))

    def side(name: str) -> str:
        inner = {
            "links": links, "header": lambda: r.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 9)}</p>", words(1, 5)]) + r.choice(["", links()]),
            "footer": lambda: f"&copy; {words(3, 20)}" + r.choice(["", links(), prose(3, 20)]),
            "prose": lambda: r.choice([words(3, 30), prose(5, 60), f"<h3>{words(1, 4)}</h3>" + r.choice([links(), prose(5, 40)])]),
            "form": lambda: f"<label>{words(1, 4)}</label><input><button>{words(1, 2)}</button>" + r.choice(["", prose(3, 20)]),
            "comments": lambda: f"<h3>{words(1, 3)}</h3>" + "".join(f"<{t}><b>{words(1, 2)}</b><p>{words(4, 60)}</p></{t}>" for t in r.choices(["div", "li", "article"], k=r.randint(1, 5))),
        }[name]()
        return wrap(r.choice(SIDE_KINDS[name]), inner, 0)

    def body() -> str:
        parts = [r.choice([f"<h1>{words(2, 10)}</h1>", f"<header><h1>{words(2, 10)}</h1></header>", ""])]
        for _ in range(r.randint(1, 12)):
            parts.append(r.choices(
                [f"<p>{words(1, 120)}</p>", f"<p>{words(8, 40)}<b>{words(1, 6)}</b> {words(1, 40)} <a href='#'>{words(1, 4)}</a></p>", f"<h2>{words(1, 8)}</h2>",
                 "<ul>" + "".join(f"<li>{words(2, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>", f"<blockquote><p>{words(5, 40)}</p></blockquote>",
                 f"<table><tr><td>{words(1, 8)}</td><td>{words(1, 8)}</td></tr></table>", f"<div>{words(5, 80)}</div>", f"<pre>{words(3, 30)}</pre>"],
                weights=[10, 4, 2, 2, 1, 1, 2, 1])[0])
            if r.random() < 0.12:
                parts.append(side(r.choice(["prose", "form", "links", "prose"])))
        return "".join(parts)

    main = wrap(r.choice(MAIN_KINDS), body() + (side("comments") if r.random() < 0.2 else ""), 1)
    before = [side("header")] * r.randint(0, 1) + [side(r.choice(["links", "prose", "form"])) for _ in range(r.randint(0, 3))]
    after = [side(r.choice(["comments", "prose", "links", "form"])) for _ in range(r.randint(0, 3))] + [side("footer")] * r.randint(0, 1)
    inner = "".join(before) + main + "".join(after)
    if r.random() < 0.3:
        inner = f'<div class="{r.choice(["wrapper", "page", "container", "layout"])}">{inner}</div>'
    return f"<html><head><title>{words(1, 6)}</title></head><body>{inner}</body></html>"


def training_rows(pages: int = TRAINING_PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    r = random.Random(seed)
    rows, marks = [], []
    for _ in range(pages):
        page = parsed(training_page(r))
        x, mark = features(page), [None] * len(page.elements)
        for i, e in enumerate(page.elements):
            mark[i] = e.mark or (mark[e.parent] if i else None)
        judged = [i for i, m in enumerate(mark) if m is not None]
        rows.append(x[judged])
        marks += [int(mark[i]) for i in judged]
    return np.concatenate(rows), np.array(marks)


_fitted: dict[tuple[int, int], Forest] = {}


def fitted(spark: SparkSession, pages: int = TRAINING_PAGES, seed: int = SEED) -> Forest:
    """Spark ML's boosted trees on the training elements, once per driver."""
    if (pages, seed) not in _fitted:
        x, y = training_rows(pages, seed)
        rows = [(Vectors.dense(a), float(b)) for a, b in zip(x.tolist(), y.tolist())]
        data = spark.createDataFrame(rows, ["features", "label"]).coalesce(2).cache()
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=seed, subsamplingRate=1.0).fit(data)
        data.unpersist()
        trees = []
        for tree in model.trees:
            nodes: list[tuple] = []
            _nodes(tree._java_obj.rootNode(), nodes)
            trees.append(nodes)
        _fitted[pages, seed] = Forest(trees, list(model.treeWeights))
    return _fitted[pages, seed]


def main_texts(sources: list[str | None], forest: Forest) -> list[str]:
    """The main text of each page; the elements of all pages are judged in one go."""
    pages = [parsed(s or "") for s in sources]
    rows = [features(p) for p in pages]
    odds = forest.odds(np.concatenate(rows)) if rows else np.zeros(0)
    ends = np.cumsum([len(r) for r in rows])
    return [written(p, decoded(p, odds[e - len(r) : e])) for p, r, e in zip(pages, rows, ends)]


def extracted(df: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null or empty page, and one without main text, has an empty text. A page without markup is
    its own text. Repeated rows are judged alike; an empty table gives an empty one. Other columns
    of df do not matter.
    """
    spark = df.sparkSession
    bounded_batches(spark, 200)
    sent = spark.sparkContext.broadcast(fitted(spark))
    narrow = df.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = main_texts(b.column("html").to_pylist(), sent.value)
            columns = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kinds = [narrow.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return narrow.mapInArrow(extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
