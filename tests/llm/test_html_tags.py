"""Tags without content or end, and features of long lists."""

from __future__ import annotations

import time

import pytest

from flowlab.llm import html_extract


def text(page: str) -> str:
    return " ".join("".join(t for _, _, t in html_extract.parsed(page).pieces).split())


def test_a_tag_without_end_hides_no_text():
    assert text("<p>a <svg width='1' />b</p><p>c <svg><text>x</text></svg>d</p>") == "a bc d"
    assert text("<p>a <svg/>b</p> c") == "a b c"
    for tag in ("svg", "noscript", "template", "iframe", "xmp"):
        assert text(f"<p>a <{tag}>b</p> <p>c <{tag}>d</p>") == "a b c d"
    for tag in ("script", "style", "textarea", "title"):
        assert text(f"<p>a</p> <{tag}>b <p>c</p>") == "a"
    # The slash belongs to the value, so the element has an end tag.
    assert text("<p>a <svg width=1/>x</svg>b</p>") == "a b"


def test_features_of_many_siblings():
    page = html_extract.parsed("<ul>" + "<li>x" * 60 + "<div>z</div>" * 240 + "</ul>")
    rows = html_extract.features(page)
    names = html_extract.FEATURES
    for e in page.elements:
        siblings = e.children
        for n, c in enumerate(siblings):
            same = sum(page.elements[s].tag == page.elements[c].tag for s in siblings)
            assert rows[c, names.index("place")] == n / len(siblings)
            assert rows[c, names.index("alike_siblings")] == same / len(siblings)
    assert max(len(e.children) for e in page.elements) >= 200 or len(page.elements) > 200


@pytest.mark.parametrize("piece", ["<a ", "<!", "<", "</svg", "<svg ", "<!-- ", "<p x='", "a<b ", "</", "<p> <a ", "<b>", "<b></i>"])
def test_hostile_pages_take_linear_time(piece):
    start = time.perf_counter()
    html_extract.parsed("<p>Some text.</p>" + piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - start < 20


def test_what_the_end_of_a_page_cuts_off_is_markup():
    for page, words in (
        ("<p>One</p>two <a href=x", "One two"), ("<p>One</p>two <!-- three > four", "One two"), ("one < two", "one < two"),
        ("<p>One</p>a > b <!", "One a > b"), ("one <!-- two --> three", "one  three"), ("a > b < c", "a > b < c"),
    ):
        assert "".join(t if i == 0 or b == html_extract.parsed(page).pieces[i - 1][1] else " " + t for i, (_, b, t) in enumerate(html_extract.parsed(page).pieces)).strip() == words
