"""Names of any number of parts behind a form of address."""

from __future__ import annotations

import re

import pytest

from flowlab.llm import pii


def spans(text: str) -> list[str]:
    return [text[s:e] for s, e, kind, _ in pii.entities(text) if kind == "person"]


@pytest.mark.parametrize("text, parts", [
    ("Dr. Anna Maria Lopez came", ["Anna", "Maria", "Lopez"]),
    ("Mr. O'Brien and O’Brien's car", ["O'Brien", "O’Brien"]),
    ("Mr. Smith-Jones, then Jones", ["Smith", "Jones", "Jones"]),
    ("Ms. Anna van der Berg; Berg", ["Anna", "Berg", "Berg"]),
    ("Mr. Smith's house and SMITH", ["Smith", "SMITH"]),
    ("Mr. J. R. Smith left", ["J", "R", "Smith"]),
    ("Prof al-Rashid met d'Arc", ["Rashid"]),
    ("Mme d'Arc de la Cruz", ["d'Arc", "Cruz"]),
    ("Mr. John Smith met John Smith. John left", ["John", "Smith", "John", "Smith", "John"]),
    ("Mr. Smith van driver", ["Smith"]),
    ("Госпожа Анна-Мария Иванова, Иванова", ["Анна", "Мария", "Иванова", "Иванова"]),
])
def test_all_parts_are_found(text, parts):
    assert spans(text) == parts


def test_later_mentions_get_the_same_surrogates(spark):
    text = "Mr. John Smith met Dr. Anna Maria Lopez. John Smith and Maria Lopez left; John stayed."
    out = pii.replaced(spark.createDataFrame([(1, text)], "doc_id int, text string"), "key").first()
    assert not re.search("John|Smith|Anna|Maria|Lopez", out.text) and out.n_entities == 10
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Dr\. (\w+) (\w+) (\w+)\. (\w+) (\w+) and (\w+) (\w+) left; (\w+) stayed\.", out.text)
    john, smith, _, maria, lopez = m.groups()[:5]
    assert m.groups()[5:] == (john, smith, maria, lopez, john)
