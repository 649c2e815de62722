"""Detected entities and their surrogates: formats that stay valid, classes that stay what they are."""

from __future__ import annotations

import random
from ipaddress import IPv4Address, IPv6Address

import pytest

from flowlab.llm import pii


def found(text: str) -> list[tuple[str, str]]:
    return [(kind, text[s:e]) for s, e, kind, _ in pii.entities(text)]


def remainder(text: str) -> int:
    """The check of an IBAN digit by digit."""
    rest = 0
    for c in text[4:] + text[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest


@pytest.mark.parametrize("iban", ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FR14 2004 1010 0505 0001 3M02 606"])
def test_valid_ibans_stay_valid(iban):
    assert found(f"pay {iban} now") == [("iban", iban)]
    form = pii.normal_form("iban", iban)
    for attempt in range(200):
        new = pii.surrogate("iban", form, attempt, b"k")
        assert remainder(new) == 1 and new[:2] == form[:2] and [c.isdigit() for c in new] == [c.isdigit() for c in form]
    assert [c.isspace() for c in pii.written("iban", iban, new)] == [c.isspace() for c in iban]


def test_addresses_keep_their_network():
    r = random.Random(3)
    kinds = ("is_private", "is_loopback", "is_multicast", "is_link_local")
    addresses = [IPv4Address(r.getrandbits(32)) for _ in range(400)]
    addresses += [IPv4Address(x) for x in ("10.0.0.7", "172.16.4.5", "172.31.255.1", "192.168.0.1", "127.0.0.1", "169.254.3.4", "224.0.0.5", "100.64.0.1", "8.8.8.8")]
    for old in addresses:
        new = IPv4Address(pii.surrogate("ip", str(old), 0, b"k"))
        assert pii.network(old) == pii.network(new)
        if pii.network(old):
            assert all(getattr(old, k) == getattr(new, k) for k in kinds)
        else:
            assert not (new.is_loopback or new.is_multicast or new.is_link_local or new in pii.LARGE_PRIVATE)


@pytest.mark.parametrize("address", ["2001:db8:85a3::8a2e:370:7334", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "FE80:0:0:0:202:B3FF:FE1E:8329", "2a02:8109:1::"])
def test_ipv6(address):
    assert found(f"from {address}, then") == [("ipv6", address)]
    form = pii.normal_form("ipv6", address)
    for attempt in (0, 1, 2, pii.CROWDED, 3 * pii.CROWDED):
        new = pii.surrogate("ipv6", form, attempt, b"k")
        text = pii.written("ipv6", address, new)
        assert IPv6Address(text).exploded == new and new[:4] == form[:4]
        if attempt < pii.CROWDED:
            assert [bool(int(g, 16)) for g in new.split(":")] == [bool(int(g, 16)) for g in form.split(":")]
            assert len(text) == len(address)
    assert pii.normal_form("ipv6", "2001:DB8:85A3:0:0:8a2e:370:7334") == pii.normal_form("ipv6", "2001:db8:85a3::8a2e:370:7334")


@pytest.mark.parametrize("clean", ["at 12:30:45", "std::vec::a1", "a::b", "00:1a:2b:3c:4d:5e", "1:2:3:4:5:6:7:8:9", "ab::cd::1", "1.2.3 and 10.20.30.40.50", "0.123 456 7890"])
def test_not_an_entity(clean):
    assert found(clean) == []


@pytest.mark.parametrize("phone", ["555.123.4567", "020 7946 0958", "0171-555-1234", "+49 30 5551234"])
def test_phones(phone):
    (kind, mention), = found(f"call {phone}.")
    assert (kind, mention) == ("phone", phone)
    new = pii.written("phone", phone, pii.surrogate("phone", pii.normal_form("phone", phone), 0, b"k"))
    assert new != phone and [c.isdigit() for c in new] == [c.isdigit() for c in phone]


def test_mail_keeps_its_case():
    form = pii.normal_form("email", "Jo.Smith@Corp.Example.COM")
    new = pii.written("email", "Jo.Smith@Corp.Example.COM", pii.surrogate("email", form, 0, b"k"))
    assert [c.isupper() for c in new] == [c.isupper() for c in "Jo.Smith@Corp.Example.COM"] and "Smith" not in new


def test_mentions_in_long_texts():
    text = "Mr. John Smith met Smith and 10.0.0.7. " * 4000
    got = pii.entities(text)
    assert len(got) == 4 * 4000 and all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_same_entities_same_surrogates_in_any_partitioning(spark):
    texts = [f"Mail Jo{i % 40}@x{i % 7}.org, call 555.{100 + i % 50}.4567 or 555-{100 + i % 50}-4567 from 172.16.0.{i % 90}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.text for r in pii.replaced(df.repartition(7), "key").collect()}
    assert got == {r.doc_id: r.text for r in pii.replaced(df.coalesce(1), "key").collect()}
    # Every mention, one by one: equal forms have equal surrogates, different forms different ones.
    new_of = {}
    for i, t in enumerate(texts):
        old, new = pii.entities(t), pii.entities(got[i])
        assert [e[2] for e in old] == [e[2] for e in new] and len(old) == 4
        for o, n in zip(old, new):
            assert new_of.setdefault(o[2:], n[3]) == n[3] != o[3]
    assert len(set(new_of.values())) == len(new_of) and not {f for _, f in new_of} & set(new_of.values())
