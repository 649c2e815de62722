"""Personal data replaced by surrogates that keep type, format and identity.

Three steps. Entities are detected in each text and written with a normal form (digits of a phone
number, lower-cased mail address, a name without its title). The table of distinct normal forms
gets surrogates from a keyed hash: same type, length, country code or network, gender and script, and
check digits that hold where they did; forms whose surrogate collides with another surrogate or with a real form are drawn
again until none does, so distinct entities stay distinct. Then every mention is written in the
layout it had, so equal entities have equal surrogates in every text.

Only texts that can hold an entity, told by a built-in filter, reach Python or a shuffle.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from ipaddress import AddressValueError, IPv4Address, IPv4Network, IPv6Address

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import bounded_batches
from flowlab.sources.staging import stage

# Forms of address by gender.
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof"],
}
GENDER = {t: g for g, names in TITLES.items() for t in names}
SYLLABLES = {
    "latin": ("b d f g k l m n p r s t v".split(), "a e i o u".split(), {"m": "on er an is".split(), "f": "a ia ine elle".split(), "n": "ay ex y".split()}),
    "cyrillic": ("б в г д к л м н п р с т".split(), "а е и о у".split(), {"m": "ов ин ей ан".split(), "f": "ова ина ая ия".split(), "n": "ко ых".split()}),
    "greek": ("β γ δ κ λ μ ν π ρ τ".split(), "α ε η ι ο".split(), {"m": "ος ης ας".split(), "f": "α η ια".split(), "n": "ου".split()}),
}
# Particles stay as they are; what follows the first is family name.
PARTICLES = set("van von der den de del della di da das do dos du la le ter ten te zu zur zum bin ibn al el af av y e".split())
# Unbroken letters, apostrophes inside; a possessive ending is no part.
_PIECE = r"[^\W\d_]+(?:['’](?!s\b)[^\W\d_]+)*"
_NAME = rf"(?:(?:[dl]['’]|(?:al|el)[-‐‑])?(?=[^\W\d_a-zа-яα-ω]){_PIECE}(?:[-‐‑]{_PIECE})*)"
_NAMES = rf"(?:{_NAME}(?:(?<=\b[^\W\d_])\.(?= {_NAME}))?|(?:{'|'.join(sorted(PARTICLES))})(?=(?: (?:{'|'.join(sorted(PARTICLES))}))* {_NAME}))"
PATTERNS = {
    "email": r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?(?P<secret_value>[A-Za-z0-9_+/=.-]{8,})|\b[0-9a-fA-F]{32,}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ipv6": r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,7}(?:::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)?(?![\w:])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"\+[0-9]{1,3}[ -]?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ -]?[0-9]{2,4}){2,3}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])|(?<![0-9.-])[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![0-9-]|\.[0-9])|(?<![0-9.,-])(?<![0-9] )0[0-9]{2,4}[ -][0-9]{3,4}[ -]?[0-9]{3,4}(?![ -]?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "person": rf"\b(?P<title>{'|'.join(GENDER)})\b\.? (?P<names>{_NAMES}(?: {_NAMES})*)",
}
# IPv4 networks with a meaning of their own; all other addresses are public.
NETWORKS = [
    IPv4Network(n)
    for n in (
        "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
        "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4",
    )
]
LARGE_PRIVATE = IPv4Network("10.0.0.0/8")
FINDER = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS.items()))
# Where a kind's forms fill its space: from this attempt on an address may leave its network class,
# and from four times as many on a surrogate may be some other entity's real form.
CROWDED = 16
# What any entity needs, in the built-in engine's dialect: a character that all but names have,
# or a form of address. One class of first letters keeps the scan short.
MAY_HOLD = rf"[@0-9=:]|[{''.join(sorted({t[0] for t in GENDER}))}](?:{'|'.join(sorted({t[1:] for t in GENDER}))})\b"


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) without overlaps, in order.

    Each part of a name found with a title, given or family, is found again in the same text wherever
    it stands capitalised or in capitals; initials and particles are not.
    """
    out, known = [], {}
    for m in FINDER.finditer(text):
        kind = m.lastgroup if m.lastgroup in PATTERNS else next(k for k in PATTERNS if m.group(k))
        start, end = m.span()
        if kind == "secret" and m.group("secret_value"):
            start, end = m.span("secret_value")
        if kind == "person":
            gender = GENDER[m.group("title")]
            for start, end, part in name_parts(m.group("names")):
                name = m.group("names")[start:end].replace("’", "'")
                form = f"{part} {gender if part == 'given' else _form_gender(name, gender)} {name.casefold()}"
                out.append((m.start("names") + start, m.start("names") + end, "person", form))
                if len(name) > 1:
                    for layout in (name, name.upper()):
                        known.setdefault(layout, form)
            continue
        if kind == "ipv6" and not is_ipv6(text[start:end]):
            continue
        out.append((start, end, kind, normal_form(kind, text[start:end])))
    if known:
        # In order and without overlaps, so the last one that starts before an end decides.
        starts, ends = [e[0] for e in out], [e[1] for e in out]
        layouts = (re.escape(n).replace("'", "['’]") for n in sorted(known, key=len, reverse=True))
        again = re.compile(r"\b(?:" + "|".join(layouts) + r")\b")
        for m in again.finditer(text):
            before = bisect_right(starts, m.end() - 1)
            if not before or ends[before - 1] <= m.start():
                out.append((m.start(), m.end(), "person", known[m.group().replace("’", "'")]))
    return sorted(out)


def name_parts(names: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, given or family) of each part of a full name. The last name and all that follow a
    particle are family names; names with hyphens are several parts."""
    words = list(re.finditer(r"[^ ]+", names))
    family = False
    for i, w in enumerate(words):
        last = i == len(words) - 1
        if w.group().casefold() in PARTICLES and not last:
            family = family or i > 0 or w.group().islower()
            continue
        for p in re.finditer(_PIECE, w.group()):
            if not (p.group().islower() and p.group() in PARTICLES):
                yield w.start() + p.start(), w.start() + p.end(), "family" if family or last else "given"


def _form_gender(name: str, gender: str) -> str:
    """Family names change with gender in Cyrillic and Greek only."""
    return gender if script(name) != "latin" else "n"


def script(name: str) -> str:
    first = name[:1].lower()
    return "cyrillic" if "а" <= first <= "я" or first == "ё" else "greek" if "ά" <= first <= "ώ" else "latin"


def normal_form(kind: str, mention: str) -> str:
    if kind == "phone":
        country = re.match(r"\+([0-9]{1,3})(?=[ (-])", mention)
        digits = re.sub(r"[^0-9]", "", mention)
        return f"{country.group(1) if country else ''}|{digits[len(country.group(1)) if country else 0:]}"
    if kind in ("card", "ssn"):
        return re.sub(r"[^0-9]", "", mention)
    if kind == "iban":
        return mention.replace(" ", "")
    if kind == "ipv6":
        return IPv6Address(mention).exploded
    return mention.lower() if kind in ("email", "ip") else mention


def is_ipv6(text: str) -> bool:
    """Three groups at least and a digit, so that scopes such as a::b are none."""
    try:
        IPv6Address(text)
    except AddressValueError:
        return False
    return any(c.isdigit() for c in text) and sum(bool(g) for g in text.split(":")) >= 3


def network(address: IPv4Address) -> IPv4Network | None:
    return next((n for n in NETWORKS if address in n), None)


def iban_remainder(form: str) -> int:
    """1 for a valid IBAN."""
    return int("".join(str(int(c, 36)) for c in form[4:] + form[:4])) % 97


def _stream(key: bytes, *parts: str) -> Iterator[int]:
    """Keyed bytes without end."""
    n = 0
    while True:
        yield from hmac.new(key, "\x00".join((*parts, str(n))).encode(), hashlib.sha256).digest()
        n += 1


def _letters(text: str, stream: Iterator[int]) -> str:
    """Each letter and digit by another of its kind; hexadecimal text stays hexadecimal."""
    hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) and re.search(r"[a-fA-F]", text)
    out = []
    for c in text:
        if c.isdigit():
            out.append("0123456789"[next(stream) % 10])
        elif c.isalpha():
            pool = "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"
            new = pool[next(stream) % len(pool)]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def surrogate(kind: str, form: str, attempt: int, key: bytes) -> str:
    """A normal form of the same type and shape, another one for each attempt."""
    s = _stream(key, kind, form, str(attempt))
    if kind == "phone":
        country, digits = form.split("|", 1)
        return f"{country}|{_letters(digits, s)}"
    if kind == "card":
        new = _letters(form, s)
        return next((c for d in "0123456789" if luhn(c := new[:-1] + d)), new) if luhn(form) else new
    if kind == "ip":
        old = network(IPv4Address(".".join(str(int(part)) for part in form.split("."))))
        # Private networks stay private; the small ones overflow into the large one first.
        if old and attempt >= CROWDED:
            old = LARGE_PRIVATE if old.is_private and attempt < 2 * CROWDED else None
        while True:
            new = IPv4Address(bytes(next(s) for _ in range(4)))
            if old:
                new = old[int(new) % old.num_addresses]
            if network(new) == old:
                return str(new)
    if kind == "ipv6":
        # The first group tells the network; groups that are zero stay zero, the others keep their length.
        first, *groups = form.split(":")
        for i, g in enumerate(groups):
            length = len(g.lstrip("0")) if attempt < CROWDED else 4 if int(g, 16) or attempt >= 2 * CROWDED else 0
            low = 16 ** (length - 1) if length else 0
            drawn = next(s) * 256 + next(s)
            groups[i] = f"{low + drawn % (15 * low) if length else 0:04x}"
        return ":".join([first, *groups])
    if kind == "email":
        local, domain = form.rsplit("@", 1)
        names, top = domain.rsplit(".", 1)
        return f"{_letters(local, s)}@{_letters(names, s)}.{top}"
    if kind == "iban":
        body = _letters(form[4:], s)
        if iban_remainder(form) != 1:
            return form[:2] + _letters(form[2:4], s) + body
        return f"{form[:2]}{98 - iban_remainder(form[:2] + '00' + body):02d}{body}"
    if kind == "person":
        part, gender, name = form.split(" ", 2)
        starts, vowels, ends = SYLLABLES[script(name)]
        count = 1 + next(s) % 2 + attempt // 8
        body = "".join(starts[next(s) % len(starts)] + vowels[next(s) % len(vowels)] for _ in range(count))
        return f"{part} {gender} {body}{starts[next(s) % len(starts)]}{ends[gender][next(s) % len(ends[gender])]}"
    return _letters(form, s)


def written(kind: str, mention: str, new: str) -> str:
    """A surrogate's normal form in the layout of a mention."""
    if kind in ("phone", "card", "ssn", "iban"):
        fresh = iter(new.replace("|", ""))
        return "".join(next(fresh) if c.isalnum() else c for c in mention)
    if kind == "person":
        name = new.split(" ", 2)[2]
        return name.upper() if len(mention) > 1 and mention.isupper() else name.capitalize()
    if kind == "ipv6":
        groups = mention.split(":")
        padded = all(len(g) == 4 for g in groups)
        short = IPv6Address(new).compressed if "::" in mention else ":".join(f"{int(g, 16):x}" for g in new.split(":"))
        new = new if padded else short
        return new.upper() if mention == mention.upper() else new
    if kind == "email" and len(new) == len(mention):
        return "".join(n.upper() if m.isupper() else n for n, m in zip(new, mention))
    return new


def _named(key: str | Column) -> Column:
    """A key of any type as text; null is a key of its own."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def detected(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_key, text_hash, start, end, kind, form) of every entity of every distinct row, staged."""
    bounded_batches(df.sparkSession)
    rows = df.where(F.col(text).rlike(MAY_HOLD))
    rows = rows.select(_named(key).alias("row_key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    names = ["row_key", "text_hash", "start", "end", "kind", "form"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *e) for i, t in enumerate(b.column("text").to_pylist()) for e in entities(t)]
            at = pa.array([f[0] for f in found], pa.int64())
            parts = [pa.array([f[j] for f in found], kind) for j, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()), (4, pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("row_key").take(at), b.column("text_hash").take(at), *parts], names)

    schema = "row_key string, text_hash bigint, start bigint, end bigint, kind string, form string"
    return stage(rows.mapInArrow(find, schema).distinct(), "entities")


def mapped(found: DataFrame, secret: str) -> DataFrame:
    """(kind, form, new): a surrogate for each distinct form, no two alike and none a real form.

    Where real forms leave hardly any room (4 * CROWDED draws without success) a surrogate may be
    another entity's real form, never its own; surrogates stay distinct, so the rounds end.
    """
    key = secret.encode()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("kind", "form", "attempt")))
            new = pa.array([surrogate(k, f, a, key) for k, f, a in rows], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("form"), b.column("attempt"), new], ["kind", "form", "attempt", "new"])

    schema = "kind string, form string, attempt int, new string"
    forms = stage(found.select("kind", "form").distinct(), "forms")
    real = forms.select("kind", F.col("form").alias("new"))
    drawn = stage(forms.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema), "surrogates")
    while True:
        # The smallest form keeps a contested surrogate, unless it is somebody's real form.
        owners = drawn.groupBy("kind", "new").agg(F.min("form").alias("owner"))
        owners = owners.join(real.withColumn("is_real", F.lit(True)), ["kind", "new"], "left")
        taken = F.col("is_real").isNotNull() & (F.col("attempt") < 4 * CROWDED)
        again = taken | (F.col("owner") != F.col("form")) | (F.col("new") == F.col("form"))
        marked = drawn.join(owners, ["kind", "new"]).select("kind", "form", "attempt", "new", again.alias("again"))
        marked = stage(marked, "surrogates")
        if marked.where("again").isEmpty():
            return marked.select("kind", "form", "new")
        retry = marked.where("again").select("kind", "form", (F.col("attempt") + 1).alias("attempt"))
        drawn = marked.where("not again").drop("again").unionByName(retry.mapInArrow(draw, schema))
        drawn = stage(drawn, "surrogates")


def replaced(df: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with surrogates in `text`, and `n_entities`; all other columns are kept.

    Texts without an entity are returned as they are; null stays null with 0 entities. Repeated
    rows are replaced alike; an empty table gives an empty one. The same secret gives the same
    surrogates for the same set of entities.
    """
    found = detected(df, key, text)
    edits = found.join(mapped(found, secret), ["kind", "form"])
    edits = edits.groupBy("row_key", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind", "new"))).alias("__pii_edits")
    ).withColumnsRenamed({"row_key": "__pii_key", "text_hash": "__pii_hash"})
    may = F.coalesce(F.col(text).rlike(MAY_HOLD), F.lit(False))
    names = df.columns
    same = df.where(~may).withColumn("n_entities", F.lit(0))
    some = df.where(may).withColumns({"__pii_key": _named(key), "__pii_hash": F.xxhash64(text)})
    some = some.join(edits, ["__pii_key", "__pii_hash"], "left").withColumn("n_entities", F.coalesce(F.size("__pii_edits"), F.lit(0)))
    some = some.select(*names, "n_entities", F.to_json("__pii_edits").alias("__pii_edits"))
    at = names.index(text)
    schema = some.drop("__pii_edits").schema

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, edit in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                parts, end = [], 0
                for e in json.loads(edit) if edit else []:
                    parts += [t[end : e["start"]], written(e["kind"], t[e["start"] : e["end"]], e["new"])]
                    end = e["end"]
                texts.append("".join([*parts, t[end:]]))
            columns = b.columns[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    bounded_batches(df.sparkSession)
    return some.mapInArrow(write, schema).unionByName(same.select(*names, "n_entities"))
