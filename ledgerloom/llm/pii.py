"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Four base kinds follow fixed patterns; each is found leftmost first and without overlaps within its kind:
e-mail addresses, IPv4 addresses (parts to 255), cards (14 to 19 digits, Luhn) and telephone numbers (a plus and 10 to
15 digits). A match that fails its check is dropped and not tried again from another place. All base spans are kept, whatever their score.

More kinds are proposed more widely, and so need evidence; a span counts from a score of ``THRESHOLD``:

* ``iban``: a country's code, two check digits and 11 to 30 characters, of the country's length where it is known, confirmed by mod 97;
* ``bank_card``: 12 or 13 digits that pass Luhn, with a word like "card" nearby;
* ``local_phone``: 7 to 15 digits in groups without a plus that don't begin with a date, with a word like "phone" nearby;
* ``tax_number``: three, two and four digits with hyphens, none of the groups all zeros; a word like "ssn" lifts it over the threshold.

A span of those that overlaps a base span, or one of a kind named before it, is left out. The score is the kind's own, plus ``CONFIRMED`` if a checksum holds, plus
``NEARBY`` if one of its words stands within ``REACH`` characters before or after it, less ``AGAINST`` if a word that speaks against it does.

Every step is linear in the text's length: runs are matched from their first character only.

Defined cases: null and empty texts hold nothing; texts of any length are read whole; repeated rows are judged each;
letters and digits of other scripts are no part of the patterns; other columns, whatever they are called, play no part; an empty table gives
an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import chunks

BASE = ("email", "ip", "card", "phone")
#: Kinds in the order in which spans of equal start stand.
KINDS = (*BASE, "iban", "bank_card", "local_phone", "tax_number")
#: Scores: what a checksum and a word nearby add, what a word against takes away, and from where a span counts.
CONFIRMED, NEARBY, AGAINST, THRESHOLD = 0.4, 0.3, 0.3, 0.7
#: Characters before and after a span in which words count.
REACH = 40
OWN = {"email": 0.9, "ip": 0.6, "card": 0.4, "phone": 0.8, "iban": 0.4, "bank_card": 0.1, "local_phone": 0.4, "tax_number": 0.5}
WORDS = {
    "email": ("mail", "contact", "address"),
    "ip": ("ip", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "bank_card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "tax_number": ("ssn", "social", "tax", "security"),
}
#: Words that make a number something else.
NOT_PERSONAL = ("isbn", "issn", "version", "invoice", "order", "sku", "serial", "example")
#: Lengths of the IBANs of some countries.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "SE": 24,
}

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,5}\)?(?:[ /.-][0-9]{2,8}){1,4}(?![0-9A-Za-z-])")
TAX = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
DATE = re.compile(r"(?:19|20)[0-9]{2}[/.-][0-9]{1,2}[/.-][0-9]{1,2}|[0-9]{1,2}[/.-][0-9]{1,2}[/.-](?:19|20)[0-9]{2}")
NO_DIGITS = re.compile(r"[^0-9]+")
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True, order=True)
class Span:
    start: int
    order: int
    end: int
    score: float = 0.0

    @property
    def kind(self) -> str:
        return KINDS[self.order]

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    """Whether the digits' Luhn sum is a multiple of ten."""
    back = [ord(d) - 48 for d in reversed(digits)]
    return (sum(back[::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number's check digits hold: its first four characters moved to the end, letters as 10 to 35, leave 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses: from each @, what may stand before it back to the address before, and a domain with a dot."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = len(text[free:at].rstrip(LOCAL)) + free
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = max(free, at)  # nothing before this @ can be part of a later address
        at = text.find("@", max(at + 1, free))


def small(part: str) -> bool:
    """Whether a run of digits is at most 255."""
    bare = part.lstrip("0")
    return len(bare) < 4 and int(bare or 0) < 256


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in ADDRESS.finditer(text):
        if all(map(small, m[0].split("."))):
            yield m.span()


def digit_runs(text: str) -> list[tuple[int, int, str]]:
    """Digits with single spaces or hyphens between them: start, end, digits."""
    return [(*m.span(), NO_DIGITS.sub("", m[0])) for m in CARD.finditer(text) if m.end() - m.start() > 1]


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= len(NO_DIGITS.sub("", m[0])) <= 15:
            yield m.span()


def account_numbers(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers: of the country's length if it is known, else all that stands there."""
    for m in IBAN.finditer(text):
        code, size = m[0].replace(" ", ""), IBAN_LENGTHS.get(m[0][:2])
        end = m.end()
        if size and len(code) > size:  # the words after it may look like a part of it
            kept = m[0]
            while len(kept.replace(" ", "")) > size:
                kept = kept[:-1]
            kept = kept.rstrip()
            if m[0][len(kept)] != " ":
                continue
            code, end = code[:size], m.start() + len(kept)
        if (not size or len(code) == size) and mod97(code):
            yield m.start(), end


def scored(text: str, kind: str, start: int, end: int, confirmed: bool) -> Span:
    near = {w.lower() for w in WORD.findall(text[max(0, start - REACH) : start] + " " + text[end : end + REACH])}
    score = OWN[kind] + CONFIRMED * confirmed + NEARBY * (not near.isdisjoint(WORDS[kind])) - AGAINST * (not near.isdisjoint(NOT_PERSONAL))
    return Span(start, KINDS.index(kind), end, round(min(1.0, max(0.0, score)), 4))


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by start and kind."""
    out: list[Span] = []
    if "@" in text:
        out += [scored(text, "email", *x, False) for x in emails(text)]
    out += [scored(text, "ip", *x, False) for x in addresses(text)]
    out += [scored(text, "card", a, b, True) for a, b, digits in digit_runs(text) if 14 <= len(digits) <= 19 and luhn(digits)]
    if "+" in text:
        out += [scored(text, "phone", *x, False) for x in phones(text)]
    return sorted(out)


def more_spans(text: str, taken: list[Span]) -> list[Span]:
    """Spans of the other kinds that score enough, none over another or over one of those ``taken``."""
    out: list[Span] = []
    proposed = [scored(text, "iban", *x, True) for x in account_numbers(text)]
    proposed += [scored(text, "bank_card", a, b, True) for a, b, digits in digit_runs(text) if len(digits) in (12, 13) and luhn(digits)]
    for m in LOCAL_PHONE.finditer(text):
        if 7 <= len(NO_DIGITS.sub("", m[0])) <= 15 and not DATE.match(m[0]):
            proposed.append(scored(text, "local_phone", *m.span(), False))
    for m in TAX.finditer(text):
        a, b, c = m[0].split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            proposed.append(scored(text, "tax_number", *m.span(), False))
    held: list[tuple[int, int]] = []  # disjoint, in order
    for a, b in sorted((s.start, s.end) for s in taken):
        if held and a < held[-1][1]:
            held[-1] = (held[-1][0], max(b, held[-1][1]))
        else:
            held.append((a, b))
    for span in sorted((s for s in proposed if s.score >= THRESHOLD), key=lambda s: (s.order, s.start)):
        at = bisect.bisect_left(held, (span.end, 0)) - 1  # the last that starts before the span ends
        if at < 0 or held[at][1] <= span.start:
            out.append(span)
            held.insert(at + 1, (span.start, span.end))
    return sorted(out)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of a text, in order."""
    base = base_spans(text or "")
    return base, sorted(base + more_spans(text or "", base))


def over_texts(docs: DataFrame, row: Callable[[int | None, str | None], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``row`` makes of each document's id and text: one pass, text by text."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in chunks(batches, "text"):
            made = [x for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in row(i, t)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), kinds, strict=True)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def find_private(docs: DataFrame) -> DataFrame:
    """Per document: how many spans of each base kind, their digest, all spans and their scores, joined by commas."""

    def row(doc_id: int | None, text: str | None) -> Iterator[tuple]:
        base, spans = find(text)
        counts = [sum(s.order == k for s in base) for k in range(len(BASE))]
        digest = hashlib.sha256(",".join(map(str, base)).encode()).hexdigest()
        yield (doc_id, *counts, digest, ",".join(map(str, spans)), ",".join(f"{s.score:g}" for s in spans))

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return over_texts(docs, row, f"doc_id long, {counts}, base_sha256 string, spans string, scores string")


def list_private(docs: DataFrame) -> DataFrame:
    """A row for each span: doc_id, kind, first, last + 1 character, what stands there, and the score."""

    def row(doc_id: int | None, text: str | None) -> Iterator[tuple]:
        for s in find(text)[1]:
            yield doc_id, s.kind, s.start, s.end, text[s.start : s.end], s.score

    return over_texts(docs, row, "doc_id long, kind string, start long, end long, found string, score double")


def mask_private(docs: DataFrame) -> DataFrame:
    """doc_id and text of each document with ``<kind>`` in the place of each span; of overlapping spans the first one's kind, over all of them."""

    def row(doc_id: int | None, text: str | None) -> Iterator[tuple]:
        out, at = [], 0
        for s in find(text)[1]:
            if s.start >= at:
                out += [text[at : s.start], f"<{s.kind}>"]
            at = max(at, s.end)
        yield doc_id, None if text is None else "".join([*out, text[at:]])

    return over_texts(docs, row, "doc_id long, text string")
