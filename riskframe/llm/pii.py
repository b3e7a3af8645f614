"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Four base kinds (``email``, ``ip``, ``card``, ``phone``) are fixed: the leftmost matches of each
pattern that do not overlap; one that fails its check is dropped and not tried again at a later start.
Cards pass Luhn. Base spans always stay. Further candidates (bank accounts by mod-97, card numbers
inside longer runs of numbers, social security numbers, telephone numbers without a country
code) start from a prior score. A passed checksum adds to it, a failed one drops the candidate; words of
the kind within ``NEAR`` characters add to it, words of another meaning subtract. A candidate
counts from ``THRESHOLD`` on, where it overlaps no base span and no better candidate.

The patterns are searched in time linear in the text: a local part is looked for backwards from
its ``@``, and no run of digits is entered in its middle. Offsets count code points, ends are exclusive.

Null text counts as empty and has no spans, like a text without digits and ``@``. Texts are read whole,
whatever their length; repeated rows are searched each by themselves, ties at one start are ordered as
the kinds are listed. An empty table gives none. Only the id and text columns are read, so other columns of any
name are harmless.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import map_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
THRESHOLD = 0.5
NEAR = 40

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits whose first digit does not begin one.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile("[0-9@]")
NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    """Every second digit from the right is doubled, nines cast out; the sum must end in 0."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) << (i & 1)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The first four characters go last, letters become 10 to 35; the remainder by 97 must be 1."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def octets(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in text.split("."))


def digits_of(text: str) -> str:
    return NOT_DIGIT.sub("", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        local = len(before) - len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
        low = domain.end() if domain else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base kinds, by start and then as the kinds are listed."""
    if not ANY.search(text):
        return []
    found = [(a, b, "email") for a, b in emails(text)]
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if octets(m[0])]
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= 14:
            digits = digits_of(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# Lengths of bank account numbers by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


@dataclass(frozen=True)
class Recogniser:
    """A candidate pattern, its check (None: there is none to pass), and the words that speak for or against it."""

    kind: str
    pattern: re.Pattern
    prior: float
    check: Callable[[str], bool] | None
    supports: re.Pattern
    opposes: re.Pattern
    #: What a passed check and the words add (or take away).
    passed: float = 0.3
    words: float = 0.3


def _words(*words: str) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(words) + r")\b", re.IGNORECASE)


def _valid_ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _local_number(text: str) -> bool:
    return 9 <= len(digits_of(text)) <= 11


OTHER_NUMBERS = _words("order", "invoice", "tracking", "isbn", "serial", "version", "checksum", "bestellnummer", "rechnung")
RECOGNISERS = (
    # A card set off from its neighbours, where the base run was longer or had 13 digits.
    Recogniser(
        "card",
        re.compile(r"(?<![0-9])(?=[3-6])(?:[0-9]{13,19}|[0-9]{4}(?:([ -])[0-9]{4}(?:\1[0-9]{4}){2}))(?![0-9])"),
        0.3,
        lambda text: luhn(digits_of(text)),
        _words("card", "visa", "mastercard", "amex", "credit", "karte", "kreditkarte", "carte", "tarjeta"),
        OTHER_NUMBERS,
    ),
    Recogniser(
        "ssn",
        re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
        0.1,
        _valid_ssn,
        _words("ssn", "social security", "taxpayer", "tin"),
        OTHER_NUMBERS,
        passed=0.2,
    ),
    Recogniser(
        "phone",
        re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9.-])"),
        0.1,
        _local_number,
        _words("tel", "phone", "telephone", "mobile", "cell", "call", "fax", "telefon", "téléphone", "teléfono", "móvil", "handy"),
        OTHER_NUMBERS,
        passed=0.2,
    ),
)
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
IBAN_NEXT = re.compile(r" ?([A-Z0-9])")
IBAN_WORDS = _words("iban", "account", "bank", "konto", "bankverbindung", "compte", "cuenta")


def ibans(text: str) -> Iterator[tuple[int, int, bool]]:
    """``(start, end, confirmed)`` of runs that have the length their country prescribes."""
    for m in IBAN_START.finditer(text):
        wanted = IBAN_LENGTH.get(m[0][:2], 0)
        account, end = m[0], m.end()
        while len(account) < wanted and (more := IBAN_NEXT.match(text, end)):
            account += more[1]
            end = more.end()
        if wanted and len(account) == wanted and not text[end : end + 1].isalnum():
            yield m.start(), end, mod97(account)


def nearby(text: str, start: int, end: int) -> str:
    return f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}"


def candidates(text: str) -> Iterator[tuple[float, int, int, str]]:
    """``(score, start, end, kind)`` of what is proposed beside the base spans."""
    for start, end, confirmed in ibans(text):
        if confirmed:
            around = nearby(text, start, end)
            yield 0.7 + 0.3 * bool(IBAN_WORDS.search(around)), start, end, "iban"
    for r in RECOGNISERS:
        for m in r.pattern.finditer(text):
            if r.check and not r.check(m[0]):
                continue
            around = nearby(text, m.start(), m.end())
            score = r.prior + r.passed * (r.check is not None) + r.words * bool(r.supports.search(around))
            yield score - r.words * bool(r.opposes.search(around)), m.start(), m.end(), r.kind


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float
    base: bool


def find(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of a text, by start and then as the kinds are listed."""
    if not ANY.search(text):
        return []
    spans = [Span(kind, a, b, 1.0, True) for a, b, kind in base_spans(text)]
    taken = [(s.start, s.end) for s in spans]
    # Best first. Only candidates are compared one by one, and only those that reach the threshold.
    strong = sorted((c for c in candidates(text) if c[0] >= threshold), key=lambda c: (-c[0], c[1], c[2]))
    if strong:
        free = Taken(taken)
        for score, a, b, kind in strong:
            if free.add(a, b):
                spans.append(Span(kind, a, b, round(score, 3), False))
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


class Taken:
    """Which characters are taken, one block of positions at a time."""

    BLOCK = 64

    def __init__(self, spans: list[tuple[int, int]]):
        self.blocks: dict[int, list[tuple[int, int]]] = {}
        for a, b in spans:
            self._put(a, b)

    def _put(self, a: int, b: int) -> None:
        for k in range(a // self.BLOCK, (b - 1) // self.BLOCK + 1):
            self.blocks.setdefault(k, []).append((a, b))

    def add(self, a: int, b: int) -> bool:
        """Take ``a`` to ``b`` unless some of it is taken."""
        for k in range(a // self.BLOCK, (b - 1) // self.BLOCK + 1):
            if any(x < b and a < y for x, y in self.blocks.get(k, ())):
                return False
        self._put(a, b)
        return True


SPAN = pa.struct(
    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("score", pa.float64()), ("base", pa.bool_())]
)


def detect(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``(key, spans)``; a span has kind, start, end, text, score and whether it is a base one."""
    rows = docs.select(F.col(key).alias("key"), "text")

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch.column("text").to_pylist():
            spans = find(text, threshold) if text else []
            out.append([{**vars(s), "text": text[s.start : s.end]} for s in spans])
        return {"key": batch.column("key"), "spans": pa.array(out, pa.list_(SPAN))}

    kind = rows.schema["key"].dataType.simpleString()
    span = "struct<kind:string,start:bigint,end:bigint,text:string,score:double,base:boolean>"
    return map_batches(rows, run, f"key {kind}, spans array<{span}>").withColumnRenamed("key", key)


def written(spans: str | Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", parts)


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans written out, beside the key."""
    base = F.filter("spans", lambda s: s["base"])
    counts = {f"n_{k}": _count(base, k) for k in BASE_KINDS}
    return found.withColumns(
        counts | {"base_sha256": F.sha2(written(base), 256), "spans": written("spans")}
    )
