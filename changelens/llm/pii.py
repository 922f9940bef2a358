"""Personal data: patterns propose spans, checksums confirm them, context
words nearby change their score.

Patterns are matched over whole texts from left to right without overlap within
a kind, in time linear in the text.  A text without a sign that a kind cannot
do without (``@``, ``+``, a digit) is not searched for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
#: The method's own kinds, listed after the base kinds.
ADDED_KINDS = ("iban", "ssn")

#: Lengths of account numbers by country, as registered.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
    "YE": 30,
}
#: Words within ``context_chars`` before or after a span that speak for its kind.
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
#: Score of a span that its checksum or form confirms, before its context.
CONFIRMED = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.ASCII)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")


@dataclass(frozen=True)
class PiiParams:
    """Spans of the added kinds below ``min_score`` are left out; those of the
    base kinds always stay."""

    context_chars: int = 40
    context_bonus: float = 0.2
    min_score: float = 0.5


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod_97(account: str) -> bool:
    """The account number with its country and check digits moved to the end,
    letters as numbers from 10, leaves 1 over by 97."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each ``@``: whether a match begins in the run of local
    characters before it depends on nothing but what follows it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _iban_end(text: str, start: int) -> int | None:
    """End of the account number that begins here, if one does: as many letters
    and digits as its country has, in groups of four or without a space."""
    length = IBAN_LENGTHS.get(text[start : start + 2])
    if length is None:
        return None
    compact, at = "", start
    while len(compact) < length:
        if compact and len(compact) % 4 == 0 and text[at : at + 1] == " ":
            at += 1
        c = text[at : at + 1]
        if not ("0" <= c <= "9" or "A" <= c <= "Z"):
            return None
        compact += c
        at += 1
    after = text[at : at + 1]
    return at if mod_97(compact) and not (after.isascii() and after.isalnum()) else None


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Tried at each start; after an account from its end on."""
    done = 0
    for m in _IBAN_START.finditer(text):
        if m.start() >= done and (end := _iban_end(text, m.start())):
            yield m.start(), end
            done = end


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans by kind, ``(kind, start, end)`` in code points."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    if not _DIGIT.search(text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = digits_of(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in ibans(text):
        yield "iban", start, end
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9":
            yield "ssn", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int, params: PiiParams) -> float:
    near = text[max(0, start - params.context_chars) : start] + " " + text[end : end + params.context_chars]
    words = set(re.findall(r"[a-z]+", near.lower()))
    return round(CONFIRMED[kind] + params.context_bonus * any(w in words for w in CONTEXT[kind]), 6)


def spans_of(text: str | None, params: PiiParams = PiiParams()) -> list[tuple[str, int, int, float]]:
    """All spans of a text, by kind and start, with their scores."""
    out = []
    for kind, start, end in proposed(text or ""):
        value = score(text, kind, start, end, params)
        if kind in BASE_KINDS or value >= params.min_score:
            out.append((kind, start, end, value))
    return out


SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"
_ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: PiiParams = PiiParams()) -> DataFrame:
    """``doc_id`` and ``spans``: kind, start, end (code points, end exclusive)
    and score, by kind in the order of the kinds, then by start.

    Null and empty texts have no spans; a null id stays null; repeated rows are
    searched alike; other columns are not read.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in spans_of(t.as_py(), params)]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW_SPANS)], ["doc_id", "spans"])

    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = two.schema["doc_id"].dataType.simpleString()
    return two.mapInArrow(search, f"doc_id {id_type}, spans {SPANS}")


def mask(docs: DataFrame, text_col: str = "text", params: PiiParams = PiiParams()) -> DataFrame:
    """The rows with each span's text replaced by its kind in brackets.

    Of overlapping spans the first, then the longest, is replaced.
    """

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                parts, done = [], 0
                for kind, start, end, _ in sorted(spans_of(text, params), key=lambda s: (s[1], -s[2])):
                    if start >= done:
                        parts += [text[done:start], f"[{kind}]"]
                        done = end
                texts.append(None if text is None else "".join(parts) + text[done:])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], batch.schema.names)

    others = [c for c in docs.columns if c != text_col]
    last = docs.select(*others, F.col(text_col).cast("string").alias(text_col))
    return last.mapInArrow(replace, last.schema).select(*docs.columns)
