"""Personal data behind disguises, at source offsets (operator 7)."""

from __future__ import annotations

import re
import unicodedata
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, whole_texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins, so runs are not tried again from inside
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NON_DIGIT = re.compile(r"[^0-9]")

# Letters of other scripts that look like Latin ones, marks that stand for others, and signs without width.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "І": "I", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "γ": "y", "υ": "u", "ω": "w", "η": "n", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ј": "J", "Ү": "Y", "ү": "y", "ӏ": "l", "Ӏ": "I", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ƽ": "s", "ʟ": "l", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Տ": "S", "Օ": "O", "Ս": "U", "Լ": "L",
    "ı": "i", "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-",
}
NO_WIDTH = "­​‌‍⁠﻿"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
# Digits in French, German and Spanish. As some of these words mean something else ("un", "acht", "dos"), they
# count in runs of two or more only.
OTHER_DIGIT_WORDS = {
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


def _plain_form(c: str) -> str | None:
    """The ASCII sign that ``c`` stands for ('' if it has no width), or None if it stands for itself."""
    if c in NO_WIDTH:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    flat = unicodedata.normalize("NFKC", c)
    if len(flat) == 1 and flat.isascii() and flat != c:
        return flat
    digit = unicodedata.decimal(c, None)
    return None if digit is None else str(digit)


_forms: dict[str, str | None] = {chr(i): None for i in range(128)}
_WORDS = "|".join(DIGIT_WORDS)
_ALL_WORDS = "|".join([*DIGIT_WORDS, *OTHER_DIGIT_WORDS])
_DOTS = "dot|point|punkt|punto"
#: What one step of the transducer reads, in lower-case text: an entity, a bracketed or a spaced "at" or "dot", or a run of
#: spelled digits. Each begins with a sign that few places have, and white space is read from its first sign on and never
#: twice, so the search stays linear.
_DISGUISE = re.compile(
    r"(?=[\s&\[({<])(?:&(?:(?P<at1>#0*+64|#x0*+40|commat)|(?P<dot1>#0*+46|#x0*+2e|period));"
    rf"|(?<!\s)\s*+[\[({{<]\s*+(?:(?P<at2>at|@|arobase|arroba)|(?P<dot2>{_DOTS}|\.))\s*+[\])}}>]\s*+"
    rf"|(?<=[a-z0-9])\s++(?:(?P<at3>at\s++(?=[a-z0-9-]++(?:\s++(?:dot|punkt|punto)\s|\s*+[\[({{<]\s*+(?:dot|punkt|punto)))|(?:arobase|arroba)\s++(?=[a-z0-9]))|(?P<dot3>(?:{_DOTS})\s++(?=[a-z0-9]))))"
    rf"|(?<!\w)(?=[{''.join(sorted({w[0] for w in _ALL_WORDS.split('|')}))}p])(?P<digits>(?:plus[\s-]++)?(?:{_ALL_WORDS})(?:[\s,-]++(?:{_ALL_WORDS})(?!\w))++|(?:plus[\s-]++)?(?:{_WORDS}))(?!\w)"
)
_BETWEEN = re.compile(r"[\s,-]+")
_DIGITS = {**DIGIT_WORDS, **OTHER_DIGIT_WORDS}


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def find_plain(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of undisguised identifiers, leftmost and without overlap in each kind, by kind and start."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NON_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NON_DIGIT.sub("", m[0])) <= 15:
                found.append((3, *m.span()))
    return found


def _lower(text: str) -> str:
    """Lower case of the same length: a dotted capital I, the only letter that becomes two, is an i."""
    return text.replace("\u0130", "i").lower()


def normalise(text: str) -> tuple[str, list[int], list[int]] | None:
    """The text without disguises, with the source start and end of each of its characters; None if it has none."""
    chars: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    changed = False
    if text.isascii():
        flat, where = text, None
    else:
        strange = {c for c in set(text) if (_forms[c] if c in _forms else _forms.setdefault(c, _plain_form(c))) is not None}
        if strange:
            changed = True
            kept = [(p, i) for i, c in enumerate(text) if (p := _forms[c] if c in strange else c)]
            flat, where = "".join(p for p, _ in kept), [i for _, i in kept]
        else:
            flat, where = text, None
    found = list(_DISGUISE.finditer(_lower(flat)))
    # spelled digits alone make nothing without an "@" or the four digits that the shortest of the other kinds has
    if all(m.lastgroup == "digits" for m in found) and "@" not in flat:
        digits = sum(len(re.split(_BETWEEN, m[0])) for m in found)
        if digits + sum(map(flat.count, "0123456789")) < 4:
            found = []
    if not found:
        return (flat, where, [i + 1 for i in where]) if changed else None
    done = 0
    for m in found:
        kind = m.lastgroup
        if kind == "digits":
            words = re.split(_BETWEEN, m[0])
            put = ("+" if words[0] == "plus" else "") + "".join(_DIGITS[w] for w in words if w != "plus")
        else:
            put = "@" if kind.startswith("at") else "."
        a, b = m.span()
        chars.append(flat[done:a])
        starts += range(done, a)
        ends += range(done + 1, a + 1)
        chars.append(put)
        starts += [a] * len(put)
        ends += [b] * len(put)
        done = b
    chars.append(flat[done:])
    starts += range(done, len(flat))
    ends += range(done + 1, len(flat) + 1)
    if where is not None:
        starts, ends = [where[i] for i in starts], [where[i - 1] + 1 for i in ends]
    return "".join(chars), starts, ends


def find_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the spans that only show after normalisation: those that lie in no base span of their kind."""
    base = find_plain(text)
    plain = normalise(text)
    if plain is None:
        return base, []
    flat, starts, ends = plain
    added = []
    for kind, a, b in find_plain(flat):
        start, end = starts[a], ends[b - 1]
        if not any(k == kind and s <= start and end <= e for k, s, e in base):
            added.append((kind, start, end))
    return base, added


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def redact(text: str) -> str:
    """The text with each span, base or added, replaced by its kind in angle brackets; overlapping spans become one."""
    base, added = find_spans(text)
    if not base and not added:
        return text
    out, done = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in base + added):
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind].upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, all spans, number of added ones, for every text.

    A transducer writes look-alike letters and digits of other scripts, spelled digits and "at"/"dot" disguises in plain
    form, keeping for each sign written where in the source it came from; detectors run over source and plain form, and
    spans of the latter are mapped back. Offsets are code points of the source, ends exclusive.

    Null and empty texts have no spans; a null key stays null; repeated rows are each searched; extra columns are ignored.
    """

    def rows_of(columns):
        rows = []
        for key, text in zip(*columns):
            base, added = find_spans(text)
            n = [0] * 4
            for s in base:
                n[s[0]] += 1
            rows.append((key, *n, sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added)))
        return rows

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_texts(whole_texts(docs), rows_of, schema, "doc_id", "text")


def redact_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``redact`` applied to text (null stays null) and n_chars, if there, counted anew; other columns stay."""
    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redact(t))

    text = docs.columns.index("text")
    out = docs.select(*[cleaned(F.col("text")).alias("text") if i == text else F.col(c) for i, c in enumerate(docs.columns)])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
