"""Personal data in texts, also where it is disguised: transducers that remember offsets.

Plain identifiers are found in the text as it is: e-mail addresses, IP addresses, payment cards, phone numbers. Then
a text that shows a sign of disguise is put on a *tape*: characters, each with the stretch of the source it stands for.
Transducers rewrite the tape one after another and carry the stretches along:

1. homoglyphs: look-alikes of other scripts, wide and styled forms, digits of any script, odd dashes and blanks become
   ASCII; characters without width go;
2. symbols: ``[at]``, ``(dot)``, ``_at_``, ``userATexample``, and dots spelled between digits;
3. spelled digits, in four languages, single, doubled or tripled, and ``plus`` before a number;
4. addresses spelled with bare words, ``name at example dot com``; these words are common in prose, so that the whole
   address must be there and end in a known domain.

The same detectors run on the tape, and what they find there is mapped back to the source. Found spans are added if a
transducer had a part in them and they do not overlap a plain span of their kind; an address may also take in a plain
one that is a part of it. Plain spans always stay.

Offsets are code points, ends exclusive. A null or empty text has no spans. Repeated rows are looked at one by one,
texts of any length as a whole; every pattern takes time in proportion to the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

SPANS = "array<struct<kind: string, first: long, last: long, source: string, normal: string, plain: boolean>>"

# Look-alikes of Latin letters in Cyrillic, Greek and Armenian, and signs for dot and at.
HOMOGLYPHS = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "օ": "o", "ս": "u", "հ": "h",
    "。": ".", "․": ".", "·": ".", "•": ".", "∙": ".", "⋅": ".", "٫": ".", "۔": ".",
}
# Names of digits in English, German, French and Spanish.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
TIMES = {"double": 2, "doppel": 2, "doble": 2, "triple": 3, "dreifach": 3}
# Top-level domains after which an address spelled in bare words is believed.
DOMAINS = ("com org net edu gov mil int info biz name io dev app de fr es it uk eu ch be nl pl pt ru se dk cz cn jp kr in au nz ca "
           "br mx ar us example test invalid").split()

_AT = "at|ät|arroba|arobase|arobas|klammeraffe"
_DOT = "dot|punkt|point|punto|period"
_LOCAL = "A-Za-z0-9._%+-"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+(?<=[0-9])")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern for whole addresses finds them, but from each @ to the left, so that long words cost no more."""
    end = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        low = max(end, text.rfind("@", end, at) + 1)
        start = low + len(text[low:at].rstrip(_LOCAL_LETTERS))
        if start < at:
            end = m.end()
            yield start, end


_LOCAL_LETTERS = "".join(c for c in map(chr, range(128)) if re.match(f"[{_LOCAL}]", c))


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def plain_spans(text: str) -> list[Span]:
    """Identifiers in the text as it is, by start and kind; per kind leftmost and without overlap."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[^0-9]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if m.end() - m.start() >= 3 and 10 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append(("phone", *m.span()))
    return in_order(found)


def in_order(spans: list) -> list:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Tape:
    """A text and, for each of its characters, the stretch of the source it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.first = np.arange(len(text))
        self.last = self.first + 1

    def rewrite(self, matches: Iterator[re.Match], put: Callable[[re.Match], list[tuple[int, int, str]]]) -> None:
        """Replace parts of each match; ``put`` gives them, in order, as (start, end, new text)."""
        parts, first, last, at = [], [], [], 0
        for m in matches:
            for a, b, new in put(m):
                if a < at:
                    continue
                parts += [self.text[at:a], new]
                first += [self.first[at:a], np.full(len(new), self.first[a])]
                last += [self.last[at:a], np.full(len(new), self.last[b - 1])]
                at = b
        if parts:
            self.text = "".join(parts) + self.text[at:]
            self.first = np.concatenate([*first, self.first[at:]])
            self.last = np.concatenate([*last, self.last[at:]])


class _Looks(dict):
    """The ASCII character that a character looks like, nothing for one without width, else itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        digit = unicodedata.decimal(c, None)
        folded = unicodedata.normalize("NFKC", c)
        if c in HOMOGLYPHS:
            out = HOMOGLYPHS[c]
        elif code < 128:
            out = c
        elif kind == "Cf":
            out = ""
        elif digit is not None:
            out = str(digit)
        elif kind == "Pd" or c == "−":
            out = "-"
        elif kind == "Zs":
            out = " "
        elif len(folded) == 1 and (folded.isascii() or folded in HOMOGLYPHS):
            out = HOMOGLYPHS.get(folded, folded)
        else:
            out = c
        self[code] = out
        return out


_LOOKS = _Looks()


def _unmask_homoglyphs(tape: Tape) -> None:
    if tape.text.isascii():
        return
    odd = [c for c in set(tape.text) if _LOOKS[ord(c)] != c]
    if odd:
        each = re.compile("[" + re.escape("".join(odd)) + "]+")
        # Look-alikes one by one, so that each keeps its own place.
        tape.rewrite(each.finditer(tape.text), lambda m: [
            (i, i + 1, _LOOKS[ord(c)]) for i, c in enumerate(m.group(), m.start())])


_MARKED = re.compile(rf"(?<!\s)\s*[\[({{<]\s*(?:({_AT}|@)|{_DOT}|\.)\s*[\])}}>]\s*", re.I)
_TOKEN = re.compile(rf"[{_LOCAL}]+")
_JOINED_AT = re.compile(r"(?<=[A-Za-z0-9])_at_(?=[A-Za-z0-9])|(?<=[a-z0-9])AT(?=[a-z0-9])")
_JOINED_DOT = re.compile(r"(?<=[A-Za-z0-9])_dot_(?=[A-Za-z0-9])|(?<=[a-z0-9])DOT(?=[a-z0-9])")
_DOT_OF_DIGITS = re.compile(rf"(?<=[0-9])\s+(?:{_DOT})\s+(?=[0-9])", re.I)


def _joined(token: re.Match) -> list[tuple[int, int, str]]:
    """Signs inside a word: ``user_at_example_dot_com``; names in programs look like that, so a known domain must end it."""
    sign = _JOINED_AT.search(token.group())
    if not sign:
        return []
    rest = token.group()[sign.end():]
    if re.split(r"\.|_dot_|DOT", rest.rstrip("."))[-1].lower() not in DOMAINS:
        return []
    name = token.group()[:sign.start()]
    base, after = token.start(), token.start() + sign.end()
    return [*((base + m.start(), base + m.end(), ".") for m in _JOINED_DOT.finditer(name)),
            (base + sign.start(), after, "@"),
            *((after + m.start(), after + m.end(), ".") for m in _JOINED_DOT.finditer(rest))]


def _unmask_symbols(tape: Tape) -> None:
    """Marked signs, and signs inside a word."""
    if re.search(r"[\[({<]", tape.text):
        tape.rewrite(_MARKED.finditer(tape.text), lambda m: [(*m.span(), "@" if m[1] else ".")])
    if ("_at_" in tape.text or "AT" in tape.text) and _JOINED_AT.search(tape.text):
        tape.rewrite(_TOKEN.finditer(tape.text), _joined)


_NAMES = "|".join(sorted(DIGITS, key=len, reverse=True))
_SPELLED = rf"(?:(?:{'|'.join(TIMES)})[\s-]+)?(?:{_NAMES})"
_RUN = re.compile(rf"\b{_SPELLED}(?:[\s-]+{_SPELLED})*\b", re.I)
_ONE = re.compile(rf"(?:({'|'.join(TIMES)})[\s-]+)?\b({_NAMES})\b", re.I)
_PLUS = re.compile(r"\bplus\s+(?=[0-9(])", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_SPELLING = frozenset(DIGITS)
_DOTS = frozenset(_DOT.split("|"))


def _unmask_digits(tape: Tape) -> None:
    """Digits for their names; blanks and hyphens between two names go."""
    def digits(run: re.Match) -> list[tuple[int, int, str]]:
        base, out, begin = run.start(), [], 0
        for m in _ONE.finditer(run.group()):
            many = TIMES[m[1].lower()] if m[1] else 1
            if out:
                out.append((base + begin, base + m.start(), ""))
            out.append((base + m.start(), base + m.end(), DIGITS[m[2].lower()] * many))
            begin = m.end()
        return out

    tape.rewrite(_RUN.finditer(tape.text), digits)
    tape.rewrite(_PLUS.finditer(tape.text), lambda m: [(*m.span(), "+")])


_BARE = re.compile(
    rf"(?<![{_LOCAL}])([{_LOCAL}]++(?:\s+(?:{_DOT})\s+[{_LOCAL}]++)?)\s+({_AT})\s+"
    rf"([A-Za-z0-9-]++(?:(?:\s+(?:{_DOT})\s+|\.)[A-Za-z0-9-]++)++)", re.I)
_BARE_AT = re.compile(rf"\s(?:{_AT})\s+[A-Za-z0-9-]++(?:\.|\s+(?:{_DOT})\s)", re.I)
_BARE_DOMAIN = re.compile(rf"@[A-Za-z0-9-]++(?:(?:\s+(?:{_DOT})\s+|\.)[A-Za-z0-9-]++)++", re.I)
_BARE_DOT = re.compile(rf"\s+({_DOT})\s+", re.I)


def _known_domain(domain: str) -> tuple[int, bool]:
    """(length of the domain up to its last known top-level domain, whether it has a spelled dot); 0 if none is known."""
    best = 0
    for m in re.finditer(rf"(?:\s+(?:{_DOT})\s+|\.)([A-Za-z0-9-]+)", domain, re.I):
        if m[1].lower() in DOMAINS:
            best = m.end()
    return best, bool(_BARE_DOT.search(domain[:best]))


def _unmask_bare(tape: Tape) -> None:
    """Whole addresses in bare words. Without a spelled dot the name must not be a mere word: ``look at example.com``."""
    def dots(text: str, base: int) -> list[tuple[int, int, str]]:
        return [(base + m.start(), base + m.end(), ".") for m in _BARE_DOT.finditer(text)]

    def address(m: re.Match) -> list[tuple[int, int, str]]:
        length, spelled = _known_domain(m[3])
        told = spelled or re.search(r"[A-Za-z0-9][._+-][A-Za-z0-9]|[0-9]", m[1])
        if not length or not told or m[2].lower() == "at" and re.search(r"\spoint\s", m[3], re.I):
            return []  # "at this point in"
        name = dots(m[1], m.start(1)) if spelled else []
        return [*name, (m.end(1), m.start(3), "@"), *dots(m[3][:length], m.start(3))]

    def domain(m: re.Match) -> list[tuple[int, int, str]]:
        length, _ = _known_domain(m.group())
        return dots(m.group()[:length], m.start())

    if _BARE_AT.search(tape.text):
        tape.rewrite(_BARE.finditer(tape.text), address)
    if "@" in tape.text:
        tape.rewrite(_BARE_DOMAIN.finditer(tape.text), domain)


def unmask(text: str) -> Tape:
    """The text with all transducers run over it."""
    tape = Tape(text)
    _unmask_homoglyphs(tape)
    _unmask_symbols(tape)
    lowered = tape.text.lower()
    words = set(_WORDS.findall(lowered))
    if not words.isdisjoint(_SPELLING) or "plus" in words:
        _unmask_digits(tape)
    if not words.isdisjoint(_DOTS):
        tape.rewrite(_DOT_OF_DIGITS.finditer(tape.text), lambda m: [(*m.span(), ".")])
    _unmask_bare(tape)
    return tape


def all_spans(text: str) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, normal form, plain) of every identifier, by start and kind."""
    plain = plain_spans(text)
    result = [(*s, text[s[1]:s[2]], True) for s in plain]
    tape = unmask(text)
    if tape.text != text:
        for kind, a, b in plain_spans(tape.text):
            first, last, normal = int(tape.first[a]), int(tape.last[b - 1]), tape.text[a:b]
            met = [s for s in plain if s[0] == kind and s[1] < last and first < s[2]]
            inside = kind == "email" and all(first <= s[1] and s[2] <= last for s in met)
            if text[first:last] != normal and (not met or inside):
                result.append((kind, first, last, normal, False))
    return in_order(result)


def identifiers(text: str | Column) -> Column:
    """A column of all identifiers in a text: kind, offsets, the source as written, its normal form, whether plain."""
    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        found = []
        for t in texts:
            spans = all_spans(t) if isinstance(t, str) else []
            found.append([
                {"kind": k, "first": a, "last": b, "source": t[a:b], "normal": n, "plain": p} for k, a, b, n, p in spans])
        return pd.Series(found, dtype=object)

    return find(F.col(text) if isinstance(text, str) else text)


def find_identifiers(documents: DataFrame, into: str = "identifiers", text: str = "text") -> DataFrame:
    """``documents`` with the column ``into``, an array of all identifiers in ``text``; other columns are as they were."""
    return documents.withColumn(into, identifiers(text))


def digest(found: DataFrame, identifier: str = "doc_id", into: str = "identifiers") -> DataFrame:
    """Per row the number of plain identifiers of each kind, a digest of the plain ones, and all of them as text."""
    spans = F.col(into)
    plain = F.filter(spans, lambda s: s["plain"])

    def written(some: Column) -> Column:
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in KINDS]
    return found.select(
        identifier, *counts, F.sha2(written(plain).cast("binary"), 256).alias("base_sha256"), written(spans).alias("spans"),
        (F.size(spans) - F.size(plain)).cast("long").alias("n_disguised"))
