"""Plain identifiers against the patterns as they are written down, disguised ones against what they stand for."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pillflow.llm import identifiers as I
from pillflow.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        twice = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fits(k, m.group())]
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


BITS = ["a", "@", ".", "1", "12", "+1", "(555) ", "255", "4", "7", "0", "-", " ", "b.c", "é", "4716 ", "3225", "999", "300.", "\n", "٣", "x@y.de"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=40).map("".join))
def test_plain_spans_equal_the_patterns(text):
    assert I.plain_spans(text) == brute(text)
    kept = [s[:3] for s in I.all_spans(text) if s[4]]
    assert kept == brute(text)


DISGUISED = [
    ("email", "hein.19 [at] mail5 [dot] example [dot] com", "hein.19@mail5.example.com"),
    ("email", "hein.19(AT)mail5.example.com", "hein.19@mail5.example.com"),
    ("email", "hein.19@mail5 dot example dot com", "hein.19@mail5.example.com"),
    ("email", "hein at mail5 dot example dot com", "hein@mail5.example.com"),
    ("email", "john.doe at example.com", "john.doe@example.com"),
    ("email", "ana arroba correo punto es", "ana@correo.es"),
    ("email", "paul arobase courrier point fr", "paul@courrier.fr"),
    ("email", "john_at_example_dot_com", "john@example.com"),
    ("email", "johnATexampleDOTcom", "john@example.com"),
    ("email", "hеin@mаil.example.com", "hein@mail.example.com"),
    ("email", "ｈｅｉｎ＠ｍａｉｌ．com", "hein@mail.com"),
    ("email", "he​in@mail.example.com", "hein@mail.example.com"),
    ("ip", "152 dot 143 dot 123 dot 131", "152.143.123.131"),
    ("ip", "152[.]143[.]123[.]131", "152.143.123.131"),
    ("ip", "one five two dot one four three dot one two three dot one three one", "152.143.123.131"),
    ("ip", "１５２.143.123.131", "152.143.123.131"),
    ("card", "4785 3805 9239 one one three nine", "4785 3805 9239 1139"),
    ("card", "4785‑3805‑9239‑1139", "4785-3805-9239-1139"),
    ("phone", "plus one seven four three five five five three eight two four", "+17435553824"),
    ("phone", "+1 (743) triple five 3824", "+1 (743) 555 3824"),
    ("phone", "plus eins sieben vier drei 555 doppel drei 24", "+1743 555 33 24"),
]


@pytest.mark.parametrize("kind,source,normal", DISGUISED)
@pytest.mark.parametrize("before,after", [("", ""), ("Ünï: ", " - ja."), ("see 12 (", ") or")])
def test_disguised(kind, source, normal, before, after):
    found = [(s[0], before + source + after, s[3]) for s in I.all_spans(before + source + after)
             if not s[4] and (s[1], s[2]) == (len(before), len(before) + len(source))]
    assert (kind, before + source + after, normal) in found


@pytest.mark.parametrize("text", [
    "Look at example.com for more.", "A point at this point in time.", "One, two, three, four, five.", "the dot at the end.it",
    "get_at_index.foo", "Das ist ein Punkt. Acht oder neun?", "рост цен и спрос", "no one knows 12 345", "", " ", "version 1.2.3 at 10.5"])
def test_clean(text):
    assert not I.all_spans(text)


def test_a_plain_span_stays_as_it_is():
    text = "+1 (743) 555-3824 one thing, a@b.de and 4785380592391139 un"
    assert [s[:3] for s in I.all_spans(text)] == brute(text)


@pytest.mark.parametrize("piece", ["x", "1", " ", "1.", "a.", "@", "+1 ", "a at ", "( ", "4-", "_at_", "AT"])
def test_time_grows_with_the_text(piece):
    start = time.perf_counter()
    I.all_spans(piece * 100_000)
    assert time.perf_counter() - start < 20


def test_query(spark, tmp_path):
    texts = [None, "", "plain a@b.de", "b [at] c [dot] de", "x" * 300_000 + " 1.2.3.4", "plain a@b.de", "日本 +49 (30) 1234567"]
    ids = [1, 2, (1 << 60) + 1, None, 5, (1 << 60) + 1, 7]
    rows = [(i, t, "mine", j) for j, (i, t) in enumerate(zip(ids, texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, identifiers string, first int")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, QUERIES["op13_offset_transducers"](spark, str(tmp_path)).collect()), key=repr)
    expected = []
    for i, t in zip(ids, texts):
        base = brute(t or "")
        written = [":".join(map(str, s)) for s in base]
        counts = [sum(s[0] == k for s in base) for k in PATTERNS]
        spans = ["email:0:17"] if t == texts[3] else written
        digest = hashlib.sha256(",".join(written).encode()).hexdigest()
        expected.append((i, *counts, digest, ",".join(spans), len(spans) - len(written)))
    assert found == sorted(expected, key=repr)
    kept = I.find_identifiers(docs, "_spans")
    assert kept.columns == [*docs.columns, "_spans"]
    some = {r.source: r.normal for r in kept.select(I.F.inline("_spans")).collect()}
    assert some["b [at] c [dot] de"] == "b@c.de" and some["1.2.3.4"] == "1.2.3.4"


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op13_offset_transducers"](spark, str(tmp_path)).collect() == []
