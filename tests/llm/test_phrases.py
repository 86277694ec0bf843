"""Phrases against counting by hand, in one shard and in many, and against SQL on a test table."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pillflow.llm import phrases
from pillflow.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = "doc_id long, text string, lang string, _row int, shard string, n int"


def brute(rows, support, percent, first):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, 5):
                counts[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        inside = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        rows_ = []
        for p, a in found.items():
            if 100 * inside[p] >= percent * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:first], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    """A hot language, copies, one row many times, odd marks and blanks, null and empty texts, a very long one."""
    rng = np.random.default_rng(3)
    known = ["the", "of", "Ünder", "a-b", "x", "Über", "new", "york", "city", "hall", "日本", "\x1c", "é\x85", "\xa0", "O'Neil"]
    marks = [" ", "  ", "\t", ". ", ", ", "\n", "\r\n", "\x0b", "!", " - "]
    share = np.array([9.0] * 3 + [1.0] * 12)

    def text(n):
        some = rng.choice(known, n, p=share / share.sum())
        return "".join(w + marks[min(int(m), 9)] for w, m in zip(some, rng.geometric(0.5, n) - 1))

    texts = [text(int(rng.integers(0, 60))) for _ in range(260)] + [text(6000), "", None, " ", "...", "ab " * 50, "New York City Hall. " * 9]
    out = [(i, t, ["en", "en", "de", None, "und"][i % 5], i, "mine", 1) for i, t in enumerate(texts)]
    copy = (7, "New York new york, the Ünder city hall of x", "en", 1, "", 2)
    return out + [copy] * 60 + [(1000 + i, *copy[1:]) for i in range(40)] + [(None, copy[1], None, 1, "", 2), ((1 << 60) + 1, copy[1], "fr", 1, "", 2)]


@pytest.mark.parametrize("partitions,support,chunk", [(1, 30, 16_000_000), (10, 30, 2_000), (23, 12, 500), (7, 200, 9_000), (12, 1, 3_000)])
def test_equal_to_counting_by_hand(spark, rows, partitions, support, chunk, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(partitions)
    found = phrases.collocations(docs, support, 80, 40)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, support, 80, 40)


def test_shards_are_mined_at_lowered_supports(spark, rows):
    """The union holds every frequent phrase, and nothing whose counts in shards cannot add up to the support."""
    docs = spark.createDataFrame(rows, COLUMNS).repartition(10).select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).checkpoint()
    counted = phrases.count_words(docs)
    frequent = phrases.bloom(phrases.word_keys(counted.where("a >= 30")))
    pairs = phrases.mine_shards(docs, frequent, 30)
    longer = phrases.mine_shards(docs, frequent, 30, phrases.bloom(pairs))
    union = {r.key for r in pairs.unionByName(longer).collect()}
    true = {(lang, p): a for lang, _, p, a, *_ in brute(rows, 30, 10**9, 10**9)}
    all_ = {(lang, p): a for lang, _, p, a, *_ in brute(rows, 1, 10**9, 10**9)}

    def key(lang, phrase):
        hashes = phrases._word_hashes(lang, phrase.encode().split(b" "))
        total = hashes[:1]
        for h in hashes[1:]:
            total = phrases._longer(total, np.array([h], np.uint64))
        return int(total.view(np.int64)[0])

    assert {key(*p) for p in true} <= union
    assert len(union) < len(all_) / 3 and union <= {key(*p) for p in all_}


def test_filter_keeps_what_was_put_in(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    bits = phrases.bloom(keys)
    asked = np.array([r.key for r in spark.range(6000).select(F.xxhash64("id").alias("key")).collect()], np.int64).view(np.uint64)
    held = phrases._holds(bits, asked)
    assert held[:3000].all() and held[3000:].sum() < 30


def test_stretches_do_not_change_words(monkeypatch):
    text = ("ab  cd, ef\t\tgh " * 40 + "\n" + "x" * 50 + " y. z").encode()
    whole = phrases.Words()
    whole.add([text, b"", text])
    monkeypatch.setattr(phrases, "_STRETCH", 7)
    parts = phrases.Words()
    parts.add([text, b"", text])
    read = lambda w: [w.names()[i] if i >= 0 else None for i in w.all_ids()]
    assert read(whole) == read(parts)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = QUERIES["op11_son_phrases"](spark, folder)
    result = connection.execute(ORACLE_SQL["op11_son_phrases"])
    assert [d[0] for d in result.description] == found.columns
    assert sorted(map(tuple, found.collect())) == sorted(result.fetchall())


def test_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], COLUMNS)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, 1, "", 1)], COLUMNS)).collect() == []
