"""The operators as Spark jobs on small tables with all the odd rows, against brute force."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pillflow.llm import common, langid, near, rans, suffixes, toxicity
from pillflow.llm.components import components
from pillflow.llm.queries import ORACLE_SQL, QUERIES

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, tag int"


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdeilmnorst"), rng.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, a shared passage, odd texts, nulls, a hot source, repeated rows, an extra column."""
    rng = np.random.default_rng(9)
    base, passage, long_ = words(rng, 120), words(rng, 90), words(rng, 4000)
    texts = [base] * 7 + [passage] + [words(rng, int(rng.integers(1, 150))) for _ in range(40)]
    for i in range(8):
        some = base.split()
        some[10 * i + 5] = f"anders{i}"
        texts.append(" ".join(some))
    texts += [words(rng, 20) + " " + passage + " " + words(rng, 20) for _ in range(4)]
    texts += [long_, "ab" * 600, "x" * 900, "", "", None, None, "12 34 !!", "a", "ü" * 300, long_[:1000] + "é" + long_[1000:3000]]
    out = [(i, t, ["en", "de", None][i % 3], "hot" if i % 3 == 0 else [None, "a", "b"][i % 3], len(t or ""), i) for i, t in enumerate(texts)]
    return out + [out[3]]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("llm"))
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(r[0], 1, int(r[0] % 5 == 0)) for r in rows[:40]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    rng = np.random.default_rng(2)
    vectors = [(i, rng.standard_normal(6).tolist(), 0) for i in range(0, 620)]
    vectors += [(1000, None, 0), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (1002, [float("nan")] * 6, 0), (1003, [0.0] * 6, 0),
                (1004, vectors[100][1], 0), (1005, [float("inf")] * 6, 0), (None, [1.0] * 6, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(2).write.parquet(f"{root}/embeddings.parquet")
    return root


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return root


def result(spark, name, folder):
    return QUERIES[name](spark, folder).toPandas()


def text_of(rows):
    return {r[0]: r[1] or "" for r in rows}


def ids_of(file, texts):
    library = Tokenizer.from_file(public_tokenizers.path(file))
    library.encode_special_tokens = True
    return [library.encode(t, add_special_tokens=False).ids for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert not len(result(spark, name, empty))


def test_op1(spark, folder, rows):
    found = result(spark, "op1_label_model", folder)
    assert sorted(found.doc_id) == sorted(r[0] for r in rows)
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()
    assert (found.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in found.doc_id]).all()
    assert found.groupby(found.doc_id.map(text_of(rows))).score.nunique().eq(1).all()


def test_op1_learns_words(spark):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        docs.append((i, words(rng, 40) + (" Idiot, you scumbag" if bad and i % 12 else " du Vollpfosten" if bad else "")))
        labels.append((i, int(bad)))
    docs += [(1000, None), (1001, "")]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learn(documents, spark.createDataFrame(labels[:600], "doc_id long, toxic int"))
    scores = {r.doc_id: r.score for r in toxicity.score(documents, model).collect()}
    held = [(scores[i] >= 0.3) == bool(t) for i, t in labels[600:]]
    assert np.mean(held) > 0.97
    assert scores[1000] == scores[1001] < 0.3


def test_op1_learns_words_of_a_small_language(spark):
    """One in a hundred toxic rows is in a language of its own; near copies of one toxic text teach no words."""
    rng = np.random.default_rng(6)
    small = lambda n: " ".join("".join(rng.choice(list("ßøæñžłqvwz"), rng.integers(3, 8))) for _ in range(n))
    docs, labels = [], []
    for i in range(3300):
        bad = i % 3 == 0
        docs.append((i, words(rng, 30) + (" you gonkhead " + words(rng, 5) if bad else "")))
        labels.append((i, int(bad)))
    for i in range(4000, 4200):
        bad = i % 10 == 0
        docs.append((i, small(15) + (" žurbløk " if bad else " ") + small(15)))
        labels.append((i, int(bad)))
    copied = small(60).split()
    docs += [(5000 + i, " ".join(copied[:i] + copied[i + 1:])) for i in range(12)]
    labels += [(5000 + i, 1) for i in range(12)]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    given = [r for r in labels if not 2400 <= r[0] < 3300 and not 4110 <= r[0] < 4200]
    model = toxicity.learn(documents, spark.createDataFrame(given, "doc_id long, toxic int"))
    told = toxicity.FormIndex(model.forms)
    assert len(told.hits(toxicity.word_keys("žurbløk"))) and len(told.hits(toxicity.word_keys("gonkhead")))
    assert len(told.hits(toxicity.word_keys(" ".join(copied)))) == 0
    scores = {r.doc_id: r.score for r in toxicity.score(documents, model).collect()}
    held = [(scores[i] >= 0.3) == bool(t) for i, t in labels if 4110 <= i < 4200]
    assert np.mean(held) > 0.97


def test_op2(spark, folder, rows):
    found = result(spark, "op2_rans_tokens", folder).sort_values(["doc_id", "start"])
    ordered = sorted(rows, key=lambda r: r[0])
    ids = [x + [2] for x in ids_of("byte_bpe_50k.json", [r[1] or "" for r in ordered])]
    lengths = np.array([len(x) for x in ids])
    assert found.doc_id.tolist() == [r[0] for r in ordered]
    assert found.n_tokens.tolist() == lengths.tolist() and found.start.tolist() == (np.cumsum(lengths) - lengths).tolist()
    assert found.ids_crc32.tolist() == [crc(x) for x in ids]


def test_op2_counts_tokens_without_reading_them_again(spark, folder, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens = rans.tokenize(spark.read.parquet(f"{folder}/documents.parquet"), path, end_id=2)
    counts = rans.count_tokens(tokens)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "counts:binary" in plan and "ids:binary" not in plan
    known = Tokenizer.from_file(path)
    ids = [i for r in rows for i in [*known.encode(r[1] or "", add_special_tokens=False).ids, 2]]
    assert {r.token: r.n for r in counts.collect()} == Counter(ids)


def test_op3(spark, folder, rows):
    found = result(spark, "op3_bloom_languages", folder)
    texts = text_of(rows)
    assert sorted(found.doc_id) == sorted(r[0] for r in rows) and found.score.between(0, 1).all()
    for r in found.itertuples():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id]))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_op3_tells_languages_and_forgives_passages(spark):
    rng = np.random.default_rng(4)
    parts = {"xx": ["ba", "ku", "lo", "mi"], "yy": ["schr", "ent", "ung", "zw"], "zz": ["éa", "oui", "eau", "lo"]}
    say = lambda lang, n: " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(n))
    docs = [(say(lang, 60) + (" " + say("yy", 10) if i % 10 == 0 else ""), lang) for lang in parts for i in range(60)]
    model = langid.learn(spark.createDataFrame(docs, "text string, lang string"))
    asked = [(say(lang, 8), lang) for lang in parts for _ in range(30)]
    found = langid.identify(spark.createDataFrame(asked, "text string, lang string"), model).collect()
    assert all(r.lang == r.lang_pred for r in found)


def brute_removal(texts, span):
    counts = Counter(t[i:i + span] for t in texts for i in range(len(t) - span + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if counts[t[i:i + span]] > 1:
                gone[i:i + span] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) and gone[0]))
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        yield len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [suffixes.HOT, 0])
def test_op4(spark, folder, rows, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)  # 0: every anchor counts as hot
    found = result(spark, "op4_induced_suffixes", folder).sort_values("doc_id")
    ordered = sorted(rows, key=lambda r: r[0])
    expected = [(r[0], *e) for r, e in zip(ordered, brute_removal([(r[1] or "").encode() for r in ordered], 400))]
    assert list(found.itertuples(index=False, name=None)) == expected


def brute_classes(texts):
    """Lowest number of each class: equal texts, and weighted Jaccard of 0.8 or more."""
    hashes, shingled = suffixes.Hashes(), {}
    counters = np.zeros(near.COUNTERS, np.int64)
    for _, t in texts:
        np.add.at(counters, near._counter(near.shingles(t, hashes)[0]), 1)
    idf = near.idf_table(len(texts), counters)
    names = {}
    for d, t in sorted(texts):
        names.setdefault(t, d)
    shingled = {d: near.weigh(t, hashes, idf) for t, d in names.items()}
    label = {d: d for d in shingled}
    pairs = [(a, b) for a in shingled for b in shingled if a < b and near.weighted_jaccard(shingled[a], shingled[b]) >= 0.8]
    for _ in range(len(label)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {d: label[names[t]] for d, t in texts}


def test_op5(spark, folder, rows):
    found = result(spark, "op5_weighted_minhash", folder)
    expected = brute_classes([(r[0], r[1]) for r in rows if r[1] is not None])
    expected |= {r[0]: r[0] for r in rows if r[1] is None}
    assert len(found) == len(rows)
    assert dict(zip(found.doc_id, found.class_id)) == expected


@pytest.mark.parametrize("block", [near.BLOCK, 2000])
def test_op5_compares_large_buckets_as_a_whole(spark, monkeypatch, block):
    """Copies of one text with more and more words changed share buckets, many below the limit: every link is found,
    and pairs whose texts are fetched stay in proportion to the texts."""
    rng, fetched, verify = np.random.default_rng(5), [], near._verify
    monkeypatch.setattr(near, "BLOCK", block, raising=False)
    monkeypatch.setattr(near, "_verify", lambda pairs, *more: fetched.append(pairs.count()) or verify(pairs, *more))
    words = [f"w{i}" for i in range(120)]
    texts = [(0, " ".join(words))]
    for d in range(1, 300):
        places = rng.choice(len(words), rng.integers(1, 9), replace=False)
        texts.append((d, " ".join(f"{w}x{rng.integers(40)}" if i in places else w for i, w in enumerate(words))))
    found = near.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    expected = brute_classes(texts)
    assert 10 < len(set(expected.values())) < 250
    assert {r.doc_id: r.class_id for r in found.collect()} == expected
    assert len(fetched) <= near.FEW and sum(fetched) < 10 * len(texts)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in found.collect()} == label
    assert not components(spark.createDataFrame([], "a long, b long")).collect()


def vectors_of(spark, folder):
    return {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()
            if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)}


def test_op6(spark, folder):
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors_of(spark, folder).items()}
    found = result(spark, "op6_kd_trees", folder).sort_values(["query_id", "rank"])
    expected = []
    for q in sorted(i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert list(found.itertuples(index=False, name=None)) == expected


def test_op6_in_sql(spark):
    """The registered SQL on the driver's table."""
    duck = duckdb.connect()
    duck.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    expected = duck.execute(ORACLE_SQL["op6_kd_trees"]).fetchall()
    assert sorted(result(spark, "op6_kd_trees", "/root/testdata/sf0.001").itertuples(index=False, name=None)) == sorted(expected)


def test_op9(spark, folder):
    vectors = {i: np.array(v) for i, v in vectors_of(spark, folder).items() if any(v)}
    found = result(spark, "op9_collision_lines", folder).sort_values(["query_id", "rank"])
    hits = 0
    queries = sorted(i for i in vectors if i % 100 == 0)
    for q in queries:
        best = sorted((float(np.sqrt(((v - vectors[q]) ** 2).sum())), i) for i, v in vectors.items() if i != q)[:10]
        own = found[found.query_id == q]
        assert own["rank"].tolist() == list(range(1, 11)) and (own.score.diff().dropna() >= 0).all()
        assert all(s == float(np.sqrt(((vectors[v] - vectors[q]) ** 2).sum())) for v, s in zip(own.vec_id, own.score))
        hits += len({i for _, i in best} & set(own.vec_id))
    assert hits >= 0.9 * 10 * len(queries)


def test_op7(spark, folder, rows):
    import tiktoken

    from pillflow.llm.piece_bpe import read_ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    expected = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        expected.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((r[1] or "").encode()).hexdigest()))
    found = result(spark, "op7_piece_bpe", folder)
    assert sorted(found.itertuples(index=False, name=None)) == sorted(expected)


def check_packed(found, texts):
    """Pieces of the right ids, gapless in their sequences; ``texts`` as (doc_id, text)."""
    pieces = []
    for (d, _), ids in zip(texts, ids_of("word_bpe_49k.json", [t or "" for _, t in texts])):
        ids = ids + [1]
        pieces += [(d, k, a, len(ids[a:a + 4096]), crc(ids[a:a + 4096])) for k, a in enumerate(range(0, len(ids), 4096))]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(found[columns].itertuples(index=False, name=None)) == sorted(pieces)
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 4096
    return found.sequence_id.nunique(), -(-int(found.length.sum()) // 4096)


def test_op8(spark, folder, rows):
    bins, least = check_packed(result(spark, "op8_swap_packing", folder), [(r[0], r[1]) for r in rows])
    assert bins <= least + 1


def test_op8_levels(spark):
    from pillflow.llm.packing import pack
    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(30)) + 1).alias("length"))
    found = pack(pieces, 64, per_group=300).toPandas()
    assert len(found) == 3000 and (found.groupby("sequence_id").length.sum() <= 64).all()
    assert found.sequence_id.nunique() <= -(-int(found.length.sum()) // 64) + 3


def test_op10(spark, folder, rows):
    found = result(spark, "op10_mixture_shards", folder)
    assert sorted(found.doc_id) == sorted(r[0] for r in rows)
    texts = text_of(rows)
    for r in found.itertuples():
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    sizes = found.groupby("shard").size()
    assert set(found.shard) <= set(range(24)) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
    sources = {r[0]: r[3] for r in rows}
    mixed = found.assign(source=found.doc_id.map(sources).fillna("-")).groupby(["shard", "source"]).size().unstack(fill_value=0)
    assert (mixed.max() - mixed.min()).max() <= 2


def test_pipeline(spark, folder, rows):
    """Each stage against brute force on what the stage before kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == columns
    known = stages["language"](spark, clean.checkpoint(), folder)
    kept = [r.asDict() for r in known.collect()]
    assert known.columns == columns and all(r["text"] and any(c.isalpha() for c in r["text"]) for r in kept)
    once = stages["near_duplicates"](spark, known.checkpoint(), folder).checkpoint()
    classes = brute_classes([(r["doc_id"], r["text"]) for r in kept])
    assert once.columns == columns
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(classes.values()))
    cut = stages["repeats"](spark, once, folder).checkpoint()
    before = {r.doc_id: r.text.encode() for r in once.collect()}
    expected = {d: e for d, e in zip(before, brute_removal(list(before.values()), 400))}
    assert cut.columns == columns and cut.count() == len(before)
    for r in cut.collect():
        assert r.n_chars == len(r.text) or r.text.encode() == before[r.doc_id]
        if r.text.encode() != before[r.doc_id]:
            assert len(before[r.doc_id]) - len(r.text.encode()) >= expected[r.doc_id][1] > 0
        else:
            assert expected[r.doc_id][1] == 0
    check_packed(stages["packing"](spark, cut, folder).toPandas(), [(r.doc_id, r.text) for r in cut.collect()])


def test_pipeline_hands_texts_over_in_small_batches(spark, rows):
    """A Python task gets a few MB at once, and keeps nothing that another step has loaded."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    many = spark.range(4000).select("id", F.repeat(F.lit("text "), 1000).alias("text")).coalesce(1)

    def look(batches):
        for step in ("one", "two"):
            common.worker_cache(step)["data"] = step
        held = [sorted(common._held())]
        common.drop_worker_cache()
        held.append(sorted(common._held()))
        for batch in batches:
            yield pd.DataFrame({"n": [int(batch["text"].str.len().sum())], "held": [str(held)]})

    def seen():
        return many.mapInPandas(look, "n long, held string").collect()

    before = spark.conf.getAll.get(setting)
    try:
        spark.conf.unset(setting)
        dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, DOCUMENTS).where("doc_id < 3"), "")
        found = seen()
        assert sum(r.n for r in found) == 20_000_000 and max(r.n for r in found) < 5_000_000
        assert {r.held for r in found} == {"[['two'], []]"}
        spark.conf.set(setting, "1m")
        common.small_batches(spark)
        assert max(r.n for r in seen()) < 1_500_000
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)


def test_pipeline_of_nothing(spark, empty):
    assert not corpus_pipeline.run(spark, empty).collect()


def test_equal_texts_are_one_class(spark):
    docs = spark.createDataFrame([(5, ""), (3, ""), (9, "a b"), (8, "A, b!"), (None, "a b"), (7, None)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near.near_duplicates(docs).collect()} == {5: 3, 3: 3, 9: 8, 8: 8}
    assert sorted((r.doc_id or -1) for r in near.keep_one_each(docs).collect()) == [-1, 3, 7, 8]


def test_candidates_of_one_band_are_compared(spark, monkeypatch):
    """The lowest text leads the only bucket and is like no other; the pair behind it shares that one band alone."""
    rng = np.random.default_rng(8)
    one, base = words(rng, 100), words(rng, 100).split()
    texts = [one, " ".join(base), " ".join(base[:99] + ["anders"]), words(rng, 100), " ".join(base[:30])]
    monkeypatch.setattr(near, "bucket_keys", lambda found, weights: np.array([17], np.int64))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near.near_duplicates(docs).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("hot", [suffixes.HOT, 0])
def test_op4_rows_without_doc_id(spark, monkeypatch, hot):
    """A passage shared with a row that has no id, a text that only such rows hold twice, one that a row shares, long ids."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = np.random.default_rng(12)
    passage, twice, both = words(rng, 120), words(rng, 110), words(rng, 130)
    around = lambda: words(rng, 9) + " " + passage + " " + words(rng, 9)
    rows = [(None, around()), ((1 << 60) + 1, around()), (None, twice), (None, twice), (7, both), (None, both),
            (None, None), (None, "short"), (8, words(rng, 150)), (None, words(rng, 150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    expected = [(d, *e) for (d, _), e in zip(rows, brute_removal([(t or "").encode() for _, t in rows], 400))]
    found = [tuple(r) for r in suffixes.digest(docs, 400).collect()]
    assert Counter(found) == Counter(expected)
    left = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in suffixes.strip_repeats(docs, 400).collect())
    assert left == Counter((d, kept) for d, *_, kept in expected)
