"""Near-duplicates: improved consistent weighted sampling over TF-IDF word shingles, banded and verified.

Shingles are five words of the lower-cased text (words are runs of letters, digits and other non-ASCII characters);
a shorter text with any word is one shingle. A shingle weighs its count in the text times its inverse document
frequency, 1 + ``SPAN`` * ln(N / df) / ln(N). Document frequencies over all texts are kept in a table of ``COUNTERS``
counters, by hash, less the counts that other shingles are expected to add; its size does not grow with the data.

Each text draws ``BANDS * ROWS`` consistent weighted samples. Their random numbers come from tables for hashed
shingles; a sample is the shingle itself with its level. Texts that agree in all samples of a band share a bucket.

In a bucket, texts are compared with a leader, whole texts by weighted Jaccard similarity, and linked from 0.8 on.
Linked texts form classes. After ``FEW`` such rounds, in each of which a bucket that still holds several classes has
the next leader, the rest of each such bucket is compared as a whole. First those texts leave that cannot be similar
to any text of another class in it: two texts share at most what either has in shingles that it does not have alone
among all texts left, so their total weights and what each has alone bound their similarity. What remains is dealt
into blocks, and each two blocks of a bucket meet in one group, where an index by shingle sums up what texts share.
So every two texts that agree in one band are compared, in one class, or known not to be similar; banding misses
0.02 in 100 texts that are 0.8 similar.

Equal texts are one class from the start and take part once; empty texts, too, are equal. A null text, or a null
``doc_id``, is a class of its own. Different texts of one ``doc_id`` are compared like others; repeated rows are in
one class.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow.llm.common import stored, unused, worker_cache
from pillflow.llm.components import components
from pillflow.llm.suffixes import Hashes
from pillflow.llm.toxicity import is_word_byte
from pillflow.operators.lookups import hot_join

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
COUNTERS = 1 << 20
SPAN = 0.25
_CHUNK = 1 << 12
_DIM_BITS = 14
#: In so many rounds a bucket has one leader, of its lowest class: the same text leads most buckets of a large group.
FEW = 2
#: A block of a bucket has this total weight, about as many shingles, unless one text alone has more.
BLOCK = 150_000
#: So many shingles, on average, are looked at together to find those that one text has alone.
BIN = 500_000



def shingles(text: str, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles as 64-bit hashes, ascending; how often each occurs)."""
    data = np.frombuffer(text.lower().encode("utf-8", "ignore") + b" ", np.uint8)
    word = is_word_byte(data)
    edges = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0))
    if not len(edges):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    words = hashes.between(data, edges[::2], edges[1::2])
    n = min(WORDS, len(words))
    mixed = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        mixed = (mixed ^ words[k:len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed, return_counts=True)


def all_shingles(texts: list[str], hashes: Hashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for many texts, about half a megabyte at a time."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and size < 500_000:
            size += len(texts[j])
            j += 1
        yield from _some_shingles(texts[i:j], hashes)
        i = j


def _some_shingles(texts: list[str], hashes: Hashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    raw = [t.lower().encode("utf-8", "ignore") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    edges = np.flatnonzero(np.diff(is_word_byte(data).astype(np.int8), prepend=0))
    starts = edges[::2]
    words = hashes.between(data, starts, edges[1::2])
    ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))
    mixed = np.full(max(0, len(words) - WORDS + 1), np.uint64(WORDS))
    for k in range(WORDS):
        mixed = (mixed ^ words[k:len(mixed) + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    begin = 0
    for text, end in zip(texts, ends.tolist()):
        if end - begin < WORDS:
            yield shingles(text, hashes)
        else:
            found = np.sort(mixed[begin:end - WORDS + 1])
            new = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
            yield found[new], np.diff(new, append=len(found))
        begin = end


def _counter(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(44)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(number of texts, counters) over all rows. The counters, 4 MB, come to the driver."""
    parts = COUNTERS // _CHUNK

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, total, n = Hashes(), np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            for found, _ in all_shingles(list(batch["text"]), hashes):
                np.add.at(total, _counter(found), 1)
                n += 1
        each = total.astype("<i4").reshape(parts, _CHUNK)
        yield pd.DataFrame({"part": np.append(np.arange(parts), -1), "counts": [c.tobytes() for c in each] + [np.array([n], "<i8").tobytes()]})

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        kind = "<i8" if rows["part"].iloc[0] < 0 or len(rows["counts"].iloc[0]) == 8 * _CHUNK else "<i4"
        total = sum(np.frombuffer(c, kind).astype("<i8") for c in rows["counts"])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "counts": [total.tobytes()]})

    counted = texts.select("text").mapInPandas(count, "part int, counts binary")
    rows = counted.groupBy("part").applyInPandas(add_up, "part int, counts binary").collect()  # at most parts + 1 rows
    total, n = np.zeros((parts, _CHUNK), np.int64), 0
    for row in rows:
        if row.part < 0:
            n = int(np.frombuffer(row.counts, "<i8")[0])
        else:
            total[row.part] = np.frombuffer(row.counts, "<i8")
    return n, total.ravel()


def idf_table(n: int, counters: np.ndarray) -> np.ndarray:
    """The inverse document frequency for each counter."""
    others = (counters.sum() - counters) / (len(counters) - 1)
    df = np.clip(counters - others, 1, max(1, n))
    return (1 + SPAN * np.log(max(1, n) / df) / np.log(max(2, n))).astype(np.float32)


def weigh(text: str, hashes: Hashes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, ascending; weight of each)."""
    found, counts = shingles(text, hashes)
    return found, counts * idf[_counter(found)].astype(np.float64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over the sum of the greater ones; 0 where there are none."""
    at = np.searchsorted(b[0], a[0])
    inside = at < len(b[0])
    inside[inside] = b[0][at[inside]] == a[0][inside]
    least = np.minimum(a[1][inside], b[1][at[inside]]).sum()
    most = a[1].sum() + b[1].sum() - least
    return float(least / most) if most else 0.0


def _tables() -> tuple[np.ndarray, ...]:
    """r, 1 / r, ln c and beta of the sampling scheme for each hashed shingle and sample, and room to work in."""
    kept = worker_cache("icws")
    if not kept:
        rng, shape = np.random.default_rng(2010), (1 << _DIM_BITS, BANDS * ROWS)
        r = rng.standard_gamma(2, shape, np.float32)
        tables = r, 1 / r, np.log(rng.standard_gamma(2, shape, np.float32)), rng.random(shape, np.float32)
        kept["tables"] = (*tables, *(np.empty((_CHUNK, BANDS * ROWS), np.float32) for _ in range(3)))
    return kept["tables"]


def bucket_keys(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One key for each band: its samples, and the band's number."""
    r, inverse, c, b, *room = _tables()
    k = BANDS * ROWS
    best, who, level = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64), np.zeros(k, np.int64)
    column = np.arange(k)
    log_weight = np.log(weights).astype(np.float32)
    hashed = ((found * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _DIM_BITS)).astype(np.int64)
    for i in range(0, len(found), _CHUNK):
        dims = hashed[i:i + _CHUNK]
        t, beta, other = (x[:len(dims)] for x in room)
        np.take(inverse, dims, axis=0, out=t, mode="clip")
        np.take(b, dims, axis=0, out=beta, mode="clip")
        t *= log_weight[i:i + _CHUNK, None]
        t += beta
        np.floor(t, out=t)
        a = np.subtract(t, beta, out=beta)
        a += 1
        a *= np.take(r, dims, axis=0, out=other, mode="clip")
        np.subtract(np.take(c, dims, axis=0, out=other, mode="clip"), a, out=a)
        at = a.argmin(axis=0)
        low = a[at, column]
        better = low < best
        best[better], who[better], level[better] = low[better], found[i + at][better], t[at, column][better].astype(np.int64)
    keys = np.arange(BANDS, dtype=np.uint64)
    samples = (who ^ (level.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))).reshape(BANDS, ROWS)
    for row in range(ROWS):
        keys = (keys ^ samples[:, row]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def _sign(texts: DataFrame, idf) -> DataFrame:
    """``doc_id``, ``tid``, the bucket keys and the total weight of each text."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for batch in batches:
            texts = list(batch["text"])
            tids = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            weighed = ((found, counts * idf.value[_counter(found)].astype(np.float64)) for found, counts in all_shingles(texts, hashes))
            signs = [(bucket_keys(*w) if len(w[0]) else np.empty(0, np.int64), w[1].sum()) for w in weighed]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tid": tids, "keys": [k for k, _ in signs], "weight": [float(w) for _, w in signs]})

    return texts.mapInPandas(sign, "doc_id long, tid binary, `keys` array<long>, weight double")


def _verify(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose texts are similar. Each text is looked up by its number; a pair is compared in one row."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, held = Hashes(), {}

        def weights(doc: int, text: str):
            if doc not in held:
                if len(held) > 256:
                    held.clear()
                held[doc] = weigh(text, hashes, idf.value)
            return held[doc]

        for batch in batches:
            similar = [weighted_jaccard(weights(a, s), weights(b, t)) >= SIMILAR - 1e-9
                       for a, b, s, t in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"])]
            yield batch.loc[similar, ["a", "b", "a_label", "b_label"]]

    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(second, "b").join(first, "a").mapInPandas(compare, "a long, b long, a_label long, b_label long")


def _own_weights(texts: DataFrame, idf, bins: int) -> DataFrame:
    """``doc_id``, ``own``: the weight of the shingles that no other of the texts has; no row if there are none."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for batch in batches:
            for i in range(0, len(batch), 256):  # few at a time, as they are kept as numbers
                some = batch.iloc[i:i + 256]
                weighed = list(all_shingles(list(some["text"]), hashes))
                found = np.concatenate([f for f, _ in weighed])
                weights = np.concatenate([n for _, n in weighed]) * idf.value[_counter(found)].astype(np.float64)
                docs = np.repeat(some["doc_id"].to_numpy(np.int64), [len(f) for f, _ in weighed])
                dealt = (found % np.uint64(bins)).astype(np.int64)
                order = np.argsort(dealt, kind="stable")
                cuts = np.flatnonzero(np.diff(dealt[order], prepend=-1))
                parts = [[x.tobytes() for x in np.split(column[order], cuts[1:])] for column in (found, docs, weights)]
                yield pd.DataFrame(dict(zip(("bin", "found", "docs", "weights"), (dealt[order][cuts], *parts))))

    def alone(rows: pd.DataFrame) -> pd.DataFrame:
        found, docs, weights = (np.frombuffer(b"".join(rows[c]), kind) for c, kind in (("found", "<u8"), ("docs", "<i8"), ("weights", "<f8")))
        order = np.argsort(found)
        differs = found[order][1:] != found[order][:-1]
        own = order[np.append(True, differs) & np.append(differs, True)]
        names, at = np.unique(docs[own], return_inverse=True)
        return pd.DataFrame({"doc_id": names, "own": np.bincount(at, weights[own], len(names))})

    dealt = texts.select("doc_id", "text").mapInPandas(deal, "bin long, found binary, docs binary, weights binary")
    return dealt.groupBy("bin").applyInPandas(alone, "doc_id long, own double").groupBy("doc_id").agg(F.sum("own").alias("own"))


def _possible(named: DataFrame, own: DataFrame) -> DataFrame:
    """Those rows of buckets whose text may be similar to one of another class in the same bucket."""
    rows = stored(named.join(own, "doc_id", "left").withColumn("own", F.coalesce("own", F.lit(0.0))), "weighed")
    others = rows.select(F.col("key").alias("_key"), F.col("label").alias("_label"), F.col("weight").alias("_weight"), F.col("own").alias("_own"))
    common = F.least(F.col("weight") - F.col("own"), F.col("_weight") - F.col("_own"))
    can = common >= (SIMILAR - 1e-6) * (F.col("weight") + F.col("_weight") - common)
    kept = rows.join(others, (F.col("key") == F.col("_key")) & (F.col("label") != F.col("_label")) & can, "left_semi")
    return stored(kept.drop("own"), "possible")


def similar_pairs(weighed: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, blocks: np.ndarray) -> list[tuple[int, int]]:
    """Places of all similar texts of different labels, and of different blocks if there are two.

    ``weighed``: counts and weights as by ``weigh``. What texts share is summed up over their shared shingles.
    """
    names, sizes = np.unique(labels, return_counts=True)
    last = labels == names[sizes.argmax()]
    order = np.argsort(last, kind="stable")  # texts of the largest class come last: none of them is compared with all others
    labels, blocks, apart = labels[order], blocks[order], blocks.min() != blocks.max()
    found = np.concatenate([weighed[i][0] for i in order])
    weights = np.concatenate([weighed[i][1] for i in order])
    lengths = np.array([len(weighed[i][0]) for i in order])
    who = np.repeat(np.arange(len(order)), lengths)
    by_shingle = np.argsort(found, kind="stable")
    new = np.flatnonzero(np.append(True, found[by_shingle][1:] != found[by_shingle][:-1]))
    size = np.diff(new, append=len(found))
    column = np.empty(len(found), np.int64)
    column[by_shingle] = np.repeat(np.arange(len(new)), size)
    shared = size[column] > 1
    total = np.bincount(who, weights, len(order))
    most = np.bincount(who[shared], weights[shared], len(order))
    starts = np.cumsum(lengths) - lengths
    least = SIMILAR - 1e-6
    pairs = []
    for i in range(int(np.count_nonzero(~last))):
        common = np.minimum(most[i], most)
        can = (labels != labels[i]) & (common >= least * (total[i] + total - common))
        can[:i + 1] = False
        if apart:
            can &= blocks != blocks[i]
        if not can.any():
            continue
        own = np.arange(starts[i], starts[i] + lengths[i])
        own = own[shared[own]]
        of = column[own]
        n = size[of]
        places = by_shingle[np.arange(n.sum()) + np.repeat(new[of] - (np.cumsum(n) - n), n)]
        common = np.bincount(who[places], np.minimum(weights[places], np.repeat(weights[own], n)), len(order))
        for j in np.flatnonzero(can & (common >= least * (total[i] + total - common))).tolist():
            a, b = int(order[i]), int(order[j])
            if weighted_jaccard(weighed[a], weighed[b]) >= SIMILAR - 1e-9:
                pairs.append((a, b))
    return pairs


def _compared(rows: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """``a``, ``b``: similar texts of different classes in one bucket, all of each bucket compared."""
    sums = rows.groupBy("key").agg(F.ceil(F.sum("weight") / BLOCK).alias("blocks"))
    placed = hot_join(rows, sums, ["key"], "inner").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    every = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = every.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "doc_id", "label")

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        hashes, docs = Hashes(), tile["doc_id"].tolist()
        weighed = [(found, n * idf.value[_counter(found)].astype(np.float64)) for found, n in all_shingles(list(tile["text"]), hashes)]
        pairs = similar_pairs(weighed, tile["label"].to_numpy(), tile["block"].to_numpy())
        return pd.DataFrame([sorted((docs[a], docs[b])) for a, b in pairs], columns=["a", "b"], dtype="int64")

    together = tiles.join(texts, "doc_id").groupBy("key", "x", "y")
    return together.applyInPandas(compare, "a long, b long").distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` with the higher label of each new link replaced by the lowest it is linked to, two steps on."""
    step = links.select(F.greatest("a_label", "b_label").alias("label"), F.least("a_label", "b_label").alias("to"))
    step = step.groupBy("label").agg(F.min("to").alias("to"))
    further = step.select(F.col("label").alias("to"), F.col("to").alias("then"))
    step = step.join(further, "to", "left").select("label", F.coalesce("then", "to").alias("to"))
    return hot_join(labels, step, ["label"]).select("doc_id", F.coalesce("to", "label").alias("label"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold several classes."""
    mixed = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    return stored(hot_join(rows, mixed, ["key"], "left_semi"), "mixed")


def _classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc_id``, ``tid`` of all rows with a text and a ``doc_id``; ``tid``, ``class_id`` of all distinct texts)."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    idf = spark.sparkContext.broadcast(idf_table(*document_frequencies(texts)))  # 4 MB, whatever the data
    signed = stored(_sign(texts, idf), "signed")
    # Distinct texts are numbered, as a ``doc_id`` may name several: the numbers stand for them in all that follows.
    firsts = stored(signed.groupBy("tid").agg(F.min("doc_id").alias("first")).withColumn("text_no", F.monotonically_increasing_id()), "firsts")
    numbered = firsts.withColumnRenamed("first", "doc_id")
    once = signed.join(numbered, ["tid", "doc_id"]).drop("doc_id").withColumnRenamed("text_no", "doc_id")
    rows = once.select("doc_id", "weight", F.explode("keys").alias("key")).distinct()
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = stored(hot_join(rows, shared, ["key"], "left_semi"), "buckets")
    wanted = stored(buckets.select("doc_id").distinct(), "wanted")
    places = numbered.join(wanted.withColumnRenamed("doc_id", "text_no"), "text_no")
    named_texts = texts.withColumn("tid", F.unhex(F.sha2("text", 256)))
    held = named_texts.join(places.hint("shuffle_hash"), ["tid", "doc_id"]).select(F.col("text_no").alias("doc_id"), "text")
    held = stored(held.dropDuplicates(["doc_id"]), "near-texts")

    links: list[DataFrame] = []
    labels = wanted.withColumn("label", F.col("doc_id"))
    for number in range(FEW + 1):
        # Labels need not be final here: they only save comparisons within what is known to be one class.
        named = _mixed(buckets.join(labels, "doc_id"))
        if named.isEmpty():
            break
        if number == FEW:
            rest = named.select("doc_id", "weight").distinct()
            left = stored(held.join(rest, "doc_id"), "left")
            bins = math.ceil((left.agg(F.sum("weight")).first()[0] or 0) / BIN) or 1
            possible = _possible(named, _own_weights(left, idf, bins))
            links.append(stored(_compared(_mixed(possible), left.select("doc_id", "text"), idf), "links"))
            break
        ranked = named.groupBy("key").agg(F.min(F.struct("label", "doc_id", "weight")).alias("one"))
        leaders = stored(ranked.select("key", F.col("one.doc_id").alias("leader"), F.col("one.label").alias("of"),
                                       F.col("one.weight").alias("led")), "leaders")
        ends = F.array_sort(F.array(F.struct("doc_id", "label"), F.struct(F.col("leader").alias("doc_id"), F.col("of").alias("label"))))
        near_weight = F.least("weight", "led") >= (SIMILAR - 1e-6) * F.greatest("weight", "led")
        met = named.join(leaders, "key").where("label <> `of`").where(near_weight).select(ends.alias("e")).distinct()
        pairs = met.select(*[F.col("e")[i][f].alias(n + m) for i, n in enumerate("ab") for f, m in (("doc_id", ""), ("label", "_label"))])
        new = stored(_verify(stored(pairs, "pairs"), held, idf), "links")
        links.append(new.select("a", "b"))
        labels = stored(_merged(labels, new), "labels")
        # A leader has now met every text of another class in its bucket.
        done = leaders.select("key", F.col("leader").alias("doc_id"))
        buckets = stored(named.select("key", "doc_id", "weight").join(done, ["key", "doc_id"], "left_anti"), "buckets")
    no_links = spark.createDataFrame([], "a long, b long")
    labels = components(reduce(DataFrame.unionByName, links, no_links))
    labelled = firsts.join(labels.withColumnRenamed("node", "text_no"), "text_no", "left").select(
        "tid", "first", F.coalesce("label", "text_no").alias("label"))
    lowest = labelled.groupBy("label").agg(F.min("first").alias("class_id"))
    return signed.select("doc_id", "tid"), hot_join(labelled.select("tid", "label"), lowest, ["label"], "inner").select("tid", "class_id", "label")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id`` (the lowest ``doc_id`` of the class) for every row with a text and a ``doc_id``."""
    rows, classes = _classes(documents)
    # Copies of one text may be a third of all rows: the join is split there, as its other side is small.
    keyed = classes.select(F.concat(F.lit("="), F.hex("tid")).alias("_key"), "class_id")
    return rows.select("doc_id", F.concat(F.lit("="), F.hex("tid")).alias("_key")).join(keyed, "_key").select("doc_id", "class_id")


def keep_one_each(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each class: that of the lowest ``doc_id``, and of the lowest hash if it has several texts."""
    rows, classes = _classes(documents)
    of_text = rows.groupBy("tid").agg(F.min("doc_id").alias("doc_id")).join(classes, "tid")
    kept = of_text.groupBy("label").agg(F.min(F.struct("doc_id", "tid")).alias("one")).select("one.doc_id", "one.tid")
    id_, tid = unused(documents.columns, "_id", "_tid")
    alone = documents.where("doc_id is null or text is null")
    named = documents.where("doc_id is not null and text is not null").withColumns({
        id_: F.col("doc_id"), tid: F.unhex(F.sha2("text", 256))})
    rest = named.join(kept.toDF(id_, tid), [id_, tid], "left_semi").dropDuplicates([id_, tid])
    return rest.select(documents.columns).unionByName(alone)
