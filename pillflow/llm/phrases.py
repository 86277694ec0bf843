"""Phrase collocations by SON partitioning.

Texts are cut into pieces at marks and line ends and pieces into words; a phrase is two to four words that follow one
another within a piece. Languages are separate throughout. A phrase is frequent if it occurs ``support`` times.

1. Words are counted exactly: for the sizes of languages, for the parts of phrases, and because a phrase with a rare
   word is rare. Frequent words go into a Bloom filter of fixed size; what it lets through by mistake only costs time.
2. The texts form ``SHARDS`` shards, the input's partitions dealt out in turn. Each is mined completely at its equal
   share of the support (rounded up): first pairs of words, then longer phrases all of whose pairs may be frequent.
   Tasks count what they hold and Spark adds up by shard, so a shard may be of any size, and the lowered support does
   not sink to one when the data grow. A phrase that is frequent in all reaches the lowered support in one shard at
   least, whatever the shards' sizes, or its counts would add up to less; so the union of what shards find misses
   nothing.
3. Of the union those can be dropped that cannot be frequent even if each shard that did not report them had as many
   as it may have without a report. The others go into a Bloom filter, again of fixed size, and are counted exactly
   over all texts.

Shards tell phrases apart by hashes of 64 bits. Two phrases of one hash have the sum of their counts there, so that
none is lost; the counts in the end are of phrases written out.

The weakest cut of a phrase into two parts gives its score, and phrases that are mostly parts of a longer frequent one
are left out; both are joins and minima over frequent phrases. Counts are whole numbers, products decimal.

A null text is empty, a null language is ``und``; equal texts and repeated rows are counted one by one; a very long
text is counted as a whole; an empty table gives no rows. Ties are settled by score, count and phrase.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pillflow.llm.common import stored
from pillflow.operators.lookups import hot_join

LONGEST = 4
#: Shards; the support is lowered to a tenth.
SHARDS = 10
#: Bytes of text that are counted together in the passes over all texts.
CHUNK = 10_000_000
#: Rows that a task hands over at once.
ROWS = 100_000
#: A Bloom filter has 2**FILTER_BITS bits (4 MB) however many keys it holds; that is all that is sent to tasks.
FILTER_BITS = 25
FILTER_HASHES = 3
#: Phrases of a language are ranked in so many parts, then in fewer, then together.
RANK_PARTS = (4096, 64)

_BREAK = -1
_MARKS = b".,;:!?\n\x0b\x0c\r"
_BETWEEN = re.compile(rb"[ \n]")
_STRETCH = 1_000_000
_TO_PLAIN = bytes.maketrans(_MARKS + b"\t" + bytes(range(65, 91)), b"\n" * len(_MARKS) + b" " + bytes(range(97, 123)))


class Words:
    """Texts as numbers of words in the order they were seen, with ``_BREAK`` between pieces."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(count().__next__, {b"": -2, b"\n": _BREAK})
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[bytes]) -> None:
        data = b"\n".join(texts).translate(_TO_PLAIN)
        at = 0
        while at < len(data):  # a stretch at a time, cut between words
            cut = _BETWEEN.search(data, at + _STRETCH)
            end = cut.start() if cut else len(data)
            self._add(data[at:end])
            at = end
        self._add(b"\n")
        self.size += len(data)

    def _add(self, data: bytes) -> None:
        words = data.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        self.ids.append(ids[ids != -2])

    def all_ids(self) -> np.ndarray:
        return np.concatenate(self.ids) if self.ids else np.empty(0, np.int32)

    def names(self) -> list[bytes]:
        """Words by number."""
        return list(self.number)[2:]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _longer(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hashes of phrases that have one word more."""
    return _mix(hashes * np.uint64(0xD6E8FEB86659FD93) + more)


def _places(hashes: np.ndarray) -> list[np.ndarray]:
    """Bits of the filter for each key."""
    h = _mix(hashes)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(k) * high) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64) for k in range(FILTER_HASHES)]


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for place in _places(hashes):
        found[found] = (bits[place[found] >> 3] >> (place[found] & 7).astype(np.uint8)) & 1 > 0
    return found


def word_keys(words: DataFrame) -> DataFrame:
    """``key``, the hash of each word of ``lang``, ``phrase``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [int(_word_hashes(lang, [word.encode()])[0]) for lang, word in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase")))]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64))], ["key"])

    return words.select("lang", "phrase").mapInArrow(hashed, "`key` long")


def bloom(keys: DataFrame) -> np.ndarray:
    """The filter of all rows of ``keys`` (``key``), made in tasks; a row per word of 64 bits that is not empty reaches the driver."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            for place in _places(batch.column("key").to_numpy().view(np.uint64)):
                own[place] = True
        words = np.packbits(own, bitorder="little").view("<i8")
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used])], ["at", "bits"])

    rows = keys.select("key").mapInArrow(fill, "at long, bits long")
    merged = rows.groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    whole = np.zeros(1 << FILTER_BITS >> 6, "<i8")
    whole[merged["at"].to_numpy(np.int64)] = merged["bits"].to_numpy(np.int64)
    return whole.view(np.uint8)


def _rows(lang: str, phrases: list[bytes], **columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.repeat(pa.scalar(lang, pa.string()), len(phrases)), pa.array(phrases, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*arrays, *map(pa.array, columns.values())], ["lang", "phrase", *columns])


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """The words of all rows language by language, given out when a language, or all together, are large enough."""
    held: dict[str, Words] = {}
    for batch in batches:
        for lang, texts in _by_language(batch):
            for some in _some(texts):
                held.setdefault(lang, Words()).add(some)
                largest = max(held, key=lambda k: held[k].size)
                if held[largest].size > CHUNK or sum(w.size for w in held.values()) > 2 * CHUNK:
                    yield largest, held.pop(largest)
    while held:
        yield held.popitem()


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of a batch by ``lang``."""
    groups: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
        groups.setdefault(lang, []).append(text)
    yield from groups.items()


def _some(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts a megabyte or so at a time."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > _STRETCH or i == len(texts) - 1:
            yield texts[begin:i + 1]
            begin, size = i + 1, 0


def _cut(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, rows.num_rows, ROWS):
        yield rows.slice(i, ROWS)


def count_words(documents: DataFrame) -> DataFrame:
    """``lang``, ``phrase`` (one word), ``a``: how often it occurs."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _in_chunks(batches):
            ids = words.all_ids()
            yield from _cut(_rows(lang, words.names(), a=np.bincount(ids[ids >= 0], minlength=len(words.names()))))

    rows = documents.select("lang", "text").mapInArrow(add_up, "lang string, phrase string, a long")
    return rows.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _pairs(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places where two words follow one another, hashes of these pairs)."""
    here = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return here, _longer(hashes[ids[here]], hashes[ids[here + 1]])


def _phrases(ids: np.ndarray, hashes: np.ndarray, bits: np.ndarray, pairs_alone: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For k = 2, 3, 4: (k, places, hashes) of phrases whose parts of k - 1 words are all in the filter.

    With ``pairs_alone`` the filter holds pairs only, and a longer phrase goes by its pairs; pairs must be in it.
    """
    here, found = _pairs(ids, hashes)
    for k in range(2, LONGEST + 1):
        if k == 2 or not pairs_alone:
            kept = _holds(bits, found)
            here, found = here[kept], found[kept]
        yield k, here, found
        goes_on = np.zeros(len(ids) + 1, bool)
        goes_on[here] = True
        some = goes_on[here + 1]
        here = here[some]
        found = _longer(found[some], hashes[ids[here + k]])


def _grouped(ids: np.ndarray, k: int, here: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each phrase, how often it occurs). Phrases are told apart by their words; a hash only brings them together."""
    order = np.argsort(found, kind="stable")
    at = here[order]
    new = np.append(True, np.zeros(max(0, len(at) - 1), bool))[:len(at)]
    for j in range(k):
        words = ids[at + j]
        new[1:] |= words[1:] != words[:-1]
    begins = np.flatnonzero(new)
    return at[begins], np.diff(np.append(begins, len(at)))


def _written(ids: np.ndarray, names: list[bytes], places: np.ndarray, k: int) -> list[bytes]:
    columns = [[names[i] for i in ids[places + j].tolist()] for j in range(k)]
    return list(map(b" ".join, zip(*columns)))


def _without_rare(ids: np.ndarray, hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Words that are not in the filter become breaks."""
    frequent = np.append(_holds(bits, hashes), False)  # the last one for breaks
    return np.where(frequent[ids], ids, np.int32(_BREAK))


def mine_shards(documents: DataFrame, words: np.ndarray, support: int, pairs: np.ndarray | None = None) -> DataFrame:
    """``key`` (a hash) of phrases that may be frequent: pairs of frequent words or, given those in ``pairs``, longer ones."""
    shared = documents.sparkSession.sparkContext.broadcast((words, pairs))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = shared.value
        shard = TaskContext.get().partitionId() % SHARDS
        for lang, held in _in_chunks(batches):
            hashes = _word_hashes(lang, held.names())
            ids = _without_rare(held.all_ids(), hashes, words)
            if pairs is None:
                mined = [_pairs(ids, hashes)[1]]
            else:
                mined = (found for k, _, found in _phrases(ids, hashes, pairs, True) if k > 2)
            for found in mined:
                keys, counts = np.unique(found, return_counts=True)
                shards = np.full(len(keys), shard, np.int32)
                yield from _cut(pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(shards), pa.array(counts)], ["key", "shard", "a"]))

    rows = documents.select("lang", "text").mapInArrow(mine, "`key` long, shard int, a long")
    # One shuffle, by phrase, serves the sums of shards and the union; tasks have added up what they hold already.
    in_shards = rows.repartition("key").groupBy("key", "shard").agg(F.sum("a").alias("a"))
    lowered = -(-support // SHARDS)
    reported = in_shards.where(F.col("a") >= lowered).groupBy("key").agg(F.sum("a").alias("a"), F.count("*").alias("shards"))
    # A shard that does not report a phrase has less than the lowered support of it.
    return reported.where(F.col("a") + (SHARDS - F.col("shards")) * (lowered - 1) >= support).select("key")


def count_phrases(documents: DataFrame, candidates: np.ndarray) -> DataFrame:
    """``lang``, ``phrase``, ``a`` over all texts, for phrases of two words and more that the filter ``candidates`` lets pass."""
    shared = documents.sparkSession.sparkContext.broadcast(candidates)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _in_chunks(batches):
            ids, names = words.all_ids(), words.names()
            for k, here, found in _phrases(ids, _word_hashes(lang, names), shared.value, False):
                places, counts = _grouped(ids, k, here, found)
                for i in range(0, len(places), ROWS):
                    yield _rows(lang, _written(ids, names, places[i:i + ROWS], k), a=counts[i:i + ROWS])

    rows = documents.select("lang", "text").mapInArrow(add_up, "lang string, phrase string, a long")
    return rows.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


@dataclass(frozen=True)
class Frequent:
    """``languages`` (``lang``, ``n``), ``words`` and ``phrases`` (``lang``, ``phrase``, ``a``), frequent ones only."""

    languages: DataFrame
    words: DataFrame
    phrases: DataFrame


def frequent_phrases(documents: DataFrame, support: int) -> Frequent:
    """All frequent words and phrases of ``documents`` (``lang``, ``text``) with exact counts."""
    texts = documents.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = stored(count_words(texts), "words")
    languages = stored(counted.groupBy("lang").agg(F.sum("a").alias("n")), "languages")
    words = stored(counted.where(F.col("a") >= support), "frequent-words")
    common = bloom(word_keys(words))
    pairs = stored(mine_shards(texts, common, support), "pairs")
    longer = stored(mine_shards(texts, common, support, bloom(pairs)), "longer")
    counts = count_phrases(texts, bloom(pairs.unionByName(longer)))
    # What the filter let through by mistake is not frequent, or it would have been in the union.
    return Frequent(languages, words, stored(counts.where(F.col("a") >= support), "frequent-phrases"))


def _parts(phrases: DataFrame) -> DataFrame:
    return phrases.withColumn("w", F.split("phrase", " "))


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def scored(frequent: Frequent) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r``, ``score`` of each frequent phrase at its weakest cut."""
    every = frequent.words.unionByName(frequent.phrases).select("lang", "phrase", "a")
    size = F.size("w")
    cuts = _parts(frequent.phrases).withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "lang", "phrase", "a", "k", _joined(F.slice("w", F.lit(1), F.col("k"))).alias("left"),
        _joined(F.slice("w", F.col("k") + 1, size - F.col("k"))).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = hot_join(cuts, every.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side], "inner")
    score = F.expr("(2000000BD * cast(a as decimal(38,0))) div (cast(l as decimal(38,0)) + r)")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(frequent: Frequent, percent: int) -> DataFrame:
    """``lang``, ``phrase`` of frequent phrases that lie in a longer one with ``percent`` of their occurrences."""
    longer = _parts(frequent.phrases).where(F.size("w") > 2)
    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: _joined(F.slice("w", i, k))))))
    most = longer.select("lang", spans.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    enough = F.col("longer").cast("decimal(38,0)") * 100 >= F.col("a").cast("decimal(38,0)") * percent
    return frequent.phrases.join(most, ["lang", "phrase"]).where(enough).select("lang", "phrase")


def collocations(documents: DataFrame, support: int = 30, percent: int = 80, first: int = 2000) -> DataFrame:
    """The ``first`` phrases of each language by score, count and phrase, with the figures of their weakest cut."""
    frequent = frequent_phrases(documents, support)
    left = scored(frequent).join(covered(frequent, percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language may have very many phrases: only the first of each part go on.
    for parts in RANK_PARTS:
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        place = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
        left = left.withColumn("_part", part).withColumn("_place", place).where(F.col("_place") <= first)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = left.drop("_part", "_place").withColumn("rank", rank).where(F.col("rank") <= first)
    return hot_join(ranked, frequent.languages, ["lang"], "inner").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
