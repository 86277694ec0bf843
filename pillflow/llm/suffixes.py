"""Removal of long repeated byte strings with suffix arrays.

A string of ``span`` bytes that starts at two places, in one document or two, is repeated; every byte it covers is
removed. The work is cut into shards that can be sorted alone:

1. Each window of ``span`` bytes has an anchor, the ``gram`` in it with the lowest hash (the first, if several).
   Equal windows have equal anchors. Neighbouring windows share theirs; a run of them, with all its bytes, is a
   region, known by the anchor's hash. Only regions whose anchor occurs twice can hold a repeated window.
2. Regions with equal bytes are summed up: all of their windows are repeated, and one of them stands for all.
3. Regions of one anchor go to one shard. Each shard sorts the suffixes of its bytes by induced sorting: suffixes are
   classified, leftmost smaller substrings are sorted and named, the order of the shorter string of names is found
   (by doubling of ranks, the arrays' form of the recursion), and all other suffixes are induced from it. Permuted
   common prefixes then tell which windows are repeated.
4. An anchor with more than ``HOT`` different regions is not sorted in one shard: each of its windows is known by a
   128-bit hash, and windows are counted.

Texts that occur more than once need no sorting themselves: if they have ``span`` bytes, all of them go. One copy of
each takes part for the sake of other texts. Null and empty texts have no bytes; an empty table gives no rows. A row
with a null ``doc_id`` is treated like any other: inside the job ids are texts, and that of a null is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pillflow.llm.common import drop_worker_cache, stored, texts_of, unused
from pillflow.operators.lookups import hot_join

#: Different regions of one anchor that are sorted together, at most.
HOT = 2_000
#: Bytes of a shard array; regions of one anchor may go beyond, up to HOT of them. Sorting takes some 90 bytes for each.
SHARD_BYTES = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


class Hashes:
    """Hashes of all substrings of a given length, as sums of powers modulo 2**64."""

    def __init__(self, seed: int = 7):
        self.letters = _letters(seed)
        self.up = self.down = np.ones(1, np.uint64)

    def _sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up = np.cumprod(np.full(size, _BASE, np.uint64))
            self.down = np.cumprod(np.full(size, _INVERSE, np.uint64))
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.letters[data] * self.up[:n], out=sums[1:])
        return sums

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h

    def of(self, data: np.ndarray, length: int) -> np.ndarray:
        """One hash for each start; ``data`` holds bytes and is at least ``length`` long."""
        sums, count = self._sums(data), len(data) + 1 - length
        return self._mixed((sums[length:] - sums[:count]) * self.down[:count])

    def between(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the given substrings."""
        sums = self._sums(data)
        return self._mixed((sums[ends] - sums[starts]) * self.down[starts])


def anchor_runs(data: np.ndarray, hashes: Hashes, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of each run of windows with one anchor."""
    if len(data) < span:
        none = np.empty(0, np.int64)
        return none, none, none
    h = hashes.of(data, gram)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, have = span - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    owner = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    last = np.append(first[1:], len(owner)) - 1
    return h[owner[first]].view(np.int64), first, last


# --- suffix array of one shard -------------------------------------------------------------------------------------

def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by induced sorting. ``text`` holds small positive integers and ends in its only 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    smaller = _smaller_types(text)
    starts_run = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    by_char = starts_run[np.argsort(text[starts_run], kind="stable")]
    rough = _induce(text, smaller, by_char)
    is_start = np.zeros(n, bool)
    is_start[starts_run] = True
    ordered = rough[is_start[rough]]
    names = _names(text, starts_run, ordered)
    place = np.full(n, -1, np.int32)
    place[starts_run] = np.arange(len(starts_run), dtype=np.int32)
    reduced = np.empty(len(starts_run), np.int64)
    reduced[place[ordered]] = names
    if names[-1] + 1 < len(names):
        ordered = starts_run[_order_of(reduced)]
    return _induce(text, smaller, ordered)


def _smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it."""
    n = len(text)
    step = np.diff(text.astype(np.int32))
    differs = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(differs[::-1])[::-1]
    rising = np.append(step, 1) > 0
    return np.append(rising[np.minimum(following, n - 1)], True)


def _induce(text: np.ndarray, smaller: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The order of all suffixes from that of the leftmost smaller ones, bucket by bucket in both directions."""
    size = int(text.max()) + 1
    cuts = np.searchsorted(text[ordered], np.arange(size + 1)) if len(ordered) else np.zeros(size + 1, int)
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]

    def deal(found: np.ndarray, chars: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
        order = np.argsort(chars, kind="stable")
        chars, found = chars[order], found[order]
        edges = np.flatnonzero(chars[1:] != chars[:-1]) + 1
        at = [0, *edges.tolist(), len(chars)]
        for a, b in zip(at, at[1:]):
            buckets[chars[a]].append(found[a:b])

    def scan(queue: np.ndarray, c: int, want: bool, buckets: list[list[np.ndarray]]) -> np.ndarray:
        before = queue[queue > 0] - 1
        before = before[smaller[before] == want]
        if not len(before):
            return before
        chars = text[before]
        same = chars == c
        if same.all():
            return before
        rest = ~same
        deal(before[rest], chars[rest], buckets)
        return before[same]

    sorted_larger = []
    for c in range(size):
        done, queue = [], _joined(larger[c])
        while len(queue):
            done.append(queue)
            queue = scan(queue, c, False, larger)
        sorted_larger.append(_joined(done))
        larger[c] = []
        own = ordered[cuts[c]:cuts[c + 1]]
        if len(own):
            scan(own, c, False, larger)
    lower: list[list[np.ndarray]] = [[] for _ in range(size)]
    parts: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        done, queue = [], _joined(lower[c])
        if c == 0:
            done, queue = [np.array([len(text) - 1], np.int32)], queue[:0]
        while len(queue):
            done.append(queue)
            queue = scan(queue, c, True, lower)
        lower[c] = []
        parts.append(_joined(done)[::-1])
        scan(sorted_larger[c][::-1], c, True, lower)
        parts.append(sorted_larger[c])
        if c == 0:
            break
    return np.concatenate(parts[::-1])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.int32)


def _names(text: np.ndarray, starts: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Ranks of the sorted leftmost smaller substrings; equal ones share a rank."""
    length = np.full(len(text), 1, np.int32)
    length[starts[:-1]] = np.diff(starts) + 1
    a, b = ordered[:-1], ordered[1:]
    differ = length[a] != length[b]
    open_ = np.flatnonzero(~differ)
    k = 0
    while len(open_):
        unequal = text[a[open_] + k] != text[b[open_] + k]
        differ[open_[unequal]] = True
        k += 1
        open_ = open_[~unequal]
        open_ = open_[length[a[open_]] > k]
    return np.append(0, np.cumsum(differ))


def _order_of(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names by doubling; only names not yet alone are sorted again."""
    m = len(names)
    order = np.argsort(names, kind="stable")
    rank = _group_starts(names[order])
    ranks = np.empty(m + 1, np.int64)
    ranks[order], ranks[m] = rank, -1
    step = 1
    while True:
        alone = np.append(rank[1:] != rank[:-1], True) & np.append(True, rank[1:] != rank[:-1])
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order
        some = order[open_]
        key = rank[open_] * (m + 2) + ranks[np.minimum(some + step, m)] + 1
        by = np.argsort(key, kind="stable")
        key, some = key[by], some[by]
        order[open_] = some
        new = np.append(True, key[1:] != key[:-1])
        rank[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        ranks[some] = rank[open_]
        step *= 2


def _group_starts(values: np.ndarray) -> np.ndarray:
    new = np.append(True, values[1:] != values[:-1])
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(for each suffix the one sorted before it, their common prefix), in the order of the text.

    Where the letters before two neighbours agree, the common prefix is one less than that of the place before, so
    letters are compared for the other places alone.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    here = np.arange(n)
    known = np.where(before > 0, before - 1, 0)
    reducible = (here > 0) & (before > 0) & (text[here - 1] == text[known])
    heads = np.flatnonzero(~reducible)
    wide = np.append(text, np.zeros(4, text.dtype)).astype(np.uint64)
    four = wide[:n] << np.uint64(48) | wide[1:n + 1] << np.uint64(32) | wide[2:n + 2] << np.uint64(16) | wide[3:n + 3]
    length = np.zeros(len(heads), np.int64)
    open_ = np.flatnonzero(before[heads] >= 0)
    while len(open_):
        a, b = heads[open_] + length[open_], before[heads[open_]] + length[open_]
        equal = four[a] == four[b]
        open_ = open_[equal]
        length[open_] += 4
    pair = np.flatnonzero(before[heads] >= 0)
    for _ in range(3):
        a, b = heads[pair] + length[pair], before[heads[pair]] + length[pair]
        equal = text[a] == text[b]
        pair = pair[equal]
        length[pair] += 1
    head_of = np.cumsum(~reducible) - 1
    return before, length[head_of] - (here - heads[head_of])


def repeated_windows(regions: list[bytes], span: int) -> list[np.ndarray]:
    """For each region the starts of windows that occur anywhere else in the regions, or in itself."""
    sizes = np.array([len(r) for r in regions], np.int64)
    ends = np.cumsum(sizes + 1) - 1  # places of the separators
    text = np.frombuffer(b"\0".join(regions) + b"\0\0", np.uint8).astype(np.uint16) + 2
    text[ends] = 1
    text[-1] = 0
    order = suffix_array(text)
    before, common = permuted_prefixes(text, order)
    room = np.repeat(ends, sizes + 1) - np.arange(ends[-1] + 1)
    long_ = np.flatnonzero(np.minimum(common[:ends[-1] + 1], room) >= span)
    flag = np.zeros(len(text), bool)
    flag[long_] = True
    flag[before[long_]] = True
    starts = ends - sizes
    return [np.flatnonzero(flag[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]


# --- the job -------------------------------------------------------------------------------------------------------

_RUNS = "doc_id string, tid binary, n_bytes long, h array<long>, first array<int>, last array<int>"


def _as_bytes(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _find_runs(documents: DataFrame, span: int, gram: int) -> DataFrame:
    """Of each document: sha256 and size of its text, and the runs of windows with their anchors."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_worker_cache()
        hashes = Hashes()
        for batch in texts_of(batches):
            rows = []
            for doc_id, data in zip(batch["doc_id"], _as_bytes(batch["text"])):
                h, first, last = anchor_runs(np.frombuffer(data, np.uint8), hashes, span, gram)
                rows.append((doc_id, hashlib.sha256(data).digest(), len(data), h, first, last))
            yield pd.DataFrame(rows, columns=["doc_id", "tid", "n_bytes", "h", "first", "last"])

    return documents.select("doc_id", "text").mapInPandas(find, _RUNS)


def _cut_regions(texts: DataFrame, span: int) -> DataFrame:
    """Regions with their bytes; runs of one anchor that overlap in a document make one region, ``merged``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, tid, data, runs in zip(batch["doc_id"], batch["tid"], _as_bytes(batch["text"]), batch["runs"]):
                open_: dict[int, list] = {}
                found = []
                for run in sorted(runs, key=lambda r: r["first"]):
                    h, first, last = run["h"], run["first"], run["last"]
                    held = open_.get(h)
                    if held and first <= held[1] + 1:
                        held[1], held[2] = last, True
                    else:
                        if held:
                            found.append((h, held))
                        open_[h] = [first, last, False]
                found += open_.items()
                for h, (first, last, merged) in found:
                    part = data[first:last + span]
                    rows.append((doc_id, tid, h, first, merged, part, hashlib.md5(part).digest()))
                    size += len(part)
                if size > 8_000_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "tid", "h", "start", "merged", "data", "same"]
    return texts.mapInPandas(
        cut, "doc_id string, tid binary, h long, start int, merged boolean, data binary, same binary")


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of neighbouring numbers."""
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.append(0, cuts + 1)], starts[np.append(cuts, len(starts) - 1)]


def _sort_shards(kinds: DataFrame, span: int) -> DataFrame:
    """Windows repeated in or among the regions of one anchor: ``h``, ``same``, ``first`` and ``last`` of each stretch."""
    names = ["h", "same", "first", "last"]

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_worker_cache()
        held: list[tuple] = []
        size = 0

        def shard() -> pd.DataFrame:
            rows = []
            for (h, same, _), starts in zip(held, repeated_windows([r[2] for r in held], span)):
                if len(starts):
                    first, last = _ranges(starts)
                    rows += [(h, same, a, b) for a, b in zip(first.tolist(), last.tolist())]
            return pd.DataFrame(rows, columns=names)

        for batch in batches:
            for row in zip(batch["h"], batch["same"], batch["data"]):
                if held and size >= SHARD_BYTES and held[-1][0] != row[0]:
                    yield shard()
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield shard()

    ordered = kinds.select("h", "same", "data").repartition("h").sortWithinPartitions("h")
    return ordered.mapInPandas(sort, "h long, same binary, first int, last int")


def _count_windows(kinds: DataFrame, span: int) -> DataFrame:
    """The same for anchors with very many different regions, by counting hashes of single windows."""

    def hash_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = Hashes(11), Hashes(13)
        for batch in batches:
            for h, same, data in zip(batch["h"], batch["same"], batch["data"]):
                text = np.frombuffer(data, np.uint8)
                a, b = one.of(text, span).view(np.int64), two.of(text, span).view(np.int64)
                yield pd.DataFrame({"h": h, "same": same, "at": np.arange(len(a), dtype=np.int32), "a": a, "b": b})

    windows = kinds.select("h", "same", "data").mapInPandas(hash_all, "h long, same binary, `at` int, a long, b long")
    often = windows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    return windows.join(often, ["a", "b"]).select("h", "same", F.col("at").alias("first"), F.col("at").alias("last"))


def _id_of() -> Column:
    """``doc_id`` as a text that is never null, so that it can be joined on and passes through pandas unchanged."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def find_repeats(documents: DataFrame, span: int = 400, gram: int = 100) -> tuple[DataFrame, DataFrame]:
    """(all documents, changed documents).

    All documents: ``doc_id`` as a text (see ``_id_of``), ``tid`` (sha256 of the text), ``n_bytes``. Changed ones: ``doc_id``, ``tid``,
    ``n_removed``, ``n_spans`` and ``kept``, the bytes that are left.
    """
    rows = documents.select(_id_of().alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    runs = stored(_find_runs(rows, span, gram), "runs")
    texts = runs.groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    one_each = runs.where("size(h) > 0").join(texts.select("doc_id", "tid"), ["doc_id", "tid"], "left_semi")
    zipped = F.explode(F.arrays_zip("h", "first", "last")).alias("r")
    windows = one_each.select("doc_id", "tid", zipped).select("doc_id", "tid", "r.*")
    often = windows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    wanted = hot_join(windows, often, ["h"], "left_semi").groupBy("doc_id", "tid").agg(
        F.collect_list(F.struct("h", "first", "last")).alias("runs"))  # of one document: bounded by its length
    with_tid = rows.where(F.octet_length("text") >= span).withColumn("tid", F.unhex(F.sha2("text", 256)))
    held = stored(with_tid.join(wanted.hint("shuffle_hash"), ["doc_id", "tid"]), "texts", compression="zstd")
    regions = stored(_cut_regions(held, span), "regions", compression="zstd")

    # Equal regions of one anchor, and how many different ones it has.
    place = F.struct("doc_id", "tid", "start")
    kinds = regions.groupBy("h", "same").agg(F.count("*").alias("n"), F.min(place).alias("one"))
    spread = kinds.groupBy("h").agg(F.count("*").alias("kinds"))
    kinds = stored(kinds.join(spread, "h"), "kinds")
    chosen = kinds.select("h", "same", "kinds", F.col("one.doc_id").alias("doc_id"), F.col("one.tid").alias("tid"),
                          F.col("one.start").alias("start"))
    with_data = regions.join(chosen, ["h", "same", "doc_id", "tid", "start"]).where("kinds > 1 or merged")
    found = _sort_shards(with_data.where(F.col("kinds") <= HOT), span).unionByName(
        _count_windows(with_data.where(F.col("kinds") > HOT), span))
    # Within one region nothing is gained by both; a region that occurs twice is repeated as a whole.
    found = stored(found.distinct(), "found")

    sized = regions.select("doc_id", "tid", "h", "same", "start", (F.octet_length("data") - span).alias("most"))
    twice = kinds.where("n > 1").select("h", "same")
    whole = sized.join(twice, ["h", "same"]).select(
        "doc_id", "tid", F.col("start").alias("a"), (F.col("start") + F.col("most")).alias("b"))
    parts = sized.join(found, ["h", "same"]).select(
        "doc_id", "tid", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last")).alias("b"))
    cuts = whole.unionByName(parts).groupBy("doc_id", "tid").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))
    single = texts.where("copies = 1").select("doc_id", "tid")
    cut_texts = held.select("doc_id", "tid", "text").join(
        cuts.join(single, ["doc_id", "tid"], "left_semi"), ["doc_id", "tid"])
    several = runs.where(F.col("n_bytes") >= span).join(
        texts.where("copies > 1").select("tid"), "tid", "left_semi").dropDuplicates(["doc_id", "tid"])
    emptied = several.select(
        "doc_id", "tid", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.lit("").cast("binary").alias("kept"))
    changed = stored(_remove(cut_texts, span).unionByName(emptied), "changed")
    return runs.select("doc_id", "tid", "n_bytes"), changed


def _remove(cut_texts: DataFrame, span: int) -> DataFrame:
    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, tid, data, cuts in zip(batch["doc_id"], batch["tid"], _as_bytes(batch["text"]), batch["cuts"]):
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, [c["a"] for c in cuts], 1)
                np.add.at(edge, [c["b"] + span for c in cuts], -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                rows.append((doc_id, tid, int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "tid", "n_removed", "n_spans", "kept"])

    return cut_texts.mapInPandas(remove, "doc_id string, tid binary, n_removed long, n_spans long, kept binary")


def digest(documents: DataFrame, span: int = 400) -> DataFrame:
    """Per document the bytes it had, those removed, the removed runs, and the sha256 of what is left."""
    everything, changed = find_repeats(documents, span)
    facts = changed.select("doc_id", "tid", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return everything.join(facts, ["doc_id", "tid"], "left").select(
        F.expr("nullif(doc_id, '')").cast("long").alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("tid"))).alias("kept_sha256"))


def strip_repeats(documents: DataFrame, span: int = 400) -> DataFrame:
    """``documents`` with repeated strings taken out of ``text``, and ``n_chars`` to match.

    Where a cut splits a character, what is left of the character goes, too.
    """
    _, changed = find_repeats(documents, span)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["kept"] = [k.decode("utf-8", "ignore") for k in batch["kept"]]
            yield batch

    # Columns of the documents may have any names.
    id_, tid, kept = unused(documents.columns, "_id", "_tid", "_kept")
    left = changed.select("doc_id", "tid", "kept").mapInPandas(decode, "doc_id string, tid binary, kept string").toDF(id_, tid, kept)
    named = documents.withColumns({id_: _id_of(), tid: F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))})
    joined = named.join(left, [id_, tid], "left")
    if "n_chars" in documents.columns:
        joined = joined.withColumn(
            "n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept)).cast("long"))
    return joined.withColumn("text", F.coalesce(kept, "text")).select(documents.columns)
