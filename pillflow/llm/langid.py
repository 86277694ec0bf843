"""Language identification with bit-sliced Bloom filters of n-grams.

Texts are lower-cased; what is not a letter parts words. N-grams are four bytes long and see where words begin and
end. Counts over all learning texts say which languages an n-gram belongs to: those where it is common, measured
against the language where it is most common, so that a foreign passage here and there does no harm. Filters of all
languages share their hashes: row ``r`` of the table holds bit ``r`` of every language's filter as one mask, and the
conjunction of a gram's rows is the set of all languages that contain it.

A text is looked up gram by gram. The number of hits per language is corrected for the filter's rate of false hits,
and the language with most corrected hits wins (ties: the more common language, then the name). The score is its
share of all corrected hits. A null text, or one without a letter, is ``und`` with score 0; a text whose n-grams are
in no filter gets the most common language with score 0. With nothing to learn from, everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pillflow.llm.common import unused

GRAM = 4
HASHES = 4
#: N-grams kept per language, the most common ones; they bound the filter, which is sent to all executors.
PER_LANGUAGE = 50_000
#: An n-gram belongs to a language if it is at least this common there, against the language where it is most common.
SHARE = 0.2
LEAST = 3
_ROWS_PER_KEY = 10
#: Characters that are looked at together: for counts, where fewer would mean more rows, and for predictions.
_COUNTED, _PREDICTED = 1_000_000, 500_000

_SPACE = ord(" ")
_AS_LETTERS = np.full(256, _SPACE, np.uint8)
_AS_LETTERS[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_AS_LETTERS[128:] = np.arange(128, 256)


@dataclass
class LanguageModel:
    """``languages``, the most common first, in groups of 64: a table of masks and false-hit rates for each group."""

    languages: list[str]
    groups: list[tuple[np.ndarray, np.ndarray]]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of all texts one after another, number of n-grams of each text)."""
    data = _AS_LETTERS[np.frombuffer("\0".join(texts).lower().encode("utf-8", "ignore") + b"\0", np.uint8)]
    ends = np.cumsum([len(t.lower().encode("utf-8", "ignore")) + 1 for t in texts]) - 1
    # One blank between words, one at each end of a text.
    blank = data == _SPACE
    keep = ~blank | ~np.append(True, blank[:-1])
    data = data[keep]
    place = np.cumsum(keep)
    ends = place[ends]
    data = np.append(np.uint8(_SPACE), data)
    starts = np.append(0, ends[:-1])
    wide = data.astype(np.uint32)
    if len(data) < GRAM:
        return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
    grams = wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]
    # A gram belongs to the text in which it ends, if it begins there as well.
    belongs = np.searchsorted(ends, np.arange(len(grams)) + 3, side="left")
    inside = np.arange(len(grams)) >= starts[np.minimum(belongs, len(texts) - 1)]
    return grams[inside], np.bincount(belongs[inside], minlength=len(texts))


def _mix(grams: np.ndarray) -> np.ndarray:
    h = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _rows(grams: np.ndarray, size: int) -> list[np.ndarray]:
    """The table rows of each gram, one array per hash; ``size`` is a power of two."""
    h = _mix(grams)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(k) * high) & np.uint64(size - 1)).astype(np.uint32) for k in range(HASHES)]


def count_grams(documents: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``n`` over all whole texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for texts in _chunks(part["text"].tolist(), _COUNTED):
                    grams, n = np.unique(_grams(texts)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": n})

    return documents.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))


def _chunks(texts: list[str], most: int) -> Iterator[list[str]]:
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size > most:
            yield some
            some, size = [], 0
    if some:
        yield some


def learn(documents: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model from all ``documents`` with ``text`` and ``lang``."""
    known = documents.where("text is not null and lang is not null")
    counts = count_grams(known).persist()
    try:
        totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
        rates = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
        most = rates.groupBy("gram").agg(F.max("rate").alias("most"))
        common = rates.join(most, "gram").where((F.col("n") >= LEAST) & (F.col("rate") >= SHARE * F.col("most")))
        # Rows here are distinct n-grams of four bytes, so a language has a bounded number whatever the data.
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
        chosen = common.select("lang", "gram", rank.alias("rank")).where(F.col("rank") <= per_language).toPandas()
        order = totals.orderBy(F.desc("total"), "lang").toPandas()["lang"].tolist()
    finally:
        counts.unpersist()
    groups = []
    for i in range(0, len(order), 64):
        some = order[i:i + 64]
        keys = {lang: chosen.loc[chosen["lang"] == lang, "gram"].to_numpy(np.uint32) for lang in some}
        most_keys = max(1, *(len(k) for k in keys.values()))
        size = 1 << (most_keys * _ROWS_PER_KEY - 1).bit_length()
        table = np.zeros(size, np.uint64)
        for bit, lang in enumerate(some):
            for rows in _rows(keys[lang], size):
                table[np.unique(rows)] |= np.uint64(1 << bit)
        bits = [(table >> np.uint64(bit)) & np.uint64(1) for bit in range(len(some))]
        groups.append((table, np.array([float(b.mean()) ** HASHES for b in bits])))
    return LanguageModel(order, groups)


def _hits(grams: np.ndarray, counts: np.ndarray, table: np.ndarray, false_rate: np.ndarray) -> np.ndarray:
    """Corrected hits of each text (rows) in each language (columns) of a group."""
    masks = np.full(len(grams), ~np.uint64(0))
    for rows in _rows(grams, len(table)):
        masks &= table[rows]
    ends = np.cumsum(counts)
    hits = np.empty((len(counts), len(false_rate)))
    for bit in range(len(false_rate)):
        total = np.append(0, np.cumsum((masks >> np.uint64(bit)) & np.uint64(1), dtype=np.int64))
        hits[:, bit] = total[ends] - total[ends - counts]
    return np.maximum(0, (hits - counts[:, None] * false_rate) / (1 - np.minimum(false_rate, 0.999)))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def identify(documents: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``documents`` with language and score in the columns ``names``, from ``text`` alone."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by PER_LANGUAGE and the languages

    def predict(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        names, scores = [], []
        for some in _chunks([t if isinstance(t, str) else "" for t in texts], _PREDICTED):
            letters = np.array([has_letter(t) for t in some])
            if not model.languages:
                letters[:] = False
            grams, counts = _grams(some)
            hits = np.hstack([_hits(grams, counts, *g) for g in model.groups]) if model.groups else np.zeros((len(some), 1))
            best = hits.argmax(axis=1)
            total = hits.sum(axis=1)
            share = np.where(total > 0, hits.max(axis=1) / np.where(total > 0, total, 1), 0.0)
            names += [model.languages[b] if ok else "und" for b, ok in zip(best, letters)]
            scores += np.where(letters, share, 0.0).tolist()
        return pd.DataFrame({"lang_pred": names, "score": scores})

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return predict(texts)

    (found,) = unused([*documents.columns, *names], "_found")
    return documents.withColumn(found, predicted("text")).withColumns({
        names[0]: F.col(found)["lang_pred"], names[1]: F.col(found)["score"]}).drop(found)
