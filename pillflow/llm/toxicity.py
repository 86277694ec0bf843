"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier.

1. Word forms. A word stands for itself, if it has up to 12 bytes, and for its beginnings of 4 to 12 bytes. A bounded
   sample of labelled texts, ``SAMPLE`` at most, each text once, shows which forms occur in toxic texts far more often
   than in others. Counts alone decide, not the share of toxic texts that hold a form, so that small languages have
   theirs; near copies of a text count once, or the words of one copied text would seem to tell. If more than ``FORMS`` are found, each toxic text in turn has its most telling ones kept.
2. Voters. These forms are dealt to ``VOTERS`` lexicon voters by their first bytes, so that forms of one stem vote
   together. Such a voter says yes if a text holds its forms more often than chance has it in other texts of that
   length. Voters for patterns of the whole text are added (shouting, repeated marks, words of insult).
3. Label model. Over all documents, labelled or not, votes are counted singly and in pairs. From the covariances of
   triples of voters and the share of toxic texts it estimates how often each voter says yes to toxic and to other
   texts. A voter that does not say yes abstains, for its forms may belong to another language; that all abstain
   counts once, as often as that happens with toxic and other texts of the sample. Covariance that these do not explain is the correlation of two voters; correlated voters share their
   weight. The given label is one more voter, which errs at a fixed rate.
4. Classifier. A logistic regression on word forms and patterns is trained on the posterior labels of the sample and
   scores every whole text.

Null and empty texts hold no forms and get the score of a text without any. With no toxic or no other text to learn
from, every score is the share of toxic labels. Repeated rows are scored alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow.llm.common import drop_worker_cache, stored, texts_of

#: Labelled texts that word forms and the classifier are learned from, at most; chosen by a hash of their number.
SAMPLE = 20_000
#: Word forms kept: first those that tell most in any toxic text, then the second of each, and so on.
FORMS = 800
VOTERS = 15
#: A form must be found in so many toxic texts, and so many times more often in them than in others.
LEAST, LIFT = 4, 8.0
#: Keys that tell near copies among toxic texts of the sample.
KIN = 5
#: Lifts that part the tiers of forms; voters hold forms of one tier, so that a weak form speaks through a weak voter.
TIERS = (60.0, 20.0)
#: Share of given labels taken to be wrong.
LABEL_ERRORS = 0.002

# Words of insult in the languages at hand, one pattern voter.
INSULTS = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown",
    "dumb", "bastard", "bitch", "whore", "fuck", "shit", "cunt", "retard", "faggot",
    "arschloch", "scheisse", "scheiße", "hurensohn", "dummkopf", "schlampe", "wichser",
    "connard", "salope", "putain", "merde", "enculé", "imbécile",
    "pendejo", "puta", "mierda", "cabrón", "gilipollas", "estúpido",
)

_WORD = np.zeros(256, bool)
_WORD[ord("a"):ord("z") + 1] = True
_WORD[ord("0"):ord("9") + 1] = True
_WORD[128:] = True
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_PATTERNS = 4
#: Lengths in bytes of the beginnings of words that are forms.
BEGINNINGS = (4, 5, 6, 7, 8, 10, 12)


def is_word_byte(data: np.ndarray) -> np.ndarray:
    """Letters and digits of lower-cased ASCII, and all bytes of other characters."""
    return _WORD[data]


def _first_bytes(k: int) -> np.uint64:
    return np.uint64(((1 << 8 * k) - 1) << (64 - 8 * k))


def word_keys(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes 1 to 8 and 9 to 16 of each word of the lower-cased text, as numbers; shorter words filled with zeros."""
    data = np.frombuffer(text.lower().encode("utf-8", "ignore") + b" " * 17, np.uint8)
    word = _WORD[data]
    edges = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0))
    starts, length = edges[::2], edges[1::2] - edges[::2]
    first, second = np.zeros((2, len(starts)), np.uint64)
    for k in range(8):
        first |= np.where(length > k, data[starts + k], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
        second |= np.where(length > k + 8, data[starts + k + 8], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
    return first, second


def _form(first: np.ndarray, second: np.ndarray, mark: int) -> np.ndarray:
    """The first 4 bytes as they are, 24 bits of a hash of the others, and a mark."""
    rest = (first & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xD6E8FEB86659FD93)
    rest ^= rest >> np.uint64(31)
    rest *= np.uint64(0xBF58476D1CE4E5B9)
    return (first & np.uint64(0xFFFFFFFF00000000)) | (rest >> np.uint64(40)) << np.uint64(8) | np.uint64(mark)


def forms_of(words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The forms of words, one by one: the mark is the length of a beginning, or 255 for a whole word."""
    first, second = words
    short = second & np.uint64(0xFFFFFFFF) == 0
    found = [_form(first[short], second[short], 255)]
    for k in BEGINNINGS:
        if k <= 8:
            longer = first[(first >> np.uint64(64 - 8 * k)) & np.uint64(255) != 0]
            found.append(_form(longer & _first_bytes(k), np.zeros(len(longer), np.uint64), k))
        else:
            longer = (second >> np.uint64(128 - 8 * k)) & np.uint64(255) != 0
            found.append(_form(first[longer], second[longer] & _first_bytes(k - 8), k))
    return np.concatenate(found)


class FormIndex:
    """Finds the forms of a bounded list among those of a text."""

    def __init__(self, forms: np.ndarray):
        self.forms = forms  # ascending
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self._short(forms)] = True

    @staticmethod
    def _short(forms: np.ndarray) -> np.ndarray:
        return (forms * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)

    def hits(self, words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Places in the list, one for each occurrence."""
        forms = forms_of(words)
        forms = forms[self.seen[self._short(forms)]]
        if not len(forms) or not len(self.forms):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.forms, forms), len(self.forms) - 1)
        return at[self.forms[at] == forms]


def pattern_votes(text: str, keys: np.ndarray, insults: np.ndarray) -> list[bool]:
    """Insults, shouting, repeated marks, masked letters."""
    upper = len(text.encode("utf-8", "ignore").translate(None, _NOT_UPPER))
    return [
        bool(np.isin(keys, insults).any()), upper > 20 and upper > 0.5 * len(text),
        "!!" in text or "?!" in text, "**" in text or "@#" in text,
    ]


def insult_keys() -> np.ndarray:
    return np.unique(np.concatenate([word_keys(w)[0] for w in INSULTS]))


# --- word forms ----------------------------------------------------------------------------------------------------

def passage_keys(text: str) -> list[int]:
    """``KIN`` keys, each of three lowest hashes of runs of five words; near copies have one in common."""
    first, second = word_keys(text)
    words = (first ^ second * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    n = min(5, len(words))
    if not n:
        return []
    mixed = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        mixed = (mixed ^ words[k:len(words) - n + 1 + k]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    odd = np.random.default_rng(5).integers(0, 1 << 62, 3 * KIN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    lows = np.array([(mixed * m).min() for m in odd]).reshape(KIN, 3)
    keys = (lows[:, 0] * np.uint64(3) ^ lows[:, 1]) * np.uint64(5) ^ lows[:, 2] ^ np.arange(KIN, dtype=np.uint64)
    return keys.view(np.int64).tolist()


def _text_key(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "ignore")).digest()


def _kin(texts: DataFrame) -> dict[bytes, int]:
    """For each text that has near copies the number of its group; ``texts`` are bounded as the sample is."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in texts_of(batches):
            yield pd.DataFrame({"text": [_text_key(t) for t in batch["text"]], "keys": [passage_keys(t) for t in batch["text"]]})

    rows = texts.select("text").mapInPandas(sign, "text binary, `keys` array<long>").collect()
    group = list(range(len(rows)))

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    first: dict[int, int] = {}
    for i, row in enumerate(rows):
        for key in row["keys"]:
            group[top(i)] = top(first.setdefault(key, i))
    size = np.bincount([top(i) for i in range(len(rows))], minlength=1)
    return {bytes(row["text"]): top(i) for i, row in enumerate(rows) if size[top(i)] > 1}


def choose_forms(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The forms, ascending, that tell toxic texts from others in ``sample`` (``text``, ``toxic``).

    With them, how often each occurs in other texts, per word, and its tier: 0 for the most telling.
    """

    kin = _kin(sample.where("toxic = 1"))

    def count_toxic(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in texts_of(batches):
            groups: dict[int, list[np.ndarray]] = {}
            for text in batch["text"]:
                groups.setdefault(kin.get(_text_key(text), -1), []).append(np.unique(forms_of(word_keys(text))))
            for group, each in groups.items():
                forms, n = np.unique(np.concatenate(each), return_counts=True)
                yield pd.DataFrame({"form": forms.view(np.int64), "kin": group, "n": n})

    toxic = sample.where("toxic = 1").select("text").mapInPandas(count_toxic, "form long, kin long, n long")
    toxic = toxic.groupBy("form", "kin").agg(F.when(F.col("kin") < 0, F.sum("n")).otherwise(1).alias("n"))
    often = toxic.groupBy("form").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    rows = often.toPandas()  # bounded as the sample is
    forms = rows["form"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(forms)
    forms, yes = forms[order], rows["n"].to_numpy()[order]

    def count_other(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, m = FormIndex(forms), len(forms)
        total, every, texts, words = np.zeros(m, np.int64), np.zeros(m, np.int64), 0, 0
        for batch in texts_of(batches):
            for text in batch["text"]:
                keys = word_keys(text)
                hits, times = np.unique(index.hits(keys), return_counts=True)
                total[hits] += 1
                every[hits] += times
                texts += 1
                words += len(keys[0])
        n = np.concatenate([total, every, [texts, words]])
        yield pd.DataFrame({"at": np.flatnonzero(n), "n": n[n > 0]})

    other = sample.where("toxic = 0").select("text").mapInPandas(count_other, "at long, n long")
    found = other.groupBy("at").agg(F.sum("n").alias("n")).toPandas().set_index("at")["n"]
    found = found.reindex(np.arange(2 * len(forms) + 2), fill_value=0).to_numpy()
    no, every, (n_other, words) = found[:len(forms)], found[len(forms):-2], found[-2:]
    n_toxic = sample.where("toxic = 1").count()
    # Both counts a standard error to the worse.
    lift = ((yes - np.sqrt(yes)) / max(1, n_toxic)) / ((no + np.sqrt(no) + 1) / max(1, n_other))
    # And so many toxic texts among those with a form that chance would not bring about one such form of all looked at.
    share, found = max(1, n_toxic) / max(1, n_toxic + n_other), yes + no
    odds = yes * np.log(yes / (found * share)) + no * np.log(np.maximum(no, 1) / (found * max(1e-9, 1 - share)))
    best = np.flatnonzero((lift >= LIFT) & (odds >= np.log(max(1, len(forms)))))
    if len(best) > FORMS:
        order = np.lexsort((forms[best], -yes[best] * np.log(lift[best])))
        turn = _turns(sample.where("toxic = 1"), forms[best], np.argsort(order))
        best = np.sort(best[np.lexsort((np.argsort(order), turn))[:FORMS]])
    return forms[best], (every[best] + 0.5) / max(1, words), np.searchsorted([-t for t in TIERS], -lift[best], "right")


def _turns(toxic: DataFrame, forms: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each form its best place among the forms of any one text, by ``rank``."""
    m = len(forms)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, turn = FormIndex(forms), np.full(m, m)
        for batch in texts_of(batches):
            for text in batch["text"]:
                found = np.unique(index.hits(word_keys(text)))
                found = found[np.argsort(rank[found])]
                turn[found] = np.minimum(turn[found], np.arange(len(found)))
        yield pd.DataFrame({"at": np.arange(m), "turn": turn})

    placed = toxic.select("text").mapInPandas(place, "at long, turn long").groupBy("at").agg(F.min("turn").alias("turn"))
    return placed.toPandas().set_index("at")["turn"].reindex(np.arange(m), fill_value=m).to_numpy()


# --- label model ---------------------------------------------------------------------------------------------------

@dataclass
class LabelModel:
    """Rates of yes votes of each voter for toxic and for other texts, the weight it keeps, and the prior."""

    toxic_rate: np.ndarray
    other_rate: np.ndarray
    weight: np.ndarray
    prior: float

    silence: float

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Voters speak by saying yes; that all are silent counts once."""
        yes = np.log(self.toxic_rate / self.other_rate) * self.weight
        return np.log(self.prior / (1 - self.prior)) + votes @ yes + np.where(votes.any(axis=1), 0.0, self.silence)


def _gap(i: int, cov: np.ndarray, usable: np.ndarray) -> float:
    """How much more often voter ``i`` says yes to toxic texts, from triples of voters; correlated ones only raise it."""
    m = len(cov)
    found = [cov[i, j] * cov[i, k] / cov[j, k] for j in range(m) for k in range(j)
             if usable[i, j] and usable[i, k] and usable[j, k]]
    return min(0.98, float(np.sqrt(np.quantile(found, 0.25)))) if found else 0.0


def fit_label_model(single: np.ndarray, pairs: np.ndarray, prior: float, silence: float) -> LabelModel:
    """From the mean of each vote, the mean of each product of two, the share of toxic texts, and what silence tells."""
    m = len(single)
    cov = pairs - np.outer(single, single)
    scale = prior * (1 - prior)
    spread = np.sqrt(np.maximum(single * (1 - single), 1e-12))
    strong = (cov / np.outer(spread, spread) > 0.02) & ~np.eye(m, dtype=bool)
    independent = np.ones((m, m), bool)
    for _ in range(3):
        usable = strong & independent
        gap = np.array([_gap(i, cov / scale, usable if usable[i].any() else strong) for i in range(m)])
        other = np.clip(single - prior * gap, 2e-3, 0.98)
        toxic = np.clip(single + (1 - prior) * gap, 2e-3, 0.99)
        toxic = np.where(gap > 0, np.maximum(toxic, other), other)  # a voter nothing is known of has no say
        # What the classes leave unexplained: correlation of voters within a class. Such pairs are left out next time.
        within = prior * toxic * (1 - toxic) + (1 - prior) * other * (1 - other)
        rest = (cov - scale * np.outer(gap, gap)) / np.sqrt(np.outer(within, within))
        np.fill_diagonal(rest, 0)
        independent = rest < 0.15
    weight = 1 / (1 + np.clip(np.where(rest > 0.05, rest, 0), 0, 1).sum(axis=1))
    return LabelModel(toxic, other, weight, prior, silence)


# --- the whole -----------------------------------------------------------------------------------------------------

@dataclass
class ToxicityModel:
    forms: np.ndarray
    rates: np.ndarray
    tiers: np.ndarray
    weights: np.ndarray
    bias: float


def _deal(forms: np.ndarray, tiers: np.ndarray) -> np.ndarray:
    """A voter for each form: of its tier, and the same for forms that begin with the same 4 bytes."""
    each = VOTERS // (len(TIERS) + 1)
    _, number = np.unique(forms >> np.uint64(32), return_inverse=True)
    return tiers * each + number % each


class Reader:
    """What the model sees of a text."""

    def __init__(self, forms: np.ndarray, rates: np.ndarray, tiers: np.ndarray):
        self.index, self.rates, self.insults = FormIndex(forms), rates, insult_keys()
        self.voter_of = _deal(forms, tiers)
        self.voter_rates = np.bincount(self.voter_of, rates, VOTERS)
        self.rate = rates.sum()

    def look(self, text: str) -> tuple[np.ndarray, list[bool], list[float]]:
        """(forms found, votes, figures). A lexicon voter says yes if its forms are more than chance for the length."""
        keys = word_keys(text)
        hits = self.index.hits(keys)
        n = len(keys[0])
        votes = np.zeros(VOTERS + _PATTERNS, bool)
        expected = self.voter_rates * n
        votes[:VOTERS] = np.bincount(self.voter_of[hits], minlength=VOTERS) > expected + 2.5 * np.sqrt(expected) + 0.5
        votes[VOTERS:] = pattern_votes(text, keys[0], self.insults)
        usual = self.rate * n
        beyond = (len(hits) - usual) / np.sqrt(usual + 1)
        figures = [min(max(beyond, -3.0), 12.0) / 4, np.log1p(len(hits)), np.log1p(n) / 4]
        return np.unique(hits), votes.tolist(), figures


def _vote_sums(documents: DataFrame, *lists: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of documents, sums of votes, sums of products of two votes) over all whole texts."""
    m = VOTERS + _PATTERNS

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_worker_cache()
        reader, total, n = Reader(*lists), np.zeros((m, m), np.int64), 0
        for batch in texts_of(batches):
            votes = np.array([reader.look(t)[1] for t in batch["text"]], np.int64).reshape(-1, m)
            total += votes.T @ votes
            n += len(votes)
        yield pd.DataFrame({"at": np.arange(m * m + 1), "n": np.append(total.ravel(), n)})

    sums = documents.select("text").mapInPandas(add_up, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    found = sums.toPandas().set_index("at")["n"].reindex(np.arange(m * m + 1), fill_value=0).to_numpy()
    pairs = found[:-1].reshape(m, m).astype(float)
    return int(found[-1]), np.diag(pairs).copy(), pairs


def train_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 800, ridge: float = 5e-5) -> tuple[np.ndarray, float]:
    """Weights and bias for labels between 0 and 1, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    v = np.ones(x.shape[1], np.float32)
    for _ in range(30):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * float(np.linalg.norm(x @ v) ** 2) / len(x) + ridge)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - np.float32(step) * (x.T @ (p - y).astype(np.float32) / len(x) + ridge * np.append(ahead[:-1], 0).astype(np.float32))
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w[:-1].astype(float), float(w[-1])


def learn(documents: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> ToxicityModel:
    """A model from all ``documents`` (``doc_id``, ``text``) and the ``labels`` (``doc_id``, ``toxic``) to learn from."""
    given = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # At most `limit` rows of two numbers are broadcast.
    labelled = documents.join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int"))
    once = labelled.withColumn("_text", F.xxhash64("text")).dropDuplicates(["_text", "toxic"]).drop("_text")
    sample = stored(once, "toxic-sample")
    lists = forms, rates, tiers = choose_forms(sample)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*lists)
        for batch in texts_of(batches):
            seen = [reader.look(t) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "found": [s[0] for s in seen], "votes": [s[1] for s in seen],
                                "figures": [s[2] for s in seen]})

    rows = sample.mapInPandas(
        look, "toxic int, found array<int>, votes array<boolean>, figures array<double>").toPandas()
    toxic = rows["toxic"].to_numpy(float)
    if not len(rows) or toxic.min() == toxic.max():
        p = float(np.clip(toxic.mean(), 1e-3, 1 - 1e-3)) if len(rows) else 0.5
        return ToxicityModel(np.empty(0, np.uint64), np.empty(0), np.empty(0, np.int64), np.zeros(VOTERS + _PATTERNS + 3), float(np.log(p / (1 - p))))
    n, single, pairs = _vote_sums(documents, *lists)
    votes = np.array(rows["votes"].tolist(), float)
    silent = ~votes.any(axis=1)
    silence = np.log((silent[toxic == 1].mean() + 0.01) / (silent[toxic == 0].mean() + 0.01))
    model = fit_label_model(single / n, pairs / n, float(np.clip(toxic.mean(), 0.001, 0.999)), float(silence))
    told = np.log((1 - LABEL_ERRORS) / LABEL_ERRORS)
    odds = model.log_odds(votes) + np.where(toxic == 1, told, -told)
    posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    x = np.zeros((len(rows), len(forms) + votes.shape[1] + 3), np.float32)
    for i, found in enumerate(rows["found"]):
        x[i, found] = 1
    x[:, len(forms):-3] = votes
    x[:, -3:] = np.array(rows["figures"].tolist())
    return ToxicityModel(*lists, *train_logistic(x, posterior))


def score(documents: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """``documents`` with a score in the column ``name``, from ``text`` alone."""
    k = len(model.forms)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        reader, w = Reader(model.forms, model.rates, model.tiers), model.weights
        out = []
        for text in texts:
            found, votes, figures = reader.look(text if isinstance(text, str) else "")
            out.append(model.bias + w[found].sum() + w[k:-3] @ votes + w[-3:] @ figures)
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30))))

    return documents.withColumn(name, scored("text"))
