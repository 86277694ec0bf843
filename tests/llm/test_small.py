"""The cores of the operators without Spark, against brute force."""

import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pillflow.llm import collide, kdtree, langid, near, packing, piece_bpe, rans, suffixes, toxicity
from pillflow.llm.tokens import byte_encoder, word_encoder

ODD = ["", " ", "a  b", "a \nb\n", "\n\n\nx", "  a\t\n b", "x  y", "a\0b c", "it's 'stuff 12 34\r\n ok", "Ünï ́c öde　\n",
       "<|endoftext|> a <|endoftext|>", "a\x01b \x01", "日本語 テキスト\nabc", "a\x85 b\x1c c", "Größe, (straße). Don't!\n- x1 y2;z\n", "é" * 50]


@pytest.mark.parametrize("file,make", [("byte_bpe_50k.json", byte_encoder), ("word_bpe_49k.json", word_encoder)])
def test_pieces_are_encoded_like_whole_texts(file, make):
    whole = Tokenizer.from_file(public_tokenizers.path(file))
    whole.encode_special_tokens = True
    encoder = make(public_tokenizers.path(file))
    texts = ODD + [" ".join(ODD), "\n".join(ODD), "The quick, brown fox.\nJumps over; the lazy dog!"]
    for _ in range(2):  # the second time from memory
        found = [np.frombuffer(raw, "<u4").tolist() for raw in encoder.all_ids(texts)]
        assert found == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_piece_model_equals_rank_library():
    ranks = piece_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    bpe = piece_bpe.PieceBpe(piece_bpe.serialise(ranks), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text, raw in zip(ODD, bpe.all_ids(ODD)):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()
    assert not bpe.odd
    tokens = list(ranks)[::97]
    for token in tokens:
        assert bpe.processor.encode(token.decode("latin-1").translate(bpe.table)) == [ranks[token]]


@pytest.mark.parametrize("n", [1, 5, rans.LANES - 1, rans.LANES, rans.LANES + 1, rans.STRIDE, rans.STRIDE + 1, 3 * rans.STRIDE])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50256)
    table = rans.Table(*np.unique(ids, return_counts=True))
    assert table.freq.sum() == 1 << rans.BITS
    words, states, places = table.encode(ids)
    checks = [zlib.crc32(ids[a:a + rans.STRIDE].astype("<u4").tobytes()) for a in range(0, n, rans.STRIDE)]
    block = SimpleNamespace(words=words.tobytes(), states=states.tobytes(), places=places, checks=checks, n_tokens=n, slice=0, block=0)
    assert (rans.decode_block(table, block) == ids).all()
    last = table.decode_part(words, states[-1], places[-1], n - (len(places) - 1) * rans.STRIDE)
    assert (last == ids[(len(places) - 1) * rans.STRIDE:]).all()
    block.checks = [c + 1 for c in checks]
    with pytest.raises(ValueError, match="crc32"):
        rans.decode_block(table, block)


def test_table_gives_every_token_a_share():
    table = rans.Table(np.arange(50257), np.where(np.arange(50257) == 5, 10**9, 1))
    assert table.freq.sum() == 1 << rans.BITS and (table.freq[:50257] > 0).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=0, max_size=60), st.booleans())
def test_suffix_array(letters, thrice):
    text = np.array(letters * (3 if thrice else 1) + [0], np.uint16)
    order = suffixes.suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    before, common = suffixes.permuted_prefixes(text, order)
    for i in range(len(text)):
        if before[i] >= 0:
            a, b = text[i:].tolist(), text[before[i]:].tolist()
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[i] == same


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=6))
def test_repeated_windows(regions):
    counts = Counter(r[i:i + 5] for r in regions for i in range(len(r) - 4))
    expected = [[i for i in range(len(r) - 4) if counts[r[i:i + 5]] > 1] for r in regions]
    assert [found.tolist() for found in suffixes.repeated_windows(regions, 5)] == expected


@pytest.mark.parametrize("data", [b"ab" * 400, bytes(700), bytes(np.random.default_rng(1).integers(0, 4, 2000).tolist())])
def test_equal_windows_have_equal_anchors(data):
    """Each window's run names an anchor that depends on the window alone."""
    h, first, last = suffixes.anchor_runs(np.frombuffer(data, np.uint8), suffixes.Hashes(), 40, 10)
    assert first[0] == 0 and last[-1] == len(data) - 40 and (first[1:] == last[:-1] + 1).all()
    anchor = {}
    for key, a, b in zip(h.tolist(), first.tolist(), last.tolist()):
        for i in range(a, b + 1):
            assert anchor.setdefault(data[i:i + 40], key) == key


def test_weighted_jaccard_and_shingles():
    hashes = suffixes.Hashes()
    a, n = near.shingles("Eins zwei, drei vier FÜNF sechs. eins zwei drei vier fünf", hashes)
    assert sorted(n.tolist()) == [1, 1, 1, 1, 1, 2] and len(a) == 6
    assert near.shingles("zwei Worte", hashes)[0].tolist() == near.shingles("ZWEI, worte!", hashes)[0].tolist()
    assert not len(near.shingles(" .!? ", hashes)[0]) and not len(near.shingles("", hashes)[0])
    one = np.array([1, 2, 3], np.uint64), np.array([1.0, 2, 1])
    two = np.array([2, 3, 9], np.uint64), np.array([1.0, 1, 3])
    assert near.weighted_jaccard(one, two) == pytest.approx(2 / 7)
    assert near.weighted_jaccard((a[:0], n[:0]), (a, n)) == 0.0


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(0)
    base = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    weights = 1 + rng.random(400)
    other = np.sort(np.append(base[:320], rng.integers(0, 1 << 63, 80, dtype=np.uint64)))
    table = dict(zip(base.tolist(), weights))
    heavy = np.array([table.get(x, 1.5) for x in other.tolist()])
    similar = near.weighted_jaccard((base, weights), (other, heavy))
    shared = np.mean(near.bucket_keys(base, weights) == near.bucket_keys(other, heavy))
    assert abs(shared - similar ** near.ROWS) < 0.35
    assert (near.bucket_keys(base, weights) == near.bucket_keys(base, weights)).all()


def test_grams_see_words():
    grams, counts = langid._grams(["Hello, World!", "", "de", "12 34", "ab"])
    assert counts.tolist() == [10, 0, 1, 0, 1]
    assert grams[10].item().to_bytes(4, "big") == b" de " and grams[0].item().to_bytes(4, "big") == b" hel"


def test_forms():
    words = toxicity.word_keys("Trash trashy ÄÖ")
    forms = toxicity.forms_of(words)
    again = toxicity.forms_of(toxicity.word_keys("trash"))
    assert set(again.tolist()) <= set(forms.tolist()) and len(again) == 3
    index = toxicity.FormIndex(np.sort(again))
    assert len(index.hits(words)) == 5 and not len(index.hits(toxicity.word_keys("")))


def test_label_model_finds_the_voters_that_tell():
    rng = np.random.default_rng(3)
    y = rng.random(60000) < 0.1
    rates = [(0.7, 0.01), (0.5, 0.02), (0.6, 0.01), (0.3, 0.3)]
    votes = np.array([np.where(y, rng.random(60000) < t, rng.random(60000) < o) for t, o in rates], float).T
    votes = np.hstack([votes, votes[:, :1]])  # the first voter twice: they must share their say
    model = toxicity.fit_label_model(votes.mean(0), votes.T @ votes / len(votes), 0.1, -1.0)
    assert abs(model.toxic_rate[1] - 0.5) < 0.1 and abs(model.other_rate[1] - 0.02) < 0.02
    assert model.weight[0] < 0.75 < model.weight[1] + 0.3
    odds = model.log_odds(votes)
    assert ((odds > 0) == y).mean() > 0.95


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_packing_keeps_all_and_overfills_none(lengths):
    bins = packing.pack_lengths(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= len(packing.best_fit(lengths, 64))


def test_local_search_empties_bins():
    lengths = [6, 4, 7, 3, 5, 5]
    assert len(packing.improve([[0, 3], [1, 2], [4], [5]], lengths, 10)) == 3
    assert len(packing.improve([[0], [1], [2], [3], [4], [5]], lengths, 10)) == 3
    # one for one: 6+3 and 7+3 ... 4 must change places with 3
    assert len(packing.improve([[0, 3], [1, 4], [2]], lengths, 10)) == 3


def test_tree_search_is_exact():
    rng = np.random.default_rng(5)
    rows = rng.integers(-6, 7, (3000, 5)).astype(float)
    ids = rng.permutation(3000)
    tree = kdtree.build(ids, rows)
    assert sorted(tree.ids.tolist()) == list(range(3000))
    for q in range(20):
        query = rows[q]
        bounds = np.maximum(query, 0) @ tree.high.T + np.minimum(query, 0) @ tree.low.T
        scores = (rows @ query).astype(int)
        best = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != ids[q])[:5]
        assert kdtree.search(tree, ids[q], query, 5, None, bounds) == [(-s, i) for s, i in best]
        least = -best[4][0]
        assert kdtree.search(tree, ids[q], query, 5, least, bounds) == [(-s, i) for s, i in best]


def test_collisions_find_most_neighbours():
    rng = np.random.default_rng(6)
    rows = rng.standard_normal((4000, 16))
    index = collide.LineIndex(rows)
    hits = 0
    for q in range(20):
        near_ = index.candidates(rows[q], 1200)
        assert len(near_) >= 1200
        true = np.argsort(((rows - rows[q]) ** 2).sum(1))[1:11]
        hits += len(np.intersect1d(near_, true))
    assert hits >= 190
    assert len(index.candidates(rows[0], 4000)) == 4000


def test_packing_searches_all_underfull_bins():
    """A group with thousands of underfull bins after best fit, which full bins alone can hold."""
    lengths = [2058, 1044, 1034, 1004, 1004] * 4000
    bins = packing.pack_lengths(lengths, 4096)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert len(bins) == 6000 and all(sum(lengths[i] for i in b) == 4096 for b in bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=40))
def test_packing_leaves_no_step(lengths):
    bins = packing.improve([[i] for i in range(len(lengths))], lengths, 40)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    own = [[lengths[i] for i in b] for b in bins]
    for g in range(len(own)):
        gives = own[g] + [x + y for i, x in enumerate(own[g]) for y in own[g][i + 1:]]
        for t in range(len(own)):
            for gain in (v - back for v in gives for back in [0, *own[t]] if t != g):
                assert not (0 < gain <= 40 - sum(own[t]) and sum(own[t]) + gain > sum(own[g]))


def test_collisions_are_searched_from_the_level_before():
    """The lowest level with enough collisions, as by the definition, whatever query came before."""
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((300, 16))
    index = collide.LineIndex(rows)
    levels = []
    for scale in (1, 6, 1):
        query = scale * rng.standard_normal(16)
        apart = np.abs((rows @ index.lines - query @ index.lines).astype(np.float32))
        level = 0
        while np.count_nonzero((apart <= np.float32(collide.START * index.spread * collide.WIDER**level)).mean(axis=1) >= collide.THRESHOLD) < 90:
            level += 1
        found = index.candidates(query, 90)
        assert index.level == level
        assert len(found) >= 90
        levels.append(level)
    assert levels[0] < levels[1] > levels[2]
