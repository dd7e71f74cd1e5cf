"""The numpy parts against plain code."""

import functools
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from timberline.llm import codec, hnsw, langid, neardup, packing, sentencepieces, substrings, suffixes, tokens, topk, toxicity

ODD_TEXTS = ["", " ", "a", "ÉCOLE İstanbul ΑΣ don't it'S", "a\x1cb c", "<|endoftext|>x y", "́a é ﬁ ½ 12 你好", "a" * 3000,
             "ªº ß ẞ", "  a  b\t ﬁ É\n 你好𠜎", " " * 50 + "x" + " " * 7, "你好世界" * 30, "internationalization " * 10]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_chunked_ids_equal_the_library(text):
    enc = tokens.encoder()
    assert enc.encode(text) == enc._library(text)


def test_odd_texts_have_the_library_ids():
    enc = tokens.encoder()
    for text in ODD_TEXTS:
        assert enc.encode(text) == enc._library(text), text
    assert enc.encode(None) == b""


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300), st.integers(1, 64))
def test_coded_ids_come_back(ids, block):
    assert codec.decode(codec.encode(np.array(ids, int), block)).tolist() == ids


def test_coder_on_long_and_repetitive_ids():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 65536, 70_000), np.zeros(5000, int), np.tile([7, 65535, 0], 4000), rng.zipf(1.5, 9000) % 65536):
        data = codec.encode(ids)
        assert np.array_equal(codec.decode(data), ids)
    assert len(codec.encode(np.zeros(100_000, int))) < 10_000


def test_damaged_block_is_noticed():
    data = bytearray(codec.encode(np.arange(3000) % 500))
    data[-40] ^= 1
    with pytest.raises(ValueError):
        codec.decode(bytes(data))
    data = bytearray(codec.encode(np.arange(3000) % 500))
    data[30] ^= 1  # in the frequencies
    with pytest.raises(ValueError):
        codec.decode(bytes(data))
    with pytest.raises(ValueError):
        codec.encode(np.array([1 << 32]))


def test_wide_ids_and_order_0_frequencies():
    rng = np.random.default_rng(3)
    for ids in (np.array([70_000]), rng.integers(0, 1 << 32, 5000), rng.integers(0, 200_000, 150_000), np.arange(300_000)):
        assert np.array_equal(codec.decode(codec.encode(ids)), ids)
    # ids that no context foretells cost about their entropy
    ids = np.minimum(rng.geometric(0.02, 200_000), 400)
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert len(codec.encode(ids)) * 8 / len(ids) < entropy + 0.35
    wide = codec._Order0.of(np.arange(3), np.array([1, 10 ** 9, 5]))
    assert wide.freq.min() >= 1 and wide.freq.sum() == 1 << wide.bits


def test_ranks_beyond_20_bits_of_frequencies_come_back():
    rng = np.random.default_rng(4)
    ids = rng.permutation(140_000)  # 18 bits of ranks, 21 of frequencies
    assert codec._Order0.bits_for(len(ids)) > 20
    assert np.array_equal(codec.decode(codec.encode(ids)), ids)


def _valid(bins, lengths, capacity):
    assert sorted(itertools.chain(*bins)) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= capacity for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_packing_is_complete_and_never_worse_than_best_fit(sizes):
    lengths = np.array(sizes)
    start = packing.best_fit(lengths, 40)
    _valid(start, lengths, 40)
    done = packing.local_search([list(b) for b in start], lengths, 40)
    _valid(done, lengths, 40)
    assert -(-lengths.sum() // 40) <= len(done) <= len(start)


def test_local_search_finds_what_best_fit_misses():
    lengths = np.array([6, 5, 4, 4, 6, 5, 5, 5])
    poor = [[0, 1 - 1 + 2], [1, 3], [4], [5], [6], [7]]
    done = packing.local_search(poor, lengths, 10)
    _valid(done, lengths, 10)
    assert len(done) == 4
    # two small ones have to be given for one
    lengths = np.array([3, 3, 5, 4, 5])
    done = packing.local_search([[0, 1, 3], [2], [4]], lengths, 10)
    assert len(done) == 2


def _sorted_suffixes(t, depth):
    keys = sorted(tuple(t[i:i + depth]) for i in range(len(t)))
    common = [0] * len(keys)
    for i in range(1, len(keys)):
        common[i] = next((k for k, (a, b) in enumerate(zip(keys[i - 1], keys[i])) if a != b), min(len(keys[i - 1]), len(keys[i])))
    return keys, common


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.sampled_from([3, 7, 20, 50]), st.sampled_from([1, 8, 10_000]))
def test_induced_sorting_with_and_without_files(symbols, depth, memory):
    t = np.array(symbols, np.int16)
    order, common = suffixes.induced_sort(t, depth, memory)
    keys, expected = _sorted_suffixes(symbols, depth)
    assert sorted(order.tolist()) == list(range(len(symbols)))
    assert [tuple(symbols[i:i + depth]) for i in order] == keys
    assert common.tolist() == expected


def test_earlier_windows_by_brute_force():
    rng = np.random.default_rng(3)
    data = [bytes(rng.integers(97, 99, rng.integers(1, 40)).astype(np.uint8)) for _ in range(40)]
    owner = rng.integers(0, 9, 40)
    number, place = substrings.earlier_windows(data, owner, 6)
    least = {}
    for d, o in zip(data, owner):
        for i in range(len(d) - 5):
            least[d[i:i + 6]] = min(o, least.get(d[i:i + 6], o))
    expected = {(k, i) for k, (d, o) in enumerate(zip(data, owner)) for i in range(len(d) - 5) if least[d[i:i + 6]] < o}
    assert set(zip(number.tolist(), place.tolist())) == expected


def test_every_window_has_its_anchor_inside():
    rng = np.random.default_rng(4)
    data = bytes(rng.integers(97, 103, 3000).astype(np.uint8)) + b"a" * 200
    _, start, size, _, _ = substrings.anchors(data, 50)
    covered = set()
    for s, n in zip(start.tolist(), size.tolist()):
        covered |= set(range(s, s + n - 49))
    assert covered == set(range(len(data) - 49))


def test_prob_min_hash_estimates_probability_jaccard():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    weights_a, weights_b = rng.integers(1, 6, 300), rng.integers(1, 6, 300)
    b = a.copy()
    b[:60] = rng.integers(0, 2**63, 60).astype(np.uint64)
    m = 6000
    agree = np.mean(neardup.prob_min_hash(a, weights_a, m) == neardup.prob_min_hash(b, weights_b, m))
    x, y = dict(zip(a.tolist(), weights_a.tolist())), dict(zip(b.tolist(), weights_b.tolist()))
    exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
    assert abs(agree - exact) < 0.03


def _states(matrices):
    """States at the borders of chunks, by products of three neighbours and their states handed down."""
    if len(matrices) == 1:
        return [((0, ""), sentencepieces.best_exit(matrices[0]))]
    groups = [matrices[i:i + 3] for i in range(0, len(matrices), 3)]
    upper = _states([functools.reduce(sentencepieces.compose, g) for g in groups])
    return [s for g, (entry, leave) in zip(groups, upper) for s in sentencepieces.between(g, entry, leave)]


def test_signs_after_words_are_no_words_of_their_own():
    """Words are merged once whatever sign follows; ids equal the library's for all runs of signs and letters."""
    m = sentencepieces.Model(public_tokenizers.path("piece_bpe_32k.model"))
    signs = ",.;:!?&()\"'*#|/-%$é_0"
    rng = random.Random(4)
    texts = [f"reatesed{a}{b} Ererö{b}{a} x{a}y{b}z {a}{b} q{b}" for a in signs for b in signs]
    texts += [" ".join("".join(rng.choice("aeionrst" + signs) for _ in range(rng.randint(1, 12))) for _ in range(8)) for _ in range(400)]
    for text in texts:
        assert np.frombuffer(m.encode(m.sp.normalize(text)), "<u4").tolist() == m.sp.encode(text), text
    assert "," in m.signs and "▁reatesed" in m.words
    assert "▁reatesed," not in m.words


def test_pieces_equal_the_library_whole_and_in_chunks():
    m = sentencepieces.model()
    rng = np.random.default_rng(6)
    made = ["".join(rng.choice(list("abeht  éß你\n"), 90)) for _ in range(25)]
    for text in [*ODD_TEXTS, *made]:
        expected = np.array(m.sp.encode(text), "<u4").tobytes()
        plain = m.sp.normalize(text) if text else ""
        assert m.encode(plain) == expected, text
        for size in (7, 40):
            if plain and len(plain) < 700:
                parts = [(plain[max(0, a - m.longest):a], plain[a:a + size + m.longest], min(size, len(plain) - a))
                         for a in range(0, len(plain), size)]
                states = _states([m.transfer(*p) for p in parts])
                assert b"".join(m.trace(t, n, a, b) for (_, t, n), (a, b) in zip(parts, states)) == expected, text


def test_unigram_chunks_find_the_best_sum():
    m = sentencepieces.model(unigram=True)
    rng = np.random.default_rng(7)
    for _ in range(20):
        text = "▁" + "".join(rng.choice(list("abeht▁"), 40))
        whole = m.path(text, (0, ""), len(text))
        size = 9
        parts = [(text[max(0, a - m.longest):a], text[a:a + size + m.longest], min(size, len(text) - a)) for a in range(0, len(text), size)]
        matrices = [m.transfer(*p) for p in parts]
        left = matrices[0]
        for x in matrices[1:]:
            left = sentencepieces.compose(left, x)
        right = matrices[-1]
        for x in matrices[-2::-1]:
            right = sentencepieces.compose(x, right)
        value = sum(m.value("", t) for t in whole)
        best = max(v for s, v in left[(0, "")].items() if s[0] == 0)
        assert abs(best - value) < 1e-6 * abs(value) + 1e-6
        assert left[(0, "")].keys() == right[(0, "")].keys()
        states = _states(matrices)
        got = b"".join(m.trace(t, n, a, b) for (_, t, n), (a, b) in zip(parts, states))
        pieces = [m.sp.id_to_piece(int(i)) for i in np.frombuffer(got, "<u4")]
        assert "".join(pieces) == text
        assert abs(sum(m.value("", t) for t in pieces) - value) < 1e-6 * abs(value) + 1e-6


def test_graph_recall_on_clusters_and_copies():
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(20, 24))
    x = centre[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 24))
    graph = hnsw.build(hnsw.lift(x))
    q = x[::30]
    nodes, _ = hnsw.search(graph, np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32), 96)
    true = np.argsort(-(q @ x.T), 1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(true, nodes[:, :40])]) > 0.9
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in graph.links[0])


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.integers(1, 7), st.integers(0, 10_000))
def test_sorted_list_reading_equals_sorting(n, d, k, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-4, 5, (n, d)).astype(float)
    ids = rng.permutation(n) * 3
    q, own = x[:3], ids[:3]
    who, at, score = topk.no_random_access(*topk.sorted_lists(x), ids, q, own, k, first=4, block=2)
    for j in range(len(q)):
        s = x @ q[j]
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != own[j]][:k]
        mine = who == j
        assert at[mine].tolist() == best and score[mine].tolist() == s[best].tolist()


def test_positive_unlabelled_classifier_finds_the_sign():
    rng = np.random.default_rng(9)
    def rows(n, share):
        return [np.flatnonzero(np.append(rng.random() < share, rng.random(30) < 0.2)) for _ in range(n)]
    w, b = toxicity.nn_pu(rows(200, 1.0), rows(1500, 0.2), 31, 0.2)
    assert w[0] + b > 0 > b and w[0] > 5 * np.abs(w[1:]).max()


def test_calibration_recovers_a_temperature():
    rng = np.random.default_rng(10)
    z = rng.normal(size=(20_000, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = (p.cumsum(1) < rng.random((len(z), 1))).sum(1)
    assert abs(langid.calibrate(z * 3, y) - 3) < 0.2
    assert langid.calibrate(z[:0], y[:0]) == 1.0


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(600):
        y = int(rng.integers(0, 2))
        at = np.append(np.unique(np.append(rng.integers(2, 200, 5), y)), 200)
        rows.append((at, np.ones(len(at)), y))
    zeros = []
    for l1 in (0.0, 0.5, 2.0):
        w = langid.ftrl(rows, 2, 201, l1=l1)
        assert w[0, 0] > 0 > w[1, 0] and w[1, 1] > 0 > w[0, 1]
        zeros.append((w[:, 2:200] == 0).mean())
    assert zeros[0] < 0.05 and zeros[1] < zeros[2] and zeros[2] > 0.5


def test_records_are_unpacked_in_place():
    """Reading blobs of records takes the memory of the records, not twice that; their order is that of the blobs."""
    import tracemalloc

    rng = np.random.default_rng(5)
    records = np.zeros(200_000, substrings._PIECE)
    records["owner"], records["start"] = rng.integers(0, 1 << 40, len(records)), np.arange(len(records))
    blobs = [substrings._pack(r) for r in [*np.array_split(records, 50), records[:0]]]
    tracemalloc.start()
    got = substrings._unpack(blobs, substrings._PIECE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, records) and peak < 1.5 * records.nbytes
    assert len(substrings._unpack([], substrings._PIECE)) == 0


def test_forget_drops_the_caches_of_earlier_operators():
    from timberline.llm import common

    assert common.worker_state("a", lambda: [1]) == [1]
    common.forget()
    assert common._kept() == {} and common.worker_state("a", lambda: [2]) == [2]
    common.forget()
