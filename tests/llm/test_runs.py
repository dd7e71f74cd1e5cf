"""Periodic runs against a brute-force search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from conftest import SF
from timberline.llm import runs
from timberline.llm.common import table


def brute(words, least=24):
    """Runs as (start, length, period): for every period, all maximal stretches; of equal stretches the smallest period."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 3 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, n_, p) for (s, n_), p in found.items()), key=lambda r: (r[0], r[2]))


def told(words, found):
    drop = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest())


def _random_words(rng, n):
    out = []
    while len(out) < n:
        part = [rng.choice("abc") for _ in range(rng.randint(1, 60))]
        out += part * rng.choice([1, 1, 1, 2, 4, 9])
    return out[:n]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10 ** 9), st.integers(0, 400))
def test_strip_of_texts_equals_brute_force(seed, n):
    rng = random.Random(seed)
    texts = [[w.encode() for w in _random_words(rng, rng.randint(0, n))] for _ in range(4)]
    got = runs.solve_whole(texts)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(t) for t in texts]


def test_single_word_and_nested_periods():
    for words in (["a"] * 23, ["a"] * 24, ["a"] * 3000, list("aab") * 200, (list("aab") * 9 + ["c"]) * 20, list("ab") * 12, [], ["x"]):
        coded = [w.encode() for w in words]
        assert [tuple(r) for r in runs.solve_whole([coded])[0].tolist()] == brute(coded)


def test_a_wrong_name_is_noticed(monkeypatch):
    """Names that clash are told by the comparison word by word, and other names are taken."""
    real = runs.names

    def poor(codes, top, seed):
        return [h & np.uint64(1 if seed == 1 else 2 ** 64 - 1) for h in real(codes, top, seed)]

    monkeypatch.setattr(runs, "names", poor)
    words = [w.encode() for w in _random_words(random.Random(3), 300)]
    assert [tuple(r) for r in runs.solve_whole([words])[0].tolist()] == brute(words)


@pytest.mark.parametrize("tile", [8, 40, 200])
def test_tiles_stitch_to_whole_runs(spark, tile):
    rng = random.Random(tile)
    texts = [_random_words(rng, 700) for _ in range(6)] + [["a"] * 900, list("abcde") * 150, [str(i) for i in range(300)] * 4]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = runs.find_runs(docs, whole=10, tile=tile).collect()
    got = {r.doc_id: list(zip(r.starts, r.lengths, r.periods)) for r in rows}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    whole = {r.doc_id: tuple(r) for r in runs.find_runs(docs).collect()}
    assert whole == {r.doc_id: tuple(r) for r in rows}


def test_odd_rows(spark):
    long = " ".join(_random_words(random.Random(1), 4000))
    texts = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "a " * 30), (None, "a " * 30), (4, "x y\x1c z " * 30), (5, long),
             (5, long), (None, long), (6, "é ß " * 20), (7, "w")]
    schema = "doc_id bigint, text string, n_runs int, period string, _key int, starts int"
    docs = spark.createDataFrame([(i, t, 1, "p", 2, 3) for i, t in texts], schema).repartition(3)
    for whole in (runs.WHOLE, 1000):
        rows = runs.find_runs(docs, whole=whole, tile=64).collect()
        expected = [(i, *told(w, brute(w))) for i, w in ((i, [b.decode() for b in (t or "").encode().split()]) for i, t in texts)]
        assert sorted(map(str, (tuple(r)[:8] for r in rows))) == sorted(map(str, expected))
    assert runs.find_runs(docs.limit(0)).count() == 0


def test_registered_query_equals_brute_force(spark):
    from timberline.llm import queries

    docs = table(spark, SF, "documents")
    expected = []
    for i, text in docs.select("doc_id", "text").collect():
        words = [w.decode() for w in (text or "").encode().split()]
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        expected.append((i, *told(words, brute(words))))
    rows = queries.op12_periodic_runs(spark, SF).collect()
    assert sorted(tuple(r) for r in rows) == sorted(expected)
    assert sum(r.n_runs > 0 for r in rows) > 10
