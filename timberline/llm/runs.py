"""Periodic runs of words: scale tiles, boundary Z-functions, and stitching by (document, period).

Periods are taken octave by octave, P to 2P - 1. A run of period p in that octave is at least 3p long, so it
holds boundaries (multiples of P) from which p words and more repeat. For a boundary b, Z[p] is the number of words for
which the text from b + p on repeats the text from b on; the same leftwards gives the words before b. Both
together are the stretch around b with period p. All boundaries of a tile are solved at once: blocks of max(P, 8) words have
names (hashes of pairs of names of half the length), one comparison per word finds the pairs (b, p) whose Z-value
reaches a block, and descending powers of two measure these.

Texts up to ``WHOLE`` characters are one tile in every octave. Longer ones are exploded into overlapping tiles, longer
for longer periods, which are dealt over the cluster; a long run comes back as fragments that overlap by its period
or more, and is stitched after a shuffle by document and period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from timberline.llm.common import map_rows

LEAST_LENGTH = 24  # words of a run
LEAST_REPEATS = 3  # periods of a run
WHOLE = 65_536  # characters of a text that is solved in one piece
TILE = 8_192  # words of a tile's core, or 16 P in octaves where that is more
STRIP = 131_072  # words that are solved together
ROWS = 500  # rows that are turned into words at a time

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def names(codes: np.ndarray, top: int, seed: int) -> list[np.ndarray]:
    """Names of all blocks of 1, 2, 4, ... 2^top words: equal blocks have equal names."""
    with np.errstate(over="ignore"):
        found = [_mixed((codes.astype(np.uint64) + np.uint64(seed)) * _A)]
        for k in range(top):
            h, half = found[-1], 1 << k
            if len(h) <= half:
                break
            found.append(_mixed(h[:-half] * _A + (h[half:] ^ (h[half:] >> np.uint64(32)))))
    return found


def repeated(named: list[np.ndarray], x: np.ndarray, y: np.ndarray, leftwards: bool) -> np.ndarray:
    """Z-values: for how many words the text from y on (or before y) equals that from x on (before x); x < y."""
    total = np.zeros(len(x), np.int64)
    for k in range(len(named) - 1, -1, -1):
        h, size = named[k], 1 << k
        if leftwards:
            a, b = x - total - size, y - total - size
            same = a >= 0
        else:
            a, b = x + total, y + total
            same = b < len(h)
        same[same] = h[a[same]] == h[b[same]]
        total[same] += size
    return total


def fragments(codes: np.ndarray, longest: int, first: int = 0, last: int | None = None,
              octaves: tuple[int, int] = (0, 62)) -> np.ndarray:
    """Rows (period, start, end): stretches with a period around the boundaries from ``first`` to before ``last``.

    ``longest`` is the length in words of the longest text in ``codes``; between texts stand codes that occur once. Of stretches
    with the same ends and at least twice the period, only the smallest period is returned. Every row is
    compared word by word; should two blocks share a name wrongly, all is done again with other names.
    """
    last = len(codes) if last is None else last
    top = max(3, int(longest).bit_length())
    for seed in count(1):
        named, found = names(codes, top, seed), []
        for k in range(octaves[0], octaves[1]):
            step = 1 << k
            if LEAST_REPEATS * step > longest or max(k, 3) >= len(named):
                break
            block = named[max(k, 3)]
            y = np.arange(first + step, min(len(block), last + 2 * step), dtype=np.int64)
            x = ((y >> k) - 1) << k
            hit = (block[x] == block[y]) & (x >= first) & (x < last) if len(y) else np.zeros(0, bool)
            x, y = x[hit], y[hit]
            if len(x):
                low = x - repeated(named, x, y, True)
                high = y + repeated(named, x, y, False)
                found.append(np.stack([y - x, low, high], axis=1))
        if not found:
            return np.zeros((0, 3), np.int64)
        rows = np.unique(np.concatenate(found), axis=0)
        rows = rows[np.lexsort((rows[:, 0], rows[:, 2], rows[:, 1]))]
        # rows of one stretch follow one another, smallest period first; a multiple of it goes
        again = np.zeros(len(rows), bool)
        again[1:] = (rows[1:, 1:] == rows[:-1, 1:]).all(axis=1)
        rows = rows[~(again & (rows[:, 2] - rows[:, 1] >= 2 * rows[:, 0]))]
        if all(np.array_equal(codes[a:b - p], codes[a + p:b]) for p, a, b in rows.tolist()):
            return rows
    raise AssertionError


def long_enough(rows: np.ndarray) -> np.ndarray:
    """Fragments of whole texts that are runs: (start, length, period) by start, then period."""
    size = rows[:, 2] - rows[:, 1]
    kept = rows[size >= np.maximum(LEAST_LENGTH, LEAST_REPEATS * rows[:, 0])]
    out = np.stack([kept[:, 1], kept[:, 2] - kept[:, 1], kept[:, 0]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


class Codes(dict):
    """A number for every word, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []  # bytes are split at space and 09 to 0D only


def solve_whole(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Runs of each text, all solved in one strip with a code of its own between texts."""
    codes = Codes()
    parts, at, places = [], 0, []
    for words in texts:
        places.append(at)
        parts += [np.fromiter(map(codes.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
        at += len(words) + 1
    strip = np.concatenate(parts)
    starts = np.array(places)
    ends = starts + [len(w) for w in texts]
    strip[ends] = -1 - np.arange(len(texts))
    rows = fragments(strip, max(map(len, texts)))
    owner = np.searchsorted(starts, rows[:, 1], side="right") - 1
    rows[:, 1:] -= starts[owner][:, None]
    order = np.argsort(owner, kind="stable")
    rows, border = rows[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))
    return [long_enough(rows[a:b]) if b > a else rows[:0] for a, b in zip(border, border[1:])]


def report(words: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
    """The digest columns of one text from its runs (start, length, period), ordered by start and period."""
    listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
    top, kept = None, words
    if runs:
        keep = np.ones(len(words), bool)
        for s, n, p in runs:
            keep[s + p:s + n] = False
            if top is None or n * top[2] > top[1] * p:
                top = (s, n, p)
        kept = [words[i] for i in np.flatnonzero(keep).tolist()]
    start, length, period = top or (None, None, None)
    return {"n_runs": len(runs), "start": start, "length": length, "period": period,
            "exponent_milli": 1000 * length // period if top else None, "runs_sha256": listed,
            "collapsed_sha256": hashlib.sha256(b" ".join(kept)).hexdigest(), "starts": [r[0] for r in runs],
            "lengths": [r[1] for r in runs], "periods": [r[2] for r in runs]}


_OUT = ("n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, "
        "collapsed_sha256 string, starts array<bigint>, lengths array<bigint>, periods array<bigint>")
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _columns(rows: list[tuple], first: str) -> dict:
    return {first: [r[0] for r in rows]} | {n: [r[1][n] for r in rows] for n in _NAMES}


def _whole(docs: DataFrame, rewrite: Rewrite) -> DataFrame:
    def run(batches: Iterator[list[list]]) -> Iterator[dict]:
        for ids, texts in batches:
            a = 0
            while a < len(ids):  # strips of about STRIP words
                some, n = [], 0
                while a + len(some) < len(ids) and n < STRIP:
                    some.append(rewrite(ids[a + len(some)], words_of(texts[a + len(some)])))
                    n += len(some[-1]) + 1
                done = solve_whole(some)
                yield _columns([(i, report(w, [tuple(x) for x in r.tolist()]))
                                for i, w, r in zip(ids[a:a + len(some)], some, done)], "doc_id")
                a += len(some)

    return map_rows(docs, ["doc_id", "text"], run, f"doc_id bigint, {_OUT}", ROWS)


def tiles(n: int, tile: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Tiles of a text of n words: first octave, octave after the last, then the words it begins and ends with, and its core's
    borders. Octaves that share a core of ``tile`` words share their tiles; from 16 P > ``tile`` on every octave has its own."""
    k = 0
    while LEAST_REPEATS << k <= n:
        upto = k + 1
        while 16 << upto <= tile:
            upto += 1
        unit = 1 << (upto - 1)
        core, halo = max(unit, max(tile, 16 * unit) // unit * unit), 8 * max(unit, 8)
        for c in range(0, n, core):
            yield k, upto, max(0, c - halo), min(n, c + core + halo), c, min(n, c + core)
        k = upto


def _tiled(long: DataFrame, tile: int, rewrite: Rewrite) -> DataFrame:
    """Fragments of long texts: _key, period, low, high (words)."""
    def explode(batches: Iterator[list[list]]) -> Iterator[dict]:
        for keys, ids, texts in batches:
            for key, i, text in zip(keys, ids, texts):
                words = rewrite(i, words_of(text))
                codes = Codes()
                coded = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
                for k, upto, a, b, c, d in tiles(len(coded), tile):
                    yield {"_key": [key], "k": [k], "upto": [upto], "at": [a], "low": [c - a], "high": [d - a],
                           "n": [len(words)], "codes": [coded[a:b].tobytes()]}

    def solve(batches: Iterator[list[list]]) -> Iterator[dict]:
        for keys, ks, uptos, ats, lows, highs, ns, data in batches:
            for key, k, upto, at, low, high, raw in zip(keys, ks, uptos, ats, lows, highs, data):
                codes = np.frombuffer(raw, np.int32).astype(np.int64)
                rows = fragments(codes, len(codes), low, high, (k, upto))
                yield {"_key": [key] * len(rows), "period": rows[:, 0], "low": rows[:, 1] + at, "high": rows[:, 2] + at}

    exploded = map_rows(long, ["_key", "doc_id", "text"], explode,
                        "_key string, k int, upto int, at bigint, low bigint, high bigint, n bigint, codes binary", ROWS)
    dealt = exploded.repartition("_key", "k", "at")
    return map_rows(dealt, dealt.columns, solve, "_key string, period bigint, low bigint, high bigint", ROWS)


def stitched(found: DataFrame) -> DataFrame:
    """Runs (_key, start, length, period) from fragments: those of one text and period that share at least a period of words
    belong together; of several periods of one stretch the smallest is its period."""
    order = Window.partitionBy("_key", "period").orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("low") > before - F.col("period")), 1).otherwise(0)
    pieces = found.distinct().withColumn("_opens", opens)
    pieces = pieces.withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = (pieces.groupBy("_key", "period", "_run").agg(F.min("low").alias("start"), F.max("high").alias("end"))
             .withColumn("length", F.col("end") - F.col("start"))
             .filter(F.col("length") >= F.greatest(F.lit(LEAST_LENGTH), LEAST_REPEATS * F.col("period"))))
    return whole.groupBy("_key", "start", "length").agg(F.min("period").alias("period"))


def as_written(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


def find_runs(docs: DataFrame, whole: int = WHOLE, tile: int = TILE, rewrite: Rewrite = as_written) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its runs, the strongest of them, and digests.

    A run is a stretch of at least 24 words and three periods with smallest period q that no neighbouring word
    extends; runs of different periods may overlap. Returns doc_id, n_runs, the run with the greatest length/period
    (ties: smallest start, then period) as start, length, period, exponent_milli; runs_sha256 over the lines
    ``start,length,period`` and collapsed_sha256 over the words that no run holds after its first q words; and
    all runs as the arrays starts, lengths, periods.

    Words are what spaces and the characters 09 to 0D separate. Null and empty texts have no words, no runs and the digests of
    nothing. Repeated rows and null ids give a row each; other columns are ignored. A document is one row,
    so its words and runs fit in a task; texts of over ``whole`` characters are solved in tiles all the same.
    ``rewrite`` may change the words of a document before they are searched, given its doc_id; it must not depend on anything else.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    is_long = F.length("text") > whole
    short = rows.filter(F.coalesce(~is_long, F.lit(True)))
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"), 256)
    long = rows.filter(is_long).withColumn("_key", key)
    # many runs of few texts: one row per text, bounded by the text itself
    listed = (stitched(_tiled(long, tile, rewrite)).groupBy("_key")
              .agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
              .select(F.col("_key").alias("_of"), F.col("runs.start").alias("starts"), F.col("runs.length").alias("lengths"),
                      F.col("runs.period").alias("periods")))
    met = long.join(listed, F.col("_key") == F.col("_of"), "left")

    def digest(batches: Iterator[list[list]]) -> Iterator[dict]:
        for ids, texts, starts, lengths, periods in batches:
            for i, text, *runs in zip(ids, texts, starts, lengths, periods):
                yield _columns([(i, report(rewrite(i, words_of(text)), list(zip(*[r or [] for r in runs]))))], "doc_id")

    long_rows = map_rows(met, ["doc_id", "text", "starts", "lengths", "periods"], digest, f"doc_id bigint, {_OUT}", ROWS)
    return _whole(short, rewrite).unionByName(long_rows)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Makes a tenth of the documents periodic from some word on: with h the crc32 of the decimal doc_id and g = h // 10, n > 0 words
    with h % 10 = 0 repeat p = 1 + (n - a) // (3 + g % 8) words from word a = g % n on. Rows without an id stay as they are."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]
