"""Hashed character n-grams of whole texts, and bounded samples of labelled rows."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MULTIPLY = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393, 2869860233], np.uint32)


def letters_only(text: str) -> str:
    """Lower case, with every run of other characters as one space, and a space at both ends."""
    return f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "


def ngrams(text: str, lengths: tuple[int, ...], bits: int) -> np.ndarray:
    """Hash of every n-gram of a text, below 2^bits; n-grams of all given lengths in one array."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found, shift = [], np.uint32(32 - bits)
    for n in lengths:
        size = len(code) - n + 1
        if size < 1:
            continue
        h = np.full(size, n * 40503, np.uint32)
        for k in range(n):
            h = (h ^ code[k:k + size]) * _MULTIPLY[k]
            if k % 2:
                h ^= h >> np.uint32(15)
        found.append(h >> shift)
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def bounded_sample(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, or all where there are fewer, by a hash of id and text.

    Rows of each label are counted, and a row is drawn if its hash falls into the share that gives the
    wanted number, so nothing is ranked and texts are not shuffled. The number of labels must be small,
    as it is for classes. Adds ``_draw``, the hash.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    drawn = rows.withColumn("_draw", F.xxhash64("doc_id", "text")).join(F.broadcast(counts), label)  # one row per label
    place = F.shiftrightunsigned("_draw", 24)  # 40 bits
    return drawn.filter(place.cast("double") * F.col("_n") < F.lit(float(per_label) * 2.0 ** 40)).drop("_n")
