"""Toxicity scores by non-negative positive-unlabelled learning on character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from timberline.llm.common import forget, map_rows
from timberline.llm.features import bounded_sample, letters_only, ngrams

LENGTHS = (5, 6)
BITS = 22


@dataclass
class Model:
    """Hashes of the chosen n-grams in ascending order, their weights, and the bias."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float


def grams(text: str | None) -> np.ndarray:
    """The distinct hashed n-grams of a whole text; word borders are part of them."""
    return np.unique(ngrams(letters_only(text or ""), LENGTHS, BITS))


def nn_pu(x_p: list[np.ndarray], x_u: list[np.ndarray], features: int, prior: float, steps: int = 300,
          rate: float = 0.05, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear classifier of binary features under the non-negative positive-unlabelled risk.

    Risk: prior * E_p[loss(f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)]) with the logistic
    loss. Where the second part falls below 0, which the true negatives' loss cannot, the step goes
    up that part alone. Steps are Adam's over all rows.
    """
    rows = [*x_p, *x_u]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate(rows) if len(owner) else np.zeros(0, int)
    positive = np.arange(len(rows)) < len(x_p)
    n_p, n_u = max(1, len(x_p)), max(1, len(x_u))
    w = np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        f = np.bincount(owner, w[at], len(rows)) + w[-1]
        up = 1 / (1 + np.exp(-np.clip(f, -30, 30)))  # slope of loss(-f); that of loss(f) is up - 1
        loss = np.logaddexp(0, f)
        rest = loss[~positive].sum() / n_u - prior * loss[positive].sum() / n_p
        if rest >= 0:
            slope = np.where(positive, prior / n_p * (up - 1 - up), up / n_u)
        else:
            slope = -np.where(positive, -prior / n_p * up, up / n_u)
        g = np.append(np.bincount(at, slope[owner], features) + l2 * w[:-1], slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def choose(x_p: list[np.ndarray], x_u: list[np.ndarray], most: int, least_z: float = 5.0) -> np.ndarray:
    """The n-grams whose share of documents differs most between the two sets, by a z-score."""
    def share(rows: list[np.ndarray]) -> np.ndarray:
        return np.bincount(np.concatenate(rows), minlength=1 << BITS) / len(rows)

    a, b = share(x_p), share(x_u)
    pooled = (a * len(x_p) + b * len(x_u)) / (len(x_p) + len(x_u))
    z = np.abs(a - b) / np.sqrt(pooled * (1 - pooled) * (1 / len(x_p) + 1 / len(x_u)) + 1e-12)
    z[(a * len(x_p) + b * len(x_u)) < 3] = 0
    top = np.argsort(-z, kind="stable")[:most]
    return np.sort(top[z[top] >= least_z])


def train(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 6000,
          features: int = 4096) -> Model | None:
    """Fit on documents confirmed as toxic and on unlabelled text; None without any of either.

    ``docs`` holds the documents that may be learned from, ``labels`` doc_id and toxic; a label of
    null is no label, and an id with several labels is toxic if one says so. The class prior is
    the share of toxic ones over all labelled documents. The classifier is fitted on at most
    about ``positives`` and ``unlabelled`` rows (documented bounds) in one task.
    """
    marks = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.max("toxic").alias("_toxic")))
    known = docs.select("doc_id", "text").join(marks, "doc_id", "left")
    n, n_toxic = known.agg(F.count("_toxic"), F.sum("_toxic")).first()
    if not n or not n_toxic:
        return None
    prior = min(max(n_toxic / n, 1e-3), 0.99)
    confirmed = bounded_sample(known.filter("_toxic = 1").withColumn("_set", F.lit(1)), "_set", positives)
    others = bounded_sample(known.withColumn("_set", F.lit(0)), "_set", unlabelled)
    sample = confirmed.unionByName(others)

    def featurise(batches: Iterator[list[list]]) -> Iterator[dict]:
        forget()
        for draws, sets, texts in batches:
            yield {"draw": draws, "positive": sets,
                   "grams": [grams(t).astype(np.int32).tobytes() for t in texts]}

    rows = map_rows(sample, ["_draw", "_set", "text"], featurise, "draw bigint, positive int, grams binary")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        pdf = pdf.sort_values(["positive", "draw"])
        x = [np.frombuffer(g, np.int32) for g in pdf["grams"]]
        is_p = pdf["positive"].to_numpy() == 1
        x_p, x_u = [r for r, p in zip(x, is_p) if p], [r for r, p in zip(x, is_p) if not p]
        chosen = choose(x_p, x_u, features)
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        narrow = [[p[p >= 0] for p in (place[r] for r in side)] for side in (x_p, x_u)]
        w, b = nn_pu(*narrow, len(chosen), prior)
        return pd.DataFrame({"grams": [chosen.astype(np.int64).tobytes()], "weights": [w.tobytes()], "bias": [b]})

    got = rows.groupBy().applyInPandas(fit, "grams binary, weights binary, bias double").first()
    return Model(np.frombuffer(got[0], np.int64), np.frombuffer(got[1], float), got[2])


def predict(docs: DataFrame, model: Model | None, *keep: str | Column) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on) to the columns ``keep`` (default doc_id) of ``docs``.

    Only the text is looked at; null counts as empty, and an empty text gets the score of the bias.
    If nothing could be learned every score is 0. Repeated rows get the same result each.
    """
    rows = docs.select(*(keep or ("doc_id",)), F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        dense = np.zeros(1 << BITS, np.float32)
        if model is not None:
            dense[model.grams] = model.weights

        def score(text: str | None) -> float:
            if model is None:
                return 0.0
            found = ngrams(letters_only(text or ""), LENGTHS, BITS)
            found = np.unique(found[dense[found] != 0])
            return float(1 / (1 + np.exp(-np.clip(dense[found].sum(dtype=float) + model.bias, -30, 30))))

        for batch in batches:
            got = [score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())],
                names=[*batch.schema.names[:-1], "score", "predicted"])

    return rows.mapInArrow(run, f"{schema}, score double, predicted int")
