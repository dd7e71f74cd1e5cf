"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from timberline.llm.common import map_rows, spread
from timberline.llm.features import bounded_sample, ngrams

LENGTHS = (1, 2, 3)
BITS = 15
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    """langs, weights (languages x features), bias, inverse document frequencies, temperature."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0


def tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text and their weights of length 1; term frequencies are damped by a logarithm."""
    counts = np.bincount(ngrams(text.lower(), LENGTHS, BITS), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(value @ value)
    return at, value / norm if norm else value


def sum_arrays(parts: DataFrame, levels: tuple[int, ...] = (256, 16, 1)) -> np.ndarray:
    """Sum of binary int64 arrays of one size (columns ``bucket`` and ``data``), in a tree of tasks, so that
    no task meets more than a few hundred of them and the driver gets one."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d, np.int64) for d in pdf["data"])
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "data": [total.tobytes()]})

    for n in levels:
        parts = (parts.withColumn("bucket", F.col("bucket") % n).groupBy("bucket")
                 .applyInPandas(add, "bucket int, data binary"))
    rows = parts.collect()
    return np.frombuffer(rows[0]["data"], np.int64) if rows else np.zeros(0, np.int64)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Number of documents in which each feature occurs, over all rows, and last the number of documents."""
    def count(batches: Iterator[list[list]]) -> Iterator[dict]:
        df = np.zeros((1 << BITS) + 1, np.int64)
        for (texts,) in batches:
            for text in texts:
                seen = np.bincount(ngrams((text or "").lower(), LENGTHS, BITS), minlength=1 << BITS) > 0
                df[:-1] += seen
            df[-1] += len(texts)
        yield {"bucket": [TaskContext.get().partitionId()], "data": [df.tobytes()]}

    total = sum_arrays(map_rows(docs, ["text"], count, "bucket int, data binary"))
    return total if len(total) else np.zeros((1 << BITS) + 1, np.int64)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, features: int, epochs: int = 4,
         alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Follow the regularised leader with elastic-net penalties, one row after the other.

    Per weight it keeps z and n; the weight is 0 while |z| <= l1, which makes the model sparse.
    The last feature is the bias: it has value 1 in every row and no l1 penalty.
    """
    z, n = np.zeros((classes, features)), np.zeros((classes, features))
    for _ in range(epochs):
        for at, value, label in rows:
            zs, ns = z[:, at], n[:, at]
            root = np.sqrt(ns)
            bound = np.full(len(at), l1)
            bound[-1] = 0.0
            w = np.where(np.abs(zs) <= bound, 0.0, -(zs - np.sign(zs) * bound) / ((beta + root) / alpha + l2))
            logit = w @ value
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1
            g = p[:, None] * value
            more = ns + g * g
            z[:, at] = zs + g - (np.sqrt(more) - root) / alpha * w
            n[:, at] = more
    bound = np.full(features, l1)
    bound[-1] = 0.0
    return np.where(np.abs(z) <= bound, 0.0, -(z - np.sign(z) * bound) / ((beta + np.sqrt(n)) / alpha + l2))


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature from 0.25 to 20 with the smallest log loss, by golden section on its logarithm."""
    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]))

    if not len(logits):
        return 1.0
    low, high, g = np.log(0.25), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, per_language: int = 3000, per_shard: int = 1500, min_documents: int = 2) -> Model | None:
    """Fit on the rows of ``docs`` that have a text and a lang; None if there are none.

    Document frequencies are counted over all of them. The regression is fitted on a sample of about
    ``per_language`` rows of each language (a documented bound): tasks fit about ``per_shard`` rows each
    and their weights are averaged; a tenth of the sample is kept out and sets the temperature.
    """
    known = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    df = document_frequencies(known)
    if not df[-1]:
        return None
    idf = np.where(df[:-1] >= min_documents, np.log((1 + df[-1]) / (1 + df[:-1])) + 1, 0.0)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a few classes
    langs = sorted(counts)
    shards = spread(sum(min(n, per_language) for n in counts.values()), per_shard)
    number = {lang: i for i, lang in enumerate(langs)}

    def featurise(batches: Iterator[list[list]]) -> Iterator[dict]:
        for draws, texts, names in batches:
            rows = [tf_idf(t, idf) for t in texts]
            yield {"shard": [d // 16 % shards if d % 10 else -1 for d in draws], "draw": draws,
                   "label": [number[x] for x in names],
                   "at": [a.astype(np.int32).tobytes() for a, _ in rows],
                   "value": [v.astype(np.float32).tobytes() for _, v in rows]}

    sample = map_rows(bounded_sample(known, "lang", per_language), ["_draw", "text", "lang"], featurise,
                      "shard int, draw bigint, label int, at binary, value binary")
    features = (1 << BITS) + 1

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "label"])
        rows = [(np.append(np.frombuffer(a, np.int32), features - 1),
                 np.append(np.frombuffer(v, np.float32), 1.0).astype(float), int(y))
                for a, v, y in zip(pdf["at"], pdf["value"], pdf["label"])]
        if pdf["shard"].iloc[0] < 0:  # kept for the temperature
            return pd.DataFrame({"shard": pdf["shard"], "label": pdf["label"], "at": pdf["at"],
                                 "value": pdf["value"]})
        w = ftrl(rows, len(langs), features)
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "label": [len(rows)], "at": [b""],
                             "value": [w.astype(np.float32).tobytes()]})

    out = sample.groupBy("shard").applyInPandas(fit, "shard int, label int, at binary, value binary").collect()
    fitted = [(r["label"], np.frombuffer(r["value"], np.float32).reshape(len(langs), features))
              for r in out if r["shard"] >= 0]
    if not fitted:  # every sampled row fell to the calibration part
        fitted = [(1, np.zeros((len(langs), features), np.float32))]
    w = sum(n * x for n, x in fitted) / sum(n for n, _ in fitted)
    model = Model(langs, np.ascontiguousarray(w[:, :-1].T), w[:, -1].copy(), idf)
    kept = [r for r in out if r["shard"] < 0]
    logits = np.array([np.frombuffer(r["value"], np.float32) @ model.weights[np.frombuffer(r["at"], np.int32)]
                       + model.bias for r in kept]).reshape(len(kept), len(langs))
    model.temperature = calibrate(logits, np.array([r["label"] for r in kept], int))
    return model


def classify(text: str | None, model: Model | None) -> tuple[str, float]:
    """Language and calibrated probability of a whole text."""
    if model is None or text is None or not _LETTER.search(text):
        return UNKNOWN, 0.0
    at, value = tf_idf(text, model.idf)
    z = (value @ model.weights[at] + model.bias) / model.temperature
    p = np.exp(z - z.max())
    k = int(p.argmax())
    return model.langs[k], float(p[k] / p.sum())


def with_letter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter."""
    @F.pandas_udf("boolean")
    def letter(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and _LETTER.search(t) is not None).astype(bool)

    return docs.filter(letter("text"))


def predict(docs: DataFrame, model: Model | None, *keep: str | Column) -> DataFrame:
    """Add lang_pred and score to the columns ``keep`` (default doc_id) of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything when nothing
    could be learned. Only the text is looked at. Repeated rows get the same result each.
    """
    rows = docs.select(*(keep or ("doc_id",)), F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [classify(t, model) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
