"""Message clusters: TF-IDF over words and word pairs, k-means, central messages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, StopWordsRemover,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from timberline.functions import text as T
from timberline.operators.skew import attach
from timberline.session import cut

# fixed values: document share of a term, random seed
_MAX_SHARE, _SEED = 0.95, 42

_CLUSTERS = "cluster_id int, cluster_size bigint, representative string, is_outlier boolean"


def _terms(entries: DataFrame) -> DataFrame:
    """Words and word pairs of each distinct normalised message, with its number of rows."""
    texts = (
        entries.select(T.cluster_text("message").alias("normalized"))
        .groupBy("normalized").agg(F.count("*").cast("double").alias("weight")))
    words = RegexTokenizer(inputCol="normalized", outputCol="words", pattern=r"\w\w+", gaps=False).transform(texts)
    kept = StopWordsRemover(inputCol="words", outputCol="kept").transform(words)
    pairs = NGram(n=2, inputCol="kept", outputCol="pairs").transform(kept)
    return pairs.select("normalized", "weight", F.concat("kept", "pairs").alias("terms"))


def cluster_logs(entries: DataFrame, max_clusters: int = 20,
                 min_cluster_size: int = 2, vocabulary_size: int = 500) -> tuple[DataFrame, DataFrame]:
    """(clusters, assignments). With fewer than three entries, or no words at all, there are no clusters and every
    row is assigned to none (null). Terms are the ``vocabulary_size`` most used ones.

    Equal messages have equal vectors, so the model is fitted on distinct normalised
    messages weighted by their number of rows, and only the result joins the rows.
    """
    spark = entries.sparkSession
    nowhere = entries.select("file", "line_number", F.lit(None).cast("int").alias("cluster_id"),
                             F.lit(None).cast("boolean").alias("is_outlier"))
    empty = spark.createDataFrame([], _CLUSTERS), nowhere
    n = entries.count()
    if n < 3:
        return empty
    terms = cut(_terms(entries))
    # document shares count rows, not distinct messages
    doc_freq = (terms.select(F.explode(F.array_distinct("terms")).alias("term"), "weight")
                .groupBy("term").agg(F.sum("weight").alias("df")).filter(F.col("df") <= _MAX_SHARE * n))
    uses = (terms.select(F.explode("terms").alias("term"), "weight")
            .groupBy("term").agg(F.sum("weight").alias("uses")))
    vocabulary = doc_freq.join(uses, "term").orderBy(F.col("uses").desc(), "term").limit(vocabulary_size).collect()
    if not vocabulary:
        return empty
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in vocabulary], inputCol="terms", outputCol="tf")
    idf = np.log((1.0 + n) / (1.0 + np.array([r["df"] for r in vocabulary]))) + 1.0
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="tfidf")
    unit = Normalizer(p=2.0, inputCol="tfidf", outputCol="features")
    vectors = unit.transform(weigh.transform(counter.transform(terms)))
    k = min(max_clusters, max(2, n // 3))
    model = KMeans(k=k, seed=_SEED, weightCol="weight").fit(vectors)
    centers = np.array(model.clusterCenters())

    @pandas_udf("double")
    def distance(features: pd.Series, cluster: pd.Series) -> pd.Series:
        rows = np.vstack(features.to_numpy())
        return pd.Series(((rows - centers[cluster.to_numpy()]) ** 2).sum(axis=1))

    placed = (model.transform(vectors)
              .select("normalized", "weight", F.col("prediction").alias("cluster_id"),
                      distance(vector_to_array("features"), "prediction").alias("distance")))
    placed = cut(placed)
    first = entries.select(T.cluster_text("message").alias("normalized"), "file", "line_number",
                           T.clip("message", 200).alias("message"))
    # the most central text of each cluster, then its first message: at most k rows to join
    centre = placed.groupBy("cluster_id").agg(
        F.sum("weight").cast("bigint").alias("cluster_size"),
        F.min_by("normalized", F.struct("distance", "normalized")).alias("normalized"))
    shown = first.join(F.broadcast(centre.select("normalized", "cluster_id")), "normalized").groupBy("cluster_id").agg(
        F.min_by("message", F.struct("file", "line_number")).alias("representative"))
    outlier = F.col("cluster_size") < min_cluster_size
    clusters = centre.join(shown, "cluster_id").select(
        "cluster_id", "cluster_size", "representative", outlier.alias("is_outlier"))
    labelled = placed.join(F.broadcast(centre.select("cluster_id", outlier.alias("is_outlier"))), "cluster_id")
    rows = attach(first.select("normalized", "file", "line_number"),
                  labelled.select("normalized", "weight", "cluster_id", "is_outlier"), ["normalized"], "weight")
    return clusters, rows.select("file", "line_number", "cluster_id", "is_outlier")


def outlier_lines(assignments: DataFrame) -> DataFrame:
    return assignments.filter("is_outlier").select("file", "line_number")


def cluster_distribution(anomalies: DataFrame, max_clusters: int = 12) -> DataFrame:
    """Clusters of the anomalies, largest first."""
    return cluster_logs(anomalies, max_clusters)[0].orderBy(F.col("cluster_size").desc(), "cluster_id")
