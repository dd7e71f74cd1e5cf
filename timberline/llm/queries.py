"""One query per operator over its whole table, and the SQL it is checked with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from timberline.llm import hnsw, langid, lengths, negatives, neardup, packing, runs, sentencepieces, simhash, substrings, token_files, topk, toxicity
from timberline.llm.common import remainder, table
from timberline.session import scratch_dir


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest(sentencepieces.encode(table(spark, sf_dir, "documents")))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = langid.train(docs.filter(~held_out))
    return langid.predict(docs, model, "doc_id", held_out.alias("held_out"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.token_counts(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.read(spark.read.parquet(path))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    learn = remainder("doc_id", 5) != 0
    model = toxicity.train(docs.filter(learn), table(spark, sf_dir, "labels").filter(learn))
    return toxicity.predict(docs, model, "doc_id", held_out.alias("held_out"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(rows, rows.filter("vec_id % 20 = 0"), 20)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.filter("vec_id % 50 = 0"), 5)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), rows.filter("vec_id % 100 = 0"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.find_runs(table(spark, sf_dir, "documents"), rewrite=runs.planted).drop("starts", "lengths", "periods")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_sentencepiece, op3_minhash_near_dedup, op4_language_id,
                                op5_suffix_dedup, op6_token_counts, op7_token_files,
                                   op8_toxicity, op9_nearest_neighbours, op10_exact_top_k, op11_hard_negatives, op12_periodic_runs,
                                   op13_simhash_near_dedup)}
ORACLES: dict[str, str] = {
    "op10_exact_top_k": """
with good as (
    select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings
    where vec_id is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
    select a.vec_id as query_id, b.vec_id,
           list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
    from good a join good b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from pairs qualify rank <= 5""",
    "op11_hard_negatives": """
with good as (
    select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
           list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
    from good a join good b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id,
       row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives join pairs using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10""",
}
