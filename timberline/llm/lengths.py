"""Token counts: an exact histogram of encoded lengths, and what every context limit makes of it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from timberline.llm.common import cut, map_rows
from timberline.llm.tokens import encoder


def encoded_lengths(docs: DataFrame, end_ids: int = 0, tokenizer: str | None = None) -> DataFrame:
    """``length`` of every whole text in ids (null: empty), plus ``end_ids`` for markers."""
    def count(batches: Iterator[list[list]]) -> Iterator[dict]:
        enc = encoder(tokenizer)
        for (texts,) in batches:
            yield {"length": [len(enc.encode(t)) // 4 + end_ids for t in texts]}

    return map_rows(docs, ["text"], count, "length bigint")


def length_table(lengths: DataFrame, block: int = 1024) -> DataFrame:
    """One row per context limit at which anything changes, that is per length that occurs.

    length, n_docs (of this length), docs_upto and docs_above (longer), tokens_upto, n_tokens (of all
    documents), kept_tokens (if every document is cut at this limit), lost_tokens, and ``quantile`` (the share
    of documents of at most this length). For a limit between two lengths, kept_tokens is that of the shorter one
    plus docs_above for every token between; a quantile q is the first length with quantile >= q.

    Documents are counted per length before anything else, so the table has as many rows as lengths. Its
    suffix sums are taken inside blocks of ``block`` lengths and over one row per block. No documents, no rows.
    """
    counts = cut(lengths.filter("length is not null").groupBy("length").agg(F.count("*").alias("n_docs"))
                 .withColumn("_block", F.floor(F.col("length") / block)))
    tokens = F.col("length") * F.col("n_docs")
    totals = counts.groupBy("_block").agg(F.sum("n_docs").alias("_n"), F.sum(tokens).alias("_t"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = totals.select(
        "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_docs_before"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_tokens_before"),
        F.sum("_n").over(whole).alias("_docs"), F.sum("_t").over(whole).alias("n_tokens"))
    inside = Window.partitionBy("_block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    rows = (counts.withColumn("_d", F.sum("n_docs").over(inside)).withColumn("_t", F.sum(tokens).over(inside))
            .join(carried, "_block"))
    docs_upto, tokens_upto = F.col("_docs_before") + F.col("_d"), F.col("_tokens_before") + F.col("_t")
    above = F.col("_docs") - docs_upto
    kept = tokens_upto + above * F.col("length")
    return rows.select("length", "n_docs", docs_upto.alias("docs_upto"), above.alias("docs_above"),
                       tokens_upto.alias("tokens_upto"), "n_tokens", kept.alias("kept_tokens"),
                       (F.col("n_tokens") - kept).alias("lost_tokens"), (docs_upto / F.col("_docs")).alias("quantile"))


def token_counts(docs: DataFrame, end_ids: int = 0, tokenizer: str | None = None) -> DataFrame:
    """``length_table`` of the encoded documents; only text is looked at, repeated rows count each."""
    return length_table(encoded_lengths(docs, end_ids, tokenizer))
