"""Template mining and line signatures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from timberline import constants as K
from timberline.functions import text as T
from timberline.operators.skew import first_by
from timberline.session import cut


def with_template(entries: DataFrame) -> DataFrame:
    """Compute the template once; later steps use the column.

    The same as ``text.extract_template``, a column at a time: an expression is searched for only in texts that
    hold the characters it needs.
    """
    if "template" in entries.columns:
        return entries
    text = F.col("_text")
    staged = entries.withColumn("_text", T.strip(F.col("message")))
    for (pattern, to), needs in zip(K.TEMPLATE_RULES, K.TEMPLATE_NEEDS, strict=True):
        found = F.regexp_replace(text, pattern, to)
        if needs:
            may = reduce(lambda a, b: a & b, [F.contains(text, F.lit(c)) for c in needs])
            found = F.when(may, found).otherwise(text)
        staged = staged.withColumn("_text", found)
    staged = staged.withColumn("_text", F.when(
        F.contains(text, F.lit(">")), T.collapse_placeholders(text)).otherwise(text))
    return staged.withColumn("template", T.squeeze(text)).drop("_text")


def template_counts(entries: DataFrame) -> DataFrame:
    """(template, count, first_line, example): pre-aggregated before the shuffle."""
    return _counted(with_template(entries), first_by(T.clip("message", 300), "line_number", "file").alias("example"))


def _counted(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.groupBy("template").agg(
        F.count("*").alias("count"), F.min(F.struct("line_number", "file")).alias("first_seen"), *more)


def _kept(counts: DataFrame, top_n: int) -> DataFrame:
    top = counts.orderBy(F.col("count").desc(), "first_seen").limit(top_n)
    ranked = Window.orderBy(F.col("count").desc(), "first_seen")  # at most top_n rows
    return top.withColumn("template_id", F.row_number().over(ranked) - 1)


def mine_templates(entries: DataFrame, top_n: int = 50, min_count: int = 1) -> DataFrame:
    """The most frequent templates with count, share and first example."""
    total = entries.agg(F.count("*")).scalar()
    return (
        _kept(template_counts(entries), top_n).filter(F.col("count") >= min_count)
        .select("template_id", F.col("template").alias("pattern"), "count", "example",
                F.round(F.col("count") / total, 4).alias("frequency"))
    )


def assign_templates(entries: DataFrame, top_n: int = 50, min_count: int = 1) -> DataFrame:
    """(file, line_number, template_id); templates beyond the top share one last id.

    The templates are computed once and cut off: for a join the planner puts the expression of the key together from all
    columns it is made of, which for the chain in ``with_template`` grows exponentially and fills the driver.
    """
    rows = cut(with_template(entries).select("file", "line_number", "template"))
    top = cut(_kept(_counted(rows), top_n).select("template", "template_id", "count"))  # at most top_n rows
    catch_all = top.filter(F.col("count") >= min_count).agg(F.count("*")).scalar().cast("int")
    joined = rows.join(F.broadcast(top), "template", "left")
    kept = joined.filter(F.col("count").isNull() | (F.col("count") >= min_count))
    return kept.select("file", "line_number", F.coalesce("template_id", catch_all).alias("template_id"))


def repeating_signatures(lines: DataFrame, n: int = 15) -> DataFrame:
    """Line shapes seen more than twice among the n most frequent."""
    total = lines.agg(F.count("*")).scalar()
    counts = (
        lines.select(T.line_signature("text").alias("sig"), "line_number", "file")
        .filter("sig <> ''").groupBy("sig")
        .agg(F.count("*").alias("count"), F.min(F.struct("file", "line_number")).alias("seen")))
    top = counts.orderBy(F.col("count").desc(), "seen").limit(n).filter("count > 2")
    return top.select(T.clip("sig", 80).alias("signature"), "count",
                      F.round(F.col("count") / total * 100, 2).alias("percentage"))


def error_patterns(lines: DataFrame, n: int = 20) -> DataFrame:
    """Shapes of the lines holding an error word."""
    counts = (
        lines.filter(T.contains_any(F.lower("text"), K.ERROR_WORDS))
        .select(T.line_signature("text", with_hex=False).alias("sig"), "line_number", "file")
        .groupBy("sig").agg(F.count("*").alias("count"), F.min(F.struct("file", "line_number")).alias("seen")))
    count = F.col("count")
    return counts.orderBy(count.desc(), "seen").limit(n).select(
        T.clip("sig", 100).alias("signature"), "count",
        F.when(count > 5, "HIGH").when(count > 2, "MEDIUM").otherwise("LOW").alias("severity"))
