"""Joining per-key statistics back to rows when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from timberline.session import cut


def attach(rows: DataFrame, stats: DataFrame, keys: list[str], weight: str,
           hot_keys: int = 20_000) -> DataFrame:
    """Left join of ``stats`` (one row per key) to ``rows`` without a hot task.

    ``weight`` is the number of rows of a key. Keys with more than 1/``hot_keys`` of
    the total weight are broadcast: there are fewer than ``hot_keys`` of them, however
    large the tables are. The other keys meet in a shuffle join, where rows that are served
    already or can't match (a key is null) are spread by a hash of their identity, repeatable
    when a task is re-run, so no key brings more than that share to a task.
    """
    values = [c for c in stats.columns if c not in keys]
    stats = cut(stats)  # read for the total and for both kinds of keys
    total = stats.agg(F.sum(weight)).scalar()
    is_hot = F.col(weight) * hot_keys > total
    packed = stats.select(*keys, F.struct(*values).alias("_v"), is_hot.alias("_is_hot"))
    hot = packed.filter("_is_hot").select(*keys, F.col("_v").alias("_hot"))
    # dealt by a hash beside the key; a constant salt would be folded into a filter and deal nothing
    cold = packed.filter("not _is_hot").select(
        *keys, F.xxhash64(*keys).alias("_deal"), F.col("_v").alias("_cold"))
    identity = [c for c in ("file", "line_number") if c in rows.columns] or rows.columns
    open_key = F.col("_hot").isNull()
    for k in keys:
        open_key = open_key & F.col(k).isNotNull()
    spread = F.when(open_key, F.xxhash64(*keys)).otherwise(F.xxhash64(*identity))
    joined = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_deal", spread)
        .join(cold, keys + ["_deal"], "left")
    )
    picked = [F.coalesce(F.col("_hot")[v], F.col("_cold")[v]).alias(v) for v in values]
    return joined.select(*[F.col(c) for c in rows.columns], *picked)


def first_by(value: str | Column, *order: str | Column) -> Column:
    """Aggregate: the value of the row that comes first."""
    return F.min_by(value, F.struct(*order))
