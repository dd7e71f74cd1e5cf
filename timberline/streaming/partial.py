"""Map-side sums of a stream: rows of one key and second become one row before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from timberline.functions import timing as M

_MOST = 100_000  # rows a task keeps before it adds up and hands on


def per_second(rows: DataFrame, keys: list[str], column: str = "timestamp") -> DataFrame:
    """(keys, first, last, n): the rows of each key and second that a task reads, as their first and last time and their number.

    A key that fills a stream reaches the stateful operators as one row per task and second. Nothing is kept between
    micro-batches, so this needs no state of its own; times are naive UTC. Rows without a time are left out.
    """
    names = [f"k{i}" for i in range(len(keys))]
    micros = M.epoch_micros(column)
    read = rows.filter(F.col(column).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], micros.alias("at"))

    def added(tables: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(tables).group_by([*names, "second"]).aggregate([("first", "min"), ("last", "max"), ("n", "sum")])
        return table.rename_columns([*names, "second", "first", "last", "n"]).select([*names, "second", "first", "last", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch["at"].to_numpy(zero_copy_only=False)
            kept.append(added([pa.Table.from_arrays(
                [*[batch[n] for n in names], pa.array(at // 1_000_000), batch["at"], batch["at"], pa.array([1] * len(at), pa.int64())],
                names=[*names, "second", "first", "last", "n"])]))
            if sum(t.num_rows for t in kept) > _MOST:
                kept = [added(kept)]
                if kept[0].num_rows > _MOST // 2:
                    yield from kept.pop().combine_chunks().to_batches()
        if kept:
            yield from added(kept).combine_chunks().to_batches()

    types = ", ".join(f"{n} {read.schema[n].dataType.simpleString()}" for n in names)
    summed = read.mapInArrow(run, f"{types}, second bigint, first bigint, last bigint, n bigint")
    naive = {c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("first", "last")}
    return summed.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[v.alias(c) for c, v in naive.items()], "n")
