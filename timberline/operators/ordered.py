"""Ordered scans (previous row, carried value, row number) without a one-task window.

Rows are range-partitioned by the whole order key, so a burst of equal times or one
big file is split like everything else. The partition number is frozen as ``_cell``
by a reliable checkpoint. Windows run inside a cell; what crosses a cell border is
carried by a table with one row per cell, whose size is the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from timberline.session import cut


def order_cells(df: DataFrame, order: list[str]) -> DataFrame:
    """Freeze a range partitioning of ``df`` by ``order``; the key must be unique.

    Small inputs end up in one cell; the column then says so, and the scans leave out
    the step that carries values across cells.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    frozen = cut(ranged.withColumn("_cell", F.spark_partition_id()))
    alone = frozen.rdd.getNumPartitions() == 1
    marked = F.col("_cell").alias("_cell", metadata={"alone": alone})
    return frozen.select(*[c for c in frozen.columns if c != "_cell"], marked)


def _alone(cells: DataFrame) -> bool:
    return bool(cells.schema["_cell"].metadata.get("alone"))


def _inside(order: list[str]):
    return Window.partitionBy("_cell").orderBy(*[F.col(c).asc_nulls_first() for c in order])


def _join_carry(inner: DataFrame, carry: DataFrame) -> DataFrame:
    # one row per partition of the range exchange, so the broadcast is bounded
    return inner.join(F.broadcast(carry), "_cell")


def with_previous(cells: DataFrame, order: list[str], columns: list[str],
                  name: str = "prev") -> DataFrame:
    """Add a struct of ``columns`` of the preceding row in the whole order."""
    row = F.struct(*columns)
    if _alone(cells):
        return cells.withColumn(name, F.lag(row).over(_inside(order)))
    last = cells.groupBy("_cell").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    carry = last.select("_cell", F.lag("_last").over(Window.orderBy("_cell")).alias("_before"))
    inner = cells.withColumn(name, F.lag(row).over(_inside(order)))
    return (_join_carry(inner, carry)
            .withColumn(name, F.coalesce(name, "_before")).drop("_before"))


def with_carried(cells: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Add the latest non-null ``value`` up to and including each row."""
    upto = _inside(order).rowsBetween(Window.unboundedPreceding, 0)
    if _alone(cells):
        return cells.withColumn(name, F.last(value, ignorenulls=True).over(upto))
    valued = cells.withColumn("_value", value)
    key = F.when(F.col("_value").isNotNull(), F.struct(*order))
    last = valued.groupBy("_cell").agg(F.max_by("_value", key).alias("_last"))
    earlier = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("_cell", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    inner = valued.withColumn(name, F.last("_value", ignorenulls=True).over(upto))
    return (_join_carry(inner, carry)
            .withColumn(name, F.coalesce(name, "_before")).drop("_before", "_value"))


def with_running_sum(cells: DataFrame, order: list[str], weight: Column, name: str) -> DataFrame:
    """Add the sum of ``weight`` over all rows up to and including each row."""
    upto = _inside(order).rowsBetween(Window.unboundedPreceding, 0)
    if _alone(cells):
        return cells.withColumn(name, F.sum(weight).over(upto))
    size = cells.groupBy("_cell").agg(F.sum(weight).alias("_n"))
    earlier = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = size.select("_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inner = cells.withColumn(name, F.sum(weight).over(upto))
    return _join_carry(inner, carry).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def with_earlier_max(cells: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add the largest ``value`` of all rows before each row; null for the first."""
    before = _inside(order).rowsBetween(Window.unboundedPreceding, -1)
    if _alone(cells):
        return cells.withColumn(name, F.max(value).over(before))
    most = cells.groupBy("_cell").agg(F.max(value).alias("_most"))
    earlier = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = most.select("_cell", F.max("_most").over(earlier).alias("_before"))
    inner = cells.withColumn(name, F.max(value).over(before))
    return _join_carry(inner, carry).withColumn(name, F.greatest(name, "_before")).drop("_before")


def with_index(cells: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """Add the 0-based position of each row in the whole order."""
    counted = with_running_sum(cells, order, F.lit(1).cast("bigint"), name)
    return counted.withColumn(name, F.col(name) - 1)


def percentiles(values: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row of exact, linearly interpolated percentiles p95, p99, ...

    Values are reduced to counts first; the running count over the ordered values finds
    the two neighbours of every percentile without bringing the values together.
    """
    counts = (values.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v"))
              .agg(F.count("*").alias("n")))
    summed = with_running_sum(order_cells(counts, ["v"]), ["v"], F.col("n"), "upto")
    total = summed.agg(F.max("upto")).scalar()
    picks = []
    for p in shares:
        k = (total - 1) * F.lit(p)
        low = F.floor(k)
        a = F.min(F.when(F.col("upto") >= low + 1, F.col("v")))
        b = F.min(F.when(F.col("upto") >= F.least(low + 2, total), F.col("v")))
        picks.append((a + F.max(k - low) * (b - a)).alias(f"p{round(p * 100)}"))
    return summed.agg(*picks)


def with_key_index(cells: DataFrame, order: list[str], key: list[str],
                   name: str = "index") -> DataFrame:
    """Add the 0-based position inside each key, where ``key`` is a prefix of ``order``."""
    inside = Window.partitionBy("_cell", *key).orderBy(*order)
    if _alone(cells):
        return cells.withColumn(name, F.row_number().over(inside).cast("bigint") - 1)
    size = cells.groupBy("_cell", *key).agg(F.count("*").alias("_n"))
    # only the first key of a cell can have begun in an earlier cell
    edge = cells.groupBy("_cell").agg(
        F.min(F.struct(*key)).alias("_first"), F.max(F.struct(*key)).alias("_tail"))
    tail = (
        edge.join(size.withColumn("_tail", F.struct(*key)), ["_cell", "_tail"])
        .select("_cell", "_first", "_tail", "_n"))
    # a key filling whole cells adds up over the run of cells it spans
    by_cell = Window.orderBy("_cell")
    run = tail.withColumn("_starts", (F.col("_first") != F.col("_tail")).cast("int"))
    run = run.withColumn("_opens", F.when(
        (F.col("_starts") == 1) | F.lag("_tail").over(by_cell).isNull()
        | (F.lag("_tail").over(by_cell) != F.col("_tail")), 1).otherwise(0))
    run = run.withColumn("_run", F.sum("_opens").over(by_cell))
    run = run.withColumn("_sum", F.sum("_n").over(Window.partitionBy("_run").orderBy("_cell")))
    carry = run.select(
        "_cell", F.lag("_tail").over(by_cell).alias("_key"), F.lag("_sum").over(by_cell).alias("_before"))
    inner = cells.withColumn(name, F.row_number().over(inside).cast("bigint"))
    same = F.col("_key") == F.struct(*key)
    return (_join_carry(inner, carry)
            .withColumn(name, F.col(name) - 1 + F.when(same, F.col("_before")).otherwise(0))
            .drop("_key", "_before"))
