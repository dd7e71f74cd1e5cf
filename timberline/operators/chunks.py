"""Priority chunks of log files.

A chunk is a row (file, chunk_type, priority, start_index, end_index, line_count,
error_count, label). Line positions come from an ordered scan; everything after the
first aggregation works on chunk rows, of which there is one per thousands of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from timberline import constants as K
from timberline.functions import text as T
from timberline.operators.ordered import (
    order_cells, with_carried, with_earlier_max, with_key_index, with_previous, with_running_sum)
from timberline.session import cut

_ORDER = ["file", "line_number"]


def index_lines(lines: DataFrame) -> DataFrame:
    """Per line its position in the file, error flags, component and date."""
    upper, low = F.upper("text"), F.lower("text")
    marked = lines.select(
        *_ORDER, T.contains_any(low, K.CHUNK_WORDS).alias("is_error"),
        T.contains_any(upper, ["ERROR", "WARN", "FATAL", "CRITICAL"]).alias("is_high"),
        T.blank_to_null(F.regexp_extract("text", r"\[(\w+)\]", 1)).alias("component"),
        T.blank_to_null(F.regexp_extract("text", r"(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})", 1)).alias("date"))
    return with_key_index(order_cells(marked, _ORDER), _ORDER, ["file"])


def _chunk(grouped, kind: str, priority: int, label: Column) -> DataFrame:
    return grouped.agg(
        F.min("index").alias("start_index"), F.max("index").alias("end_index"),
        F.count("*").alias("line_count"), F.count_if("is_error").alias("error_count"),
    ).select("file", F.lit(kind).alias("chunk_type"), F.lit(priority).alias("priority"), "start_index",
             "end_index", "line_count", "error_count", label.alias("label"))


def error_density(indexed: DataFrame, size: int = K.CHUNK_LINES) -> DataFrame:
    """Fixed blocks with at least one priority word; the label is the share of error lines."""
    blocks = indexed.groupBy("file", F.floor(F.col("index") / size).alias("block"))
    share = F.round(F.col("error_count") / F.col("line_count"), 6).cast("string")
    return _chunk(blocks, "error_dense", 5, share).filter("error_count > 0")


def severity_chunk(indexed: DataFrame) -> DataFrame:
    """All high-severity lines of a file as one chunk."""
    return _chunk(indexed.filter("is_high").groupBy("file"), "severity_high", 4, F.lit("high"))


def component_chunks(indexed: DataFrame, min_lines: int = 5) -> DataFrame:
    named = indexed.filter("component is not null").groupBy("file", "component")
    return _chunk(named, "component", 3, F.col("component")).filter(
        (F.col("error_count") > 0) & (F.col("line_count") >= min_lines))


def temporal_chunks(indexed: DataFrame, min_lines: int = 10, last_only: bool = False) -> DataFrame:
    """Lines under one date, undated lines staying with the date above them.

    A date that comes back after another one makes a chunk of its own; with ``last_only`` its
    earlier lines are dropped.
    """
    stamp = F.when(F.col("date").isNotNull(), F.struct("file", "date"))
    dated = with_carried(indexed, _ORDER, stamp, "day")
    stepped = with_previous(dated, _ORDER, ["day"])
    own = F.col("day.file") == F.col("file")
    fresh = F.coalesce(F.col("prev.day") != F.col("day"), F.lit(True))
    start = F.when(own & fresh, F.col("index"))
    runs = with_carried(stepped.filter(own), _ORDER, start, "since")
    islands = _chunk(
        runs.withColumn("date", F.col("day.date")).groupBy("file", "date", "since"),
        "temporal", 2, F.col("date"))
    if last_only:
        last = islands.groupBy("file", "label").agg(F.max("start_index").alias("start_index"))
        islands = islands.join(last, ["file", "label", "start_index"], "left_semi")
    return islands.filter((F.col("line_count") >= min_lines) & (F.col("error_count") > 0))


def _span_cells(chunks: DataFrame, width: int) -> DataFrame:
    """One row per chunk and cell of ``width`` lines that its span touches."""
    low, high = F.floor(F.col("start_index") / width), F.floor(F.col("end_index") / width)
    return chunks.withColumn("cell", F.explode(F.sequence(low, high)))


def merge_chunks(strategies: list[DataFrame], width: int = K.CHUNK_LINES) -> DataFrame:
    """Add strategies in order; a chunk is dropped when its span overlaps an earlier
    strategy's accepted chunk by more than half of either one's line count.

    Spans meet in cells of ``width`` lines, each pair in the first cell that both touch, so a task holds the chunks
    of one cell of one file.
    """
    accepted = strategies[0]
    name = ["file", "chunk_type", "start_index", "end_index", "label"]
    for new in strategies[1:]:
        n, a = _span_cells(new, width).alias("n"), _span_cells(accepted, width).alias("a")
        overlap = (F.least("n.end_index", "a.end_index") - F.greatest("n.start_index", "a.start_index") + 1)
        first = F.floor(F.greatest("n.start_index", "a.start_index") / width)
        clash = n.join(a, (F.col("n.file") == F.col("a.file")) & (F.col("n.cell") == F.col("a.cell"))
                       & (F.col("n.cell") == first) & (overlap > 0)
                       & ((overlap > F.col("n.line_count") * 0.5) | (overlap > F.col("a.line_count") * 0.5)))
        dropped = clash.select(*[F.col(f"n.{c}").alias(c) for c in name]).distinct()
        accepted = accepted.unionByName(new.join(dropped, name, "left_anti"))
    return accepted


def normal_chunks(indexed: DataFrame, chunks: DataFrame, size: int = K.CHUNK_LINES) -> DataFrame:
    """Lines under no chunk's span, in chunks of ``size``.

    Only spans are used: the gaps between merged spans give positions and counts of the
    uncovered lines, so no line is joined with a span. The largest end so far and the lines in gaps so far are carried over
    range partitions of the spans, so a file of any number of chunks is spread like everything else.
    """
    ends = indexed.groupBy("file").agg((F.max("index") + 1).alias("start_index")).withColumn(
        "end_index", F.col("start_index"))  # a stop at the end of each file
    spans = chunks.select("file", "start_index", "end_index").unionByName(ends).distinct()
    order = ["file", "start_index", "end_index"]
    cells = order_cells(spans.withColumn("reach", F.struct("file", "end_index")), order)
    reached = with_earlier_max(cells, order, "reach", "before")
    own = F.col("before.file") == F.col("file")
    steps = (reached.withColumn("low", F.when(own, F.col("before.end_index") + 1).otherwise(F.lit(0)))
             .withColumn("n", F.greatest(F.col("start_index") - F.col("low"), F.lit(0))))
    steps = with_running_sum(steps, order, F.col("n"), "_sum")
    base = F.when(~F.coalesce(own, F.lit(False)), F.col("_sum") - F.col("n"))
    steps = with_carried(steps, order, base, "_base")
    placed = steps.filter("n > 0").withColumn("first", F.col("_sum") - F.col("n") - F.col("_base"))
    last = F.col("first") + F.col("n") - 1
    cut_up = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(last / size))))
    a = F.greatest(F.col("first"), F.col("block") * size)
    b = F.least(last, (F.col("block") + 1) * size - 1)
    pieces = cut_up.select(
        "file", "block", (F.col("low") + a - F.col("first")).alias("s"), (F.col("low") + b - F.col("first")).alias("e"))
    return pieces.groupBy("file", "block").agg(
        F.min("s").alias("start_index"), F.max("e").alias("end_index"),
        F.sum(F.col("e") - F.col("s") + 1).alias("line_count")).select(
        "file", F.lit("normal").alias("chunk_type"), F.lit(1).alias("priority"), "start_index", "end_index",
        "line_count", F.lit(None).cast("bigint").alias("error_count"), F.lit("").alias("label"))


def chunk_logs(lines: DataFrame, size: int = K.CHUNK_LINES) -> DataFrame:
    """All chunks by priority."""
    indexed = cut(index_lines(lines))
    merged = cut(merge_chunks([
        error_density(indexed, size), severity_chunk(indexed), component_chunks(indexed), temporal_chunks(indexed)]))
    return merged.unionByName(normal_chunks(indexed, merged, size)).orderBy(
        F.col("priority").desc(), "file", "start_index")
