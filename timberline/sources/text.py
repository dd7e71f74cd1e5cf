"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from timberline import constants as K
from timberline.operators.ordered import order_cells, with_carried, with_running_sum
from timberline.session import cut


def accepted(extensions: list[str] | None = None, max_bytes: int | None = None) -> Column:
    """Which files to read, by name and, on demand, by size. Filters on file metadata prune the listing."""
    name = F.lower("_metadata.file_name")
    wanted = F.lit(False)
    for ext in extensions or K.SCAN_EXTENSIONS:
        wanted = wanted | name.endswith(ext)
    size = F.col("_metadata.file_size")
    return wanted & (size >= 1 if max_bytes is None else size.between(1, max_bytes))


def number_lines(scanned: DataFrame) -> DataFrame:
    """(file, line_number, text) from rows with ``file``, ``block`` and ``text``, empty lines kept.

    Rows of one file block come from one task in file order, so their ids are contiguous;
    the offset of a block is the number of lines in the blocks before it. Nothing is sorted
    and only one row per block is aggregated. ``scanned`` must be the bare scan, before any
    filter.
    """
    ids = scanned.withColumn("_id", F.monotonically_increasing_id())
    blocks = ids.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # a block holds a bounded share of the bytes, so this key cannot be hot
    return ids.join(offsets, ["file", "block"]).select(
        "file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_number"), "text")


def decoded(value: Column, encoding: str | None) -> Column:
    """Text of a line; bad bytes become replacement characters in UTF-8."""
    if encoding is None or encoding.lower().replace("-", "") == "utf8":
        return F.make_valid_utf8(value)
    return F.decode(value.cast("binary"), encoding)


#: bytes of a code unit and of a line end, of encodings whose line ends are not one byte
_WIDE = {"utf16le": (2, "\n\0"), "utf16be": (2, "\0\n"), "utf32le": (4, "\n\0\0\0"), "utf32be": (4, "\0\0\0\n")}


def _scan(spark: SparkSession, path: str | list[str], encoding: str | None, extensions: list[str] | None,
          max_bytes: int | None) -> DataFrame:
    return (
        spark.read.text(path).filter(accepted(extensions, max_bytes))
        .select(decoded(F.col("value"), encoding).alias("text"), F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block")))


def _wide_lines(spark: SparkSession, path: str | list[str], encoding: str, width: int, end: str,
                extensions: list[str] | None, max_bytes: int | None) -> DataFrame:
    """(file, line_number, text) of files in UTF-16 or UTF-32 with a stated byte order.

    Files are cut at the bytes of a line end. Such bytes may also lie across two code units; then the lengths of the pieces
    before them don't add up to whole code units. Running lengths per file, over numbers only, tell the pieces that
    begin a line, and the others are put back. Where all pieces are whole, as in most files, nothing is put together.
    """
    scanned = spark.read.option("lineSep", end).text(path).filter(accepted(extensions, max_bytes)).select(
        F.col("value").cast("binary").alias("text"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))
    pieces = number_lines(scanned)
    sizes = pieces.select("file", "line_number", F.octet_length("text").cast("bigint").alias("n"))
    if not sizes.filter(F.col("n") % width != 0).isEmpty():
        order = ["file", "line_number"]
        first = F.col("line_number") == 1
        steps = with_running_sum(order_cells(sizes, order), order, F.col("n"), "_sum")
        steps = with_carried(steps, order, F.when(first, F.col("_sum") - F.col("n")), "_sum0")
        steps = steps.withColumn("_begins", ((F.col("_sum") - F.col("n") - F.col("_sum0")) % width == 0).cast("bigint"))
        steps = with_running_sum(steps, order, F.col("_begins"), "_no")
        steps = with_carried(steps, order, F.when(first, F.col("_no") - 1), "_no0")
        places = cut(steps.select(*order, (F.col("_no") - F.col("_no0")).alias("_line")))
        put = pieces.join(places, order).groupBy("file", "_line").agg(
            F.array_sort(F.collect_list(F.struct("line_number", F.hex("text").alias("x")))).alias("parts"))
        joined = F.array_join(F.transform("parts", lambda p: p["x"]), end.encode().hex())
        pieces = put.select("file", F.col("_line").alias("line_number"), F.unhex(joined).alias("text"))
    if width == 4:  # the byte order is told by a mark
        mark = F.unhex(F.lit("FFFE0000" if end[0] == "\n" else "0000FEFF"))
        text = F.decode(F.concat(mark, "text"), "UTF-32")
    else:
        text = F.decode("text", encoding)
    text = F.when(F.col("line_number") == 1, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    return pieces.select("file", "line_number", F.regexp_replace(text, "\r$", "").alias("text"))


def scan_lines(spark: SparkSession, path: str | list[str], encoding: str | None = None,
               extensions: list[str] | None = None, max_bytes: int | None = None,
               keep_empty: bool = False) -> DataFrame:
    """Numbered lines of the accepted files; empty lines count but are left out. Files of any size are read
    unless ``max_bytes`` leaves larger ones out. ``encoding`` is UTF-8 unless stated: a one-byte set, or UTF-16LE, UTF-16BE, UTF-32LE,
    UTF-32BE, where lines end on code units and a byte order mark is left out."""
    wide = _WIDE.get((encoding or "").lower().replace("-", ""))
    if wide:
        lines = _wide_lines(spark, path, encoding, *wide, extensions, max_bytes)
    else:
        lines = number_lines(_scan(spark, path, encoding, extensions, max_bytes))
    return lines if keep_empty else lines.filter("text <> ''")


def scan_filter(spark: SparkSession, path: str | list[str], extensions: list[str] | None = None,
                max_bytes: int | None = None) -> DataFrame:
    """(file, size) of the files a scan would read, in path order; of any size unless ``max_bytes`` leaves larger ones out."""
    ok = F.lit(False)
    for ext in extensions or K.SCAN_EXTENSIONS:
        ok = ok | F.lower("path").endswith(ext)
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # content is not read
    size = F.col("length")
    return (files.filter(ok & (size >= 1 if max_bytes is None else size.between(1, max_bytes)))
            .select(F.col("path").alias("file"), F.col("length").alias("size")).orderBy("file"))


def dir_scan(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """Existing files of one folder with a watched extension, sorted."""
    return scan_filter(spark, f"{folder.rstrip('/')}/*", extensions).select("file")
