"""JSON log files: one object per line, or one array per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from timberline import constants as K
from timberline.functions import fields as L, text as T
from timberline.operators.skew import attach
from timberline.session import cut, scratch_dir
from timberline.sources.text import accepted, scan_lines


def json_scan(spark: SparkSession, path: str | list[str], extensions: list[str] | None = None,
              max_bytes: int | None = None) -> DataFrame:
    """(file, line_number, text): one row per line or per array item that is an object.

    A file is an array when its first character is ``[``. Line numbers start at the first
    line that is not blank. Array files are read in pieces, see ``array_items``; other files line by line.
    """
    lines = _held(scan_lines(spark, path, None, extensions, max_bytes, keep_empty=True).withColumn(
        "text", T.strip(F.col("text"))).filter("text <> ''"), "json-text")
    opening = cut(
        lines.groupBy("file")
        .agg(F.min(F.struct("line_number", F.substring("text", 1, 1).alias("mark"))).alias("o"), F.count("*").alias("n"))
        .select("file", F.col("o.line_number").alias("first"), F.col("o.mark").alias("mark"), "n"))
    told = attach(lines, opening, ["file"], "n").filter("mark <> '['").select(
        "file", (F.col("line_number") - F.col("first") + 1).alias("line_number"), "text")
    arrays = opening.filter("mark = '['").select("file", "n")
    if arrays.isEmpty():
        return told
    return told.unionByName(array_items(spark, path, arrays, extensions, max_bytes))


def _held(df: DataFrame, name: str) -> DataFrame:
    """The same rows from one table in the shared folder: log files may be many and small, and are read once."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _depth(text: Column) -> Column:
    """Brackets opened less brackets closed outside strings."""
    outside = F.regexp_replace(text, '"[^"]*("|$)', "")
    return (F.length(F.regexp_replace(outside, r"[^\[{]", "")) - F.length(F.regexp_replace(outside, r"[^\]}]", ""))).cast("bigint")


def array_items(spark: SparkSession, path: str | list[str], arrays: DataFrame, extensions: list[str] | None = None,
                max_bytes: int | None = None) -> DataFrame:
    """(file, line_number, text): the objects of JSON array files, numbered by their place in the array.

    ``arrays`` names the files (file, and n, some weight of each). They are read in pieces between commas, by as many tasks as they
    have blocks. Whether a comma parts two items depends on all before it: a piece changes the state (inside a string, depth of
    brackets) by its number of quotes and by its brackets, counted for either start. Running sums of these small numbers within
    a block, for either start of it, and over the blocks of a file give the state at each comma; pieces are then put together to items. A file that isn't one whole array
    of well-formed items gives no rows.
    """
    pieces = (spark.read.option("lineSep", ",").text(path).filter(accepted(extensions, max_bytes))
              .select(F.make_valid_utf8("value").alias("text"), F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("block"))
              .withColumn("line_number", F.monotonically_increasing_id()))
    bare = F.regexp_replace("text", r"(?s)\\.", "")  # an escape never reaches over a comma
    quotes = (F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))).cast("bigint")
    read = pieces.select("*", quotes.alias("q"), _depth(bare).alias("d0"), _depth(F.concat(F.lit('"'), bare)).alias("d1"))
    pieces = _held(attach(read, arrays, ["file"], "n").filter("n is not null").drop("n"), "json-pieces")
    block = ["file", "block"]
    of_block = Window.partitionBy(*block).orderBy("line_number")
    earlier = of_block.rowsBetween(Window.unboundedPreceding, -1)
    earlier_blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def before(value: str | Column, window) -> Column:
        return F.coalesce(F.sum(value).over(window), F.lit(0))

    # the change of depth by a piece, if its block begins outside a string (out) or inside one (in)
    odd = before("q", earlier) % 2 == 1
    small = (pieces.drop("text").withColumn("_odd", odd)
             .withColumn("_out", F.when(F.col("_odd"), F.col("d1")).otherwise(F.col("d0")))
             .withColumn("_in", F.when(F.col("_odd"), F.col("d0")).otherwise(F.col("d1"))))
    sums = small.groupBy(*block).agg(F.sum("q").alias("q"), F.sum("_out").alias("_out"), F.sum("_in").alias("_in"),
                                     F.min("line_number").alias("_first"))
    begin = (sums.withColumn("_within", before("q", earlier_blocks) % 2 == 1)
             .withColumn("_depth", before(F.when(F.col("_within"), F.col("_in")).otherwise(F.col("_out")), earlier_blocks))
             .withColumn("_place", F.row_number().over(Window.partitionBy("file").orderBy("block")))
             .select(*block, "_within", "_depth", F.when(F.col("_place") == 1, F.col("_first")).alias("_first")))
    steps = (small.join(begin, block).withColumn("inside", F.col("_within") != F.col("_odd"))
             .withColumn("first", F.coalesce(F.col("line_number") == F.col("_first"), F.lit(False)))
             .withColumn("d", F.when(F.col("_within"), F.col("_in")).otherwise(F.col("_out"))))
    steps = steps.withColumn("depth", F.col("_depth") + before("d", earlier))
    begins = (F.col("first") | (~F.col("inside") & (F.col("depth") == 1))).cast("bigint")
    steps = cut(steps.withColumn("_n", F.sum(begins).over(of_block.rowsBetween(Window.unboundedPreceding, 0))).select(
        *block, "line_number", "_n", "first", "inside", "depth", (F.col("depth") + F.col("d")).alias("after"),
        ((F.col("inside").cast("int") + F.col("q")) % 2).alias("open")))
    counts = steps.groupBy(*block).agg(F.max("_n").alias("_k"))
    counts = counts.select(*block, before("_k", earlier_blocks).alias("_items"))
    places = steps.join(counts, block).withColumn("item", F.col("_items") + F.col("_n"))
    ends = places.groupBy("file").agg(F.max_by(F.struct("after", "open", "item"), F.struct("block", "line_number")).alias("end"),
                                      F.min(F.when(~F.col("first"), F.col("depth"))).alias("least"))
    broken = ends.filter("end.after <> 0 or end.open <> 0 or least < 1").select("file")
    order = [*block, "line_number"]
    put = (pieces.select(*order, "text").join(places.select(*order, "item", "after"), order).groupBy("file", "item")
           .agg(F.array_sort(F.collect_list(F.struct("block", "line_number", "text"))).alias("parts"),
                F.min("after").alias("after")))
    body = F.array_join(F.transform("parts", lambda p: p["text"]), ",")
    body = F.when(F.col("item") == 1, F.regexp_replace(body, r"^\s*\[", "")).otherwise(body)
    body = T.strip(F.when(F.col("after") == 0, F.regexp_replace(body, r"\]\s*$", "")).otherwise(body))
    read = put.select("file", F.col("item").alias("line_number"), "after", body.alias("body")).withColumn(
        "values", F.from_json(F.concat(F.lit("["), "body", F.lit("]")), "array<string>"))
    empty = (F.col("line_number") == 1) & (F.col("after") == 0) & (F.col("body") == "")
    items = cut(read.select("file", "line_number", F.col("body").startswith("{").alias("is_object"), F.when(F.size("values") == 1, F.col("values")[0]).alias("text"),
                            (~empty & (F.coalesce(F.size("values"), F.lit(-1)) != 1)).alias("bad")))
    broken = broken.unionByName(items.filter("bad").select("file")).distinct()
    return items.filter("is_object and text is not null").join(broken, "file", "left_anti").select("file", "line_number", "text")


def json_entries(lines: DataFrame) -> DataFrame:
    """Entries of JSON objects by field aliases; lines that are no object are dropped."""
    read = lines.withColumn("_m", L.json_map(F.col("text"))).filter(F.col("_m").isNotNull())
    names = K.JSON_FILE_KEYS
    # look the keys up once, then read the values
    keyed = read.select("file", "line_number", "text", "_m", *[
        L.alias_key(F.col("_m"), names[f]).alias(f"_{f}") for f in names])
    valued = keyed.select("file", "line_number", "text", *[
        F.col("_m")[F.col(f"_{f}")].alias(f"_{f}") for f in names])
    return valued.select(
        "file", "line_number", F.col("text").alias("raw"),
        L.json_timestamp(F.col("_timestamp")).alias("timestamp"),
        F.when(F.col("_level").isNotNull(), L.json_level(F.col("_level"))).otherwise("UNKNOWN").alias("log_level"),
        F.coalesce(F.col("_message").cast("string"), "text").alias("message"),
        F.coalesce(F.col("_source").cast("string"), F.lit("")).alias("source"),
        F.lit(None).cast("string").alias("ip_address"), F.lit(None).cast("string").alias("username"),
        F.lit(None).cast("string").alias("error_code"), F.lit("JSON").alias("log_type"))
