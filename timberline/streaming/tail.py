"""Streams of log lines from a folder: files as they appear, and lines as they are appended."""

from __future__ import annotations

import os
import re
from datetime import datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from timberline.sources.text import accepted, decoded
from timberline.streaming.follow import FORMAT, FollowedLines


def dir_stream(spark: SparkSession, folder: str, extensions: list[str] | None = None,
               files_per_trigger: int | None = None, encoding: str | None = None, recursive: bool = False,
               bytes_per_trigger: int | None = 1 << 30) -> DataFrame:
    """(file, block, text) of the files of a folder as they appear; with ``recursive`` those of its subfolders too.

    A micro-batch takes new files of up to ``bytes_per_trigger`` in all, or up to ``files_per_trigger`` files where that is
    given; the others wait for the next one. Bytes bound a batch whatever the size of the files, and thousands of small
    files don't make dozens of batches, each with the fixed cost of its own analysis."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    elif bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    files = reader.option("recursiveFileLookup", str(recursive).lower()).load(folder)
    if not recursive:  # folders named key=value are listed all the same
        scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
        inside = quote(re.sub(scheme, "", folder) if ":" in folder else os.path.abspath(folder)).rstrip("/")
        path = F.regexp_replace("_metadata.file_path", scheme, "")
        files = files.filter(F.regexp_replace(path, "/[^/]*$", "") == inside)
    return (files.filter(accepted(extensions, 1 << 62))
            .select(decoded(F.col("value"), encoding).alias("text"), F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block")))


def tail_stream(spark: SparkSession, folder: str, since: datetime | None = None, from_start: bool = False,
                recursive: bool = False) -> DataFrame:
    """(text, file, block): complete lines appended to the files of a folder, empty lines left out.

    Files that are there when the query first starts are followed from their end; with ``since``, those changed later are read
    from their start, with ``from_start`` all are. New files are read whole. A half-written last line waits for its
    end. A file that was replaced or cut is read from its start, a renamed one goes on where it was; the query's
    checkpoint remembers what was read. Offsets are kept per file, so old files should leave the folder in time.
    """
    spark.dataSource.register(FollowedLines)
    at = 0 if from_start else since.timestamp() if since is not None else ""
    return (spark.readStream.format(FORMAT).option("recursive", str(recursive).lower()).option("since", str(at)).load(folder))
