"""Normalising raw lines and folding continuation lines into entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from timberline import constants as K
from timberline.functions import text as T
from timberline.operators.ordered import order_cells, with_carried
from timberline.session import cut


def normalize_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("normalized", T.normalize_line("text"))


def flag_continuations(lines: DataFrame) -> DataFrame:
    return lines.withColumn("is_continuation", T.is_continuation("text"))


class _Piece:
    """Lines of one entry read so far."""

    def __init__(self, file: str, at: int, head: bool, first: str):
        self.file, self.at, self.head, self.first, self.more = file, at, head, first, []

    def row(self, border: bool) -> tuple:
        # blank continuations add nothing; the opening line stays even when blank
        more = [t for t in self.more if t]
        rest = None if self.head else " ".join(([self.first] if self.first else []) + more)
        return self.file, self.at, self.head, border, " ".join([self.first, *more]), rest


_PIECES = pa.schema([("file", pa.string()), ("at", pa.int64()), ("head", pa.bool_()), ("border", pa.bool_()),
                     ("text", pa.string()), ("rest", pa.string())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold lines in the order they are read. A run is a stretch of rows with consecutive numbers of one file; an entry
    followed by another one in its run is complete, what stands at the borders of a run is marked so."""
    pending, last_file, last_line = None, None, -2
    for batch in batches:
        if not batch.num_rows:
            continue
        files, texts = batch.column(0), batch.column(2)
        number = batch.column(1).to_numpy(zero_copy_only=False)
        folded = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        code = files.dictionary_encode().indices.to_numpy()
        breaks = np.ones(len(number), bool)
        breaks[1:] = (number[1:] != number[:-1] + 1) | (code[1:] != code[:-1])
        breaks[0] = files[0].as_py() != last_file or number[0] != last_line + 1
        begins = np.flatnonzero(breaks | ~folded)
        out = []
        lead = begins[0] if len(begins) else len(number)
        if lead:
            pending.more += texts.slice(0, lead).to_pylist()
        if len(begins):
            if pending:
                out.append(pending.row(bool(breaks[begins[0]]) or not pending.head))
            ends = np.append(begins[1:], len(number))
            # entries of one line, complete: taken over as they are
            whole = ends - begins == 1
            whole[-1] = False
            whole[:-1] &= ~breaks[begins[1:]]
            whole &= ~folded[begins]
            at = pa.array(begins[whole])
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [files.take(at), batch.column(1).take(at), pa.array(np.ones(n, bool)), pa.array(np.zeros(n, bool)),
                 texts.take(at), pa.nulls(n, pa.string())], schema=_PIECES)
            for k in np.flatnonzero(~whole):
                i, j = begins[k], ends[k]
                piece = _Piece(files[i].as_py(), int(number[i]), not folded[i], texts[i].as_py())
                piece.more += texts.slice(i + 1, j - i - 1).to_pylist()
                if k == len(begins) - 1:
                    pending = piece
                else:
                    out.append(piece.row(bool(breaks[j]) or not piece.head))
        last_file, last_line = files[len(files) - 1].as_py(), int(number[-1])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)
    if pending:
        out = [pending.row(True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)


def merge_multiline(lines: DataFrame) -> DataFrame:
    """(file, line_number, text): continuation lines folded into the entry before them.

    An entry keeps the number of its first line; continuation lines at the top of a file form an entry of their own.
    Lines are folded where they are read, in the order of the scan, and the pieces are checkpointed; only what stands at
    the border of a run of consecutive lines is shuffled, to find the entry it goes on with. Rows in any other order are
    runs of one line, with the same result. The text of one entry is one value by definition and has to fit in a row.
    """
    flagged = lines.select("file", F.col("line_number").cast("bigint").alias("line_number"),
                           T.normalize_line("text").alias("normalized"), T.is_continuation("text").alias("folded"))
    pieces = cut(flagged.filter("normalized is not null").mapInArrow(
        _fold, "file string, at bigint, head boolean, border boolean, text string, rest string"))
    order = ["file", "at"]
    cells = order_cells(pieces.filter("border").drop("border"), order)
    carried = with_carried(cells, order, F.when(F.col("head"), F.struct("file", "at")), "opened")
    entry = F.when(F.col("opened.file") == F.col("file"), F.col("opened.at")).otherwise(F.lit(-1))
    joined = carried.groupBy("file", entry.alias("entry")).agg(
        F.array_sort(F.collect_list(F.struct("at", "text", "rest"))).alias("parts"))
    rest = F.filter(F.transform(F.slice("parts", 2, F.size("parts")), lambda p: p["rest"]), lambda t: t != "")
    whole = joined.select(
        "file", F.col("parts")[0]["at"].alias("line_number"),
        F.array_join(F.concat(F.array(F.col("parts")[0]["text"]), rest), " ").alias("text"))
    return pieces.filter("not border").select("file", F.col("at").alias("line_number"), "text").unionByName(whole)


def truncate_lines(lines: DataFrame, limit: int = K.MAX_LINE_CHARS) -> DataFrame:
    """Cut over-long entries before parsing."""
    return lines.withColumn("text", T.clip("text", limit))


def filter_lines(lines: DataFrame, level: str | None = None, query: str | None = None) -> DataFrame:
    """Lines by level word group and by free text, both ignoring case."""
    low = F.lower("text")
    tests = {
        "error": ["error", "exception", "failed"],
        "warning": ["warn"],
        "info": ["info", "debug"],
    }
    if level:
        lines = lines.filter(T.contains_any(low, tests[level]))
    if query:
        lines = lines.filter(F.contains(low, F.lit(query.lower())))
    return lines


def excerpt(lines: DataFrame, n: int = 3) -> DataFrame:
    """First n error lines, or the first n lines when there is no error line."""
    marked = lines.withColumn("is_error", T.contains_any(F.lower("text"), ["error", "exception", "failed"]))
    picked = marked.orderBy(F.col("is_error").desc(), "file", "line_number").limit(n)
    any_error = picked.agg(F.max("is_error")).scalar()
    return picked.filter(F.col("is_error") | ~any_error).drop("is_error")
