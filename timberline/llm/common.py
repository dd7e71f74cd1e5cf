"""What the operators of this package share: tables, worker state, bounded groups."""

from __future__ import annotations

import ctypes
import gc
import math
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timberline.session import cut

__all__ = ["cut", "table", "worker_state", "forget", "hand_back", "map_rows", "spread", "remainder"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def worker_state(key: object, make: Callable[[], Any]) -> Any:
    """A value built once per Python worker process and kept for its later tasks.

    Functions are shipped by value, so their own globals do not outlive a task; the state
    hangs on a module entry of the worker instead. It holds caches and loaded models only:
    a lost worker builds it again. A worker keeps one value: workers are reused from one operator
    to the next, and what the last one cached would stay beside what the next one fills.
    """
    kept = _kept()
    if key not in kept:
        forget()
        kept[key] = make()
    return kept[key]


def _kept() -> dict[object, Any]:
    home = sys.modules.setdefault("_timberline_worker", types.ModuleType("_timberline_worker"))
    return home.__dict__.setdefault("_kept", {})


def forget() -> None:
    """Drop what earlier operators left in this worker process; operators that keep nothing call it in their tasks."""
    if _kept():
        _kept().clear()
        gc.collect()
    hand_back()


def hand_back() -> None:
    """Give memory that was freed back to the system: workers live on beside the executor and share its limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not the GNU C library
        pass


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[Iterator[list[list]]], Iterator[dict]],
             schema: str, at_once: int = 1000) -> DataFrame:
    """Map ``columns`` of ``df`` through ``fn``, which gets Python lists per Arrow batch and yields
    dicts of lists or arrays, one per output batch; ``at_once`` rows of a batch at a time, as texts may be long."""
    target = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in _parsed(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(a, at_once) for b in batches for a in range(0, len(b), at_once))
        lists = ([b.column(i).to_pylist() for i in range(len(columns))] for b in parts)
        for out in fn(lists):
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type, from_pandas=False) for f in target], schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def _parsed(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def _arrow(kind: str) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
              "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}
    return pa.list_(_arrow(kind[6:-1])) if kind.startswith("array<") else simple[kind]


def spread(rows: int, per_group: int) -> int:
    """Number of groups that keeps each near ``per_group`` rows."""
    return max(1, math.ceil(rows / per_group))


def remainder(column: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"),
                              F.lit("")).cast("binary")) % n


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now: it acts when the driver's JVM has
    collected its garbage, which is otherwise seldom, and the files would stay beside those of later jobs."""
    import gc
    import time

    for _ in range(2):  # what the first collection frees, the second may enqueue for the cleaner
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
