"""Token-id files: ids of all documents in ascending doc_id order, range-coded in blocks.

The file set is a Parquet table whose rows are segments of whole documents: ``part`` and ``segment``
give the order, ``doc_ids`` and ``lengths`` the documents, ``n_ids`` their ids and ``payload`` the
coded blocks (see ``codec``). Spark's writer commits whole tasks, so a lost executor leaves no half
segment, and any segment can be read alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from timberline.llm import codec
from timberline.llm.common import map_rows
from timberline.llm.tokens import encoder

#: ids after which a segment ends; a longer document makes a longer segment
SEGMENT = 4_000_000


def write(docs: DataFrame, path: str, end_id: int = 1, tokenizer: str | None = None,
          segment: int = SEGMENT) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write the files to ``path``.

    Documents are range-partitioned and sorted by doc_id, nulls first; rows that share a doc_id come in
    the order of a hash of their text. Other columns are not written.
    """
    ordered = (docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")))

    def encode(batches: Iterator[list[list]]) -> Iterator[dict]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        data: list[bytes] = []
        size = 0

        def row() -> dict:
            return {"part": [part], "segment": [number], "doc_ids": [ids], "lengths": [[len(d) // 4 for d in data]],
                    "n_ids": [size], "payload": [codec.encode(np.frombuffer(b"".join(data), "<u4"))]}

        for keys, texts in batches:
            for key, text in zip(keys, texts):
                ids.append(key)
                data.append(enc.encode(text) + end)
                size += len(data[-1]) // 4
                if size >= segment:
                    yield row()
                    ids, data, size, number = [], [], 0, number + 1
        if ids:
            yield row()

    map_rows(ordered, ["doc_id", "text"], encode,
             "part int, segment int, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, payload binary"
             ).write.parquet(path)


def read(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Decode segments: one row per document with doc_id, n_tokens, the crc32 of its ids as
    little-endian unsigned 32-bit integers, its place, and on demand the ids themselves.

    ``start`` counts the ids of all documents before it. Sums over segments are over one narrow
    row per segment; the order of parts is kept by a sum over one row per part.
    """
    def decode(batches: Iterator[list[list]]) -> Iterator[dict]:
        for rows in batches:
            for part, segment, keys, lengths, payload in zip(*rows):
                data = codec.decode(payload).tobytes()
                ends = np.cumsum(np.array(lengths, np.int64))
                spans = [(int(e - n) * 4, int(e) * 4) for e, n in zip(ends, lengths)]
                out = {"part": [part] * len(keys), "segment": [segment] * len(keys), "doc_id": keys,
                       "inside": [a // 4 for a, _ in spans], "n_tokens": lengths,
                       "ids_crc32": [zlib.crc32(data[a:b]) for a, b in spans]}
                if with_ids:
                    out["ids"] = [np.frombuffer(data[a:b], "<u4").astype(np.int64) for a, b in spans]
                yield out

    schema = "part int, segment int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    docs = map_rows(files, ["part", "segment", "doc_ids", "lengths", "payload"], decode,
                    schema + (", ids array<bigint>" if with_ids else ""))
    sizes = files.select("part", "segment", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_part"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.select("part", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_segment"))
    found = docs.join(places.join(before_part, "part"), ["part", "segment"])
    return found.select("doc_id", (F.col("_part") + F.col("_segment") + F.col("inside")).alias("start"),
                        "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
