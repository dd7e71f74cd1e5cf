"""A streaming source that follows growing files by byte offsets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "followed_lines"
_HEAD = 1024  # first bytes that tell a file from another one
_STEP = 1 << 16


class Span(InputPartition):
    """Lines of a file that begin in [start, end); ``first``: whether start is the beginning of a line."""

    def __init__(self, path: str, start: int, end: int, first: bool):
        self.path, self.start, self.end, self.first = path, start, end, first


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


class LineReader(DataSourceStreamReader):
    """Offsets are, per file, the byte after the last complete line, and a checksum of the first bytes.

    A file whose first bytes have changed, or that is shorter than what was read of it, is read from its start; one that
    was only renamed goes on where it was.
    """

    def __init__(self, options: dict[str, Any]):
        self.folder = options["path"]
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.since = float(options["since"]) if options.get("since") else None
        self.chunk = int(options.get("chunk", 64 << 20))
        self._seen: dict[str, tuple] = {}  # what is known of files that have not changed

    def _files(self, fs: pafs.FileSystem, root: str) -> Iterator[pafs.FileInfo]:
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=self.recursive)):
            if info.is_file and info.base_name[0] not in "._":
                yield info

    def _head(self, fs: pafs.FileSystem, path: str, n: int) -> int:
        with fs.open_input_file(path) as f:
            return zlib.crc32(f.read_at(n, 0))

    def _told(self, fs: pafs.FileSystem, info: pafs.FileInfo) -> dict[str, int]:
        known = self._seen.get(info.path)
        if known and known[0] == (info.size, info.mtime_ns):
            return known[1]
        with fs.open_input_file(info.path) as f:
            at = info.size
            while at:  # backwards to the last line end
                low = max(0, at - _STEP)
                k = f.read_at(at - low, low).rfind(b"\n")
                at = low + k + 1 if k >= 0 else low
                if k >= 0:
                    break
            n = min(_HEAD, at)
            told = {"at": at, "head": n, "crc": zlib.crc32(f.read_at(n, 0))}
        self._seen[info.path] = ((info.size, info.mtime_ns), told)
        return told

    def latestOffset(self) -> dict:
        fs, root = _opened(self.folder)
        return {i.path: self._told(fs, i) for i in self._files(fs, root)}

    def initialOffset(self) -> dict:
        fs, root = _opened(self.folder)
        return {i.path: self._told(fs, i) for i in self._files(fs, root)
                if self.since is None or i.mtime_ns / 1e9 <= self.since}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fs, _ = _opened(self.folder)
        spans: list[InputPartition] = []
        same = {path: self._goes_on(fs, path, told, start[path]) for path, told in end.items() if path in start}
        moved = [told for path, told in start.items() if not same.get(path) and told["head"]]
        for path, told in sorted(end.items()):
            if path in start and start[path] == told:
                continue
            at = start[path]["at"] if same.get(path) else 0
            if path not in start:
                at = max((m["at"] for m in moved if self._goes_on(fs, path, told, m)), default=0)
            for a in range(at, told["at"], self.chunk):
                spans.append(Span(path, a, min(told["at"], a + self.chunk), a == at))
        return spans

    def _goes_on(self, fs: pafs.FileSystem, path: str, told: dict, before: dict) -> bool:
        return told["at"] >= before["at"] and self._head(fs, path, before["head"]) == before["crc"]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.folder)
        with fs.open_input_file(partition.path) as f:
            f.seek(partition.start if partition.first else partition.start - 1)
            rest = b"" if partition.first else None  # None: still in a line of the chunk before
            at = f.tell()
            while at < partition.end or rest:
                data = f.read(1 << 20)
                if not data:
                    break
                if rest is None:
                    k = data.find(b"\n")
                    if k < 0:
                        at += len(data)
                        continue
                    at, data, rest = at + k + 1, data[k + 1:], b""
                    if at >= partition.end:
                        break
                begin, lines = at - len(rest), (rest + data).split(b"\n")
                at += len(data)
                rest, kept = lines.pop(), []
                for line in lines:
                    if begin >= partition.end:
                        rest = b""
                        break
                    begin += len(line) + 1
                    kept.append(line)
                if begin >= partition.end:
                    rest = b""
                texts = [t for t in (x.rstrip(b"\r").decode("utf-8", "replace") for x in kept) if t]
                yield pa.RecordBatch.from_pydict({
                    "text": pa.array(texts, pa.string()), "file": pa.array([partition.path] * len(texts), pa.string()),
                    "block": pa.array([partition.start] * len(texts), pa.int64())})


class FollowedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "text string, file string, block bigint"

    def streamReader(self, schema) -> LineReader:
        return LineReader(dict(self.options))
