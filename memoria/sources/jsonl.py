"""A data source of complete lines with their byte offsets, which are an importer's cursor positions."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: a line with more bytes than this is passed over unread.
LINE_BYTES = 32 << 20
_READ = 1 << 20
_ROWS = 4096


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store that a path or address names, and the path there."""
    if path.startswith("file:") and not path.startswith("file:///"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class _Range(InputPartition):
    """The lines of a file that start at or after `start` and before `end`; `first`: a line is known to start at start."""

    def __init__(self, path: str, start: int, end: int, first: bool) -> None:
        self.path, self.start, self.end, self.first = path, start, end, first


def lines(chunks: Iterator[bytes], at: int, end: int, first: bool, longest: int = LINE_BYTES) -> Iterator[tuple[int, int, bytes | None]]:
    """(start, end, line) of the complete lines that start before `end`, from bytes that begin at offset `at`.

    Unless a line is known to start there, what comes before the first newline belongs to an earlier range. Lines longer
    than `longest` come without their bytes, which are not held meanwhile. What no newline ends is never returned."""
    held: list[bytes] = []
    size = 0
    start: int | None = at if first else None
    for chunk in chunks:
        cursor = 0
        while (stop := chunk.find(b"\n", cursor)) >= 0:
            if start is not None:
                part = chunk[cursor:stop]
                yield start, at + stop + 1, None if size + len(part) > longest else b"".join([*held, part])
            held, size, start = [], 0, at + stop + 1
            cursor = stop + 1
            if start >= end:
                return
        rest = chunk[cursor:]
        size += len(rest)
        held = [] if size > longest else [*held, rest]
        at += len(chunk)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = json.loads(options["paths"])
        self.since = json.loads(options.get("since", "{}"))
        self.split = int(options.get("splitbytes", 128 << 20))
        self.longest = int(options.get("linebytes", LINE_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        """Byte ranges of the files; what lies before a file's cursor is not read."""
        out = []
        for path in self.paths:
            store, inner = filesystem(path)
            found = store.get_file_info(inner)
            # A file that is gone has no lines.
            size = found.size if found.type == pafs.FileType.File else 0
            since = int(self.since.get(path, 0))
            out += [_Range(path, at, min(at + self.split, size), at == since) for at in range(since, size, self.split)]
        return out

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is nothing to read at all
            return
        store, inner = filesystem(partition.path)
        # One byte earlier, a newline there tells that a line starts at the range's own start.
        at = partition.start if partition.first else partition.start - 1

        def chunks() -> Iterator[bytes]:
            with store.open_input_file(inner) as file:
                file.seek(at)
                while data := file.read(_READ):
                    yield data

        rows: list[tuple[int, int, str | None]] = []
        size = 0
        for start, end, line in lines(chunks(), at, partition.end, partition.first, self.longest):
            rows.append((start, end, None if line is None else line.decode("utf-8", "replace")))
            size += end - start
            if len(rows) >= _ROWS or size >= 4 * _READ:
                yield _batch(partition.path, rows)
                rows, size = [], 0
        if rows:
            yield _batch(partition.path, rows)


def _batch(path: str, rows: list[tuple]) -> pa.RecordBatch:
    starts, ends, texts = zip(*rows, strict=True)
    columns = [pa.array([path] * len(rows)), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["path", "start", "end", "text"])


class JsonLines(DataSource):
    """spark.read.format("offset_lines"): (path, start, end, text) of newline-ended lines.

    Options: paths, a JSON list of files; since, a JSON map from file to the offset from which on it is read (default 0,
    a line's start); splitBytes, the size of a partition's byte range; lineBytes, the longest line whose text is read."""

    @classmethod
    def name(cls) -> str:
        return "offset_lines"

    def schema(self) -> str:
        return "path string, start long, end long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_lines(spark: SparkSession, paths: list[str], since: dict[str, int] | None = None, split: int = 128 << 20, longest: int = LINE_BYTES) -> DataFrame:
    """Complete lines of files with their byte offsets (path, start, end, text), in ranges of `split` bytes that tasks
    read apart. Only a newline ends a line: a carriage return stays in the text, and a torn tail is left for the next
    read. Bytes that are no UTF-8 become U+FFFD; lines over `longest` bytes have a null text; empty files, missing files
    and an empty list give no rows."""
    spark.dataSource.register(JsonLines)
    reader = spark.read.format("offset_lines").option("paths", json.dumps(paths)).option("since", json.dumps(since or {}))
    return reader.option("splitBytes", str(split)).option("lineBytes", str(longest)).load()
