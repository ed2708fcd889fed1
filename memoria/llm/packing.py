"""Bounded-space online packing of documents into token windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stash
from .tokens import byte_bpe

_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
_BYTES = 4


class _Window:
    __slots__ = ("pieces", "used")

    def __init__(self) -> None:
        self.pieces: list[tuple] = []
        self.used = 0

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        self.pieces.append((doc, start, ids, total))
        self.used += len(ids) // _BYTES


def _filled(pieces: Iterable[tuple], size: int) -> Iterator[_Window]:
    """Windows of exactly size tokens, cutting pieces where one ends; the last may be shorter."""
    window = _Window()
    for doc, start, ids, total in pieces:
        at = 0
        while at < len(ids):
            part = ids[at : at + (size - window.used) * _BYTES]
            window.add(doc, start + at // _BYTES, part, total)
            at += len(part)
            if window.used == size:
                yield window
                window = _Window()
    if window.used:
        yield window


def _packed(docs: Iterable[tuple], size: int, windows: int) -> Iterator[tuple[_Window, bool]]:
    """Best-fit into at most `windows` open windows; (window, whether it is the unfilled last one)."""
    open_: list[_Window] = []
    for doc, ids in docs:
        total = len(ids) // _BYTES
        at = 0
        while len(ids) - at >= size * _BYTES:
            full = _Window()
            full.add(doc, at // _BYTES, ids[at : at + size * _BYTES], total)
            yield full, False
            at += size * _BYTES
        rest = ids[at:]
        need = len(rest) // _BYTES
        if not need:
            continue
        fits = [w for w in open_ if size - w.used >= need]
        if fits:
            best = max(fits, key=lambda w: w.used)
        elif len(open_) < windows:
            best = _Window()
            open_.append(best)
        else:
            # None fits: the fullest takes what it has room for and leaves; the remainder opens the next window.
            fullest = max(open_, key=lambda w: w.used)
            room = (size - fullest.used) * _BYTES
            fullest.add(doc, at // _BYTES, rest[:room], total)
            open_.remove(fullest)
            yield fullest, False
            at, rest = at + room, rest[room:]
            best = _Window()
            open_.append(best)
        best.add(doc, at // _BYTES, rest, total)
        if best.used == size:
            open_.remove(best)
            yield best, False
    left = sorted(open_, key=lambda w: -w.used)
    for window in _filled((p for w in left for p in w.pieces), size):
        yield window, window.used < size


def _rows(window: _Window, sequence: int, payload: bool) -> Iterator[tuple]:
    at = 0
    for doc, start, ids, total in window.pieces:
        n = len(ids) // _BYTES
        yield doc, start, n, zlib.crc32(ids), total, sequence, at, ids if payload else None
        at += n


def pack(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, windows: int = 32, end_id: int = 1) -> DataFrame:
    """Pack every document's ids, then end_id, into windows of at most size tokens; one row per piece.

    tokenizer: path of a byte-level BPE file of the `tokenizers` library; pattern: its pre-token pattern. Each partition
    holds a fixed number of open windows. A document's whole windows leave at once; its remainder goes to the fullest
    open window that has room, or opens one while there are fewer than `windows`; when none fits, the fullest takes a
    cut of it and is emitted full. At the end a partition merges its leftover windows into full ones and one tail; tails
    of 64 neighbouring partitions (under 8 KB each) are merged again, and the last of those is cut into windows whose
    lengths are powers of two, which need no padding. So memory is bounded by windows * size ids a task.

    Columns: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset. sequence_id is unique, not dense. Null
    or empty text is end_id alone; null ids and repeated rows are packed as any other row; an empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        bpe = byte_bpe(tokenizer, pattern)
        end = end_id.to_bytes(_BYTES, "little")
        texts = ((i, bpe.ids(t or "") + end) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        out: list[tuple] = []
        for k, (window, tail) in enumerate(_packed(texts, size, windows)):
            out += ((*r, part // 64 if tail else None, part if tail else None) for r in _rows(window, (part << 32) | k, tail))
            if len(out) >= 20_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    columns = f"`{id_col}` {kind}, {_PIECE}, ids binary, `group` long, part long"
    schema = _arrow(columns)
    rows = stash(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(first, columns))

    def merged(key, tails: pd.DataFrame) -> pd.DataFrame:
        tails = tails.sort_values(["part", "offset"])
        pieces = list(zip(tails["_id"], tails["start"], tails["ids"], tails["doc_tokens"], strict=True))
        found: list[tuple] = []
        k = 0
        for window in _filled(pieces, size):
            room = window.used
            parts = [window]
            if room < size:
                parts = []
                rest = window.pieces
                for bit in reversed(range(room.bit_length())):
                    if room >> bit & 1:
                        now, *later = _filled(rest, 1 << bit)
                        parts.append(now)
                        rest = [p for w in later for p in w.pieces]
            for part in parts:
                found += (r[:-1] for r in _rows(part, (1 << 62) | (int(key[0]) << 24) | k, False))
                k += 1
        return pd.DataFrame(found, columns=["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    tails = rows.where("`group` is not null").select(F.col(id_col).cast("string").alias("_id"), "start", "ids", "doc_tokens", "offset", "part", "group")
    late = tails.groupBy("group").applyInPandas(merged, f"_id string, {_PIECE}")
    late = late.select(F.col("_id").cast(kind).alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return rows.where("`group` is null").select(*late.columns).union(late)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
