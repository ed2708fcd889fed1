"""Alignment of two tokenizers' tokens on the bytes of the same text, and corpus-wide counts of linked ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import in_turns, stash
from .tokens import byte_bpe, piece_bpe

_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two token sequences that cover the same bytes: for each A token its first overlapping B token and how many it
    overlaps, and the A tokens at whose end a B token ends too.

    The ends of the B tokens are a static index of disjoint intervals: the B token stabbed by an A token's first byte
    and the one stabbed by its last byte are found by bisection, and all between them overlap. An end that both have is
    a gap that no token spans.
    """
    a_start = np.concatenate([np.zeros(1, a_end.dtype), a_end[:-1]])
    first = np.searchsorted(b_end, a_start, "right")
    last = np.searchsorted(b_end, a_end, "left")
    return first, last - first + 1, np.flatnonzero(b_end[last] == a_end) if len(a_end) else last


def _digits(n: int) -> np.ndarray:
    """The decimal digits of 0 to n - 1, a row each, behind zeros that are no digits; the last column is free."""
    width = len(str(max(n - 1, 1)))
    value = np.arange(n)
    out = np.zeros((n, width + 1), np.uint8)
    for k in range(width):
        place = 10 ** (width - 1 - k)
        out[:, k] = np.where((value >= place) | (place == 1), value // place % 10 + 48, 0)
    return out


class _Shown:
    """Writes ids with the sign that follows each."""

    def __init__(self, n: int) -> None:
        self.table = _digits(n)

    def write(self, ids: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids and signs, and how many bytes each has."""
        rows = self.table[ids]
        rows[:, -1] = sign
        return rows, (rows != 0).sum(axis=1)


_shown: dict[int, _Shown] = {}


def _groups_text(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, size: int) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;`: all groups one after the other, and where each group ends in it.

    last_a, last_b: the tokens that end a group."""
    if size not in _shown:
        _shown[size] = _Shown(size)
    group_a, group_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    group_a[last_a[:-1] + 1] = 1
    group_b[last_b[:-1] + 1] = 1
    group_a, group_b = np.cumsum(group_a), np.cumsum(group_b)
    # A group's A tokens come after all earlier groups' B tokens, its B tokens after its A tokens.
    place_a = np.arange(len(a)) + np.concatenate([np.zeros(1, np.int64), last_b + 1])[group_a]
    place_b = np.arange(len(b)) + (last_a + 1)[group_b]
    ids, sign = np.zeros(len(a) + len(b), np.int32), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    sign[place_a[last_a]] = ord("|")
    sign[place_b[last_b]] = ord(";")
    rows, n = _shown[size].write(ids, sign)
    return rows[rows != 0].tobytes(), np.cumsum(n)[place_b[last_b]]


def aligned(texts: list[str | None], a_bpe, b_bpe) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """A row per text (n_a, n_b, n_groups, n_links, groups_sha256), and all links one after the other: text, A id, B id.

    All texts of a call are aligned together: their bytes follow each other, and no token spans two texts."""
    ids_a: list[np.ndarray] = []
    ids_b: list[np.ndarray] = []
    taken = []
    for k, text in enumerate(texts):
        if text:
            # One text at a time: lists of ids take many times the room of the arrays.
            a, b = a_bpe.plain_ids(f" {text}"), b_bpe.ids(text)
            if a_bpe.text(a) == f" {text}".encode("utf-8", "surrogatepass") == b_bpe.text(b):
                ids_a.append(np.array(a, np.int32))
                ids_b.append(np.array(b, np.int32))
                taken.append(k)
    made = pd.DataFrame(0, index=range(len(texts)), columns=list(_NUMBERS))
    made["groups_sha256"] = ""
    if not taken:
        return made, *[np.zeros(0, np.int64)] * 3
    kept = np.array(taken)
    n_a, n_b = (np.array([len(x) for x in ids]) for ids in (ids_a, ids_b))
    a, b = np.concatenate(ids_a), np.concatenate(ids_b)
    first, n, last_a = overlaps(np.cumsum(a_bpe.lengths[a]), np.cumsum(b_bpe.lengths[b]))
    last_b = (first + n - 1)[last_a]
    end_a = np.cumsum(n_a)
    groups = np.searchsorted(last_a, end_a - 1) + 1  # groups up to each text's end
    shown, end = _groups_text(a, b, last_a, last_b, max(a_bpe.size, b_bpe.size))
    at = 0
    shas = []
    for stop in end[groups - 1].tolist():
        shas.append(hashlib.sha256(memoryview(shown)[at : stop - 1]).hexdigest())
        at = stop
    made.loc[kept, "n_a"], made.loc[kept, "n_b"], made.loc[kept, "groups_sha256"] = n_a, n_b, shas
    made.loc[kept, "n_groups"] = np.diff(groups, prepend=0)
    text_of = np.repeat(np.repeat(kept, n_a), n)
    made.loc[kept, "n_links"] = np.bincount(text_of, minlength=len(texts))[kept]
    return made, text_of, np.repeat(a, n), b[np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)]


def align(docs: DataFrame, a_file: str, a_pattern: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", turn_bytes: int = 2_000_000) -> DataFrame:
    """Tokens of two tokenizers linked where their bytes overlap; one row per document.

    a_file: a byte-level BPE file of the `tokenizers` library with its pre-token pattern, which encodes a space and the
    text; b_file: a sentencepiece model, which adds the space itself. Columns: id_col, n_a, n_b, n_groups, n_links, n_best
    (links whose id pair is in as many documents as any pair of its A id), count_sum (documents of the pair, summed over
    links), groups_sha256.

    Each task aligns its texts in turns of about turn_bytes (a longer text on its own) and writes, for each turn, its
    documents with their links as places in the turn's list of distinct id pairs, and that list with the documents that
    hold each pair. The lists are summed by pair, which is a few thousand rows a turn whatever the texts repeat, and the
    sums go back to the turns. Null and empty texts, and texts whose tokens do not give the text's bytes back, have no
    tokens: zeros and ''. Repeated rows and null ids count as documents of their own; other columns play no part; an
    empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    lists = ", ".join(f"{c} array<long>" for c in _NUMBERS)

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        a_bpe, b_bpe = byte_bpe(a_file, a_pattern), piece_bpe(b_file)
        packer = zstandard.ZstdCompressor(level=1)
        for k, rows in enumerate(in_turns(batches, 1, turn_bytes)):
            made, text, a, b = aligned(rows.column(1).to_pylist(), a_bpe, b_bpe)
            place, pairs = pd.factorize(a.astype(np.int64) * b_bpe.size + b)
            # Distinct pairs of each text, and how often the text has them.
            held, keys = pd.factorize(text * max(len(pairs), 1) + place)
            often = np.bincount(held, minlength=len(keys))
            of_text, place = np.divmod(keys, max(len(pairs), 1))
            holders = np.bincount(place, minlength=len(pairs))
            links = [packer.compress(x.astype("<u4").tobytes()) for x in (place, often)]
            turn = pa.array([(part << 32) | k])
            ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0))
            columns = [turn, ids, *(pa.array([made[c].tolist()], pa.list_(pa.int64())) for c in _NUMBERS), pa.array([made["groups_sha256"].tolist()], pa.list_(pa.string()))]
            columns += [pa.array([np.bincount(of_text, minlength=rows.num_rows).tolist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in links)]
            columns += [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (pairs // b_bpe.size, pairs % b_bpe.size, holders)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    columns = f"turn long, ids array<{kind}>, {lists}, shas array<string>, pairs_of array<long>, places binary, often binary, pair_a array<long>, pair_b array<long>, holders array<long>"
    names = ["turn", "ids", *_NUMBERS, "shas", "pairs_of", "places", "often", "pair_a", "pair_b", "holders"]
    turns = stash(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(first, columns))

    listed = turns.select("turn", F.posexplode(F.arrays_zip("pair_a", "pair_b", "holders")).alias("place", "pair"))
    listed = listed.select("turn", "place", F.col("pair.pair_a").alias("a"), F.col("pair.pair_b").alias("b"), F.col("pair.holders").alias("holders"))
    totals = listed.groupBy("a", "b").agg(F.sum("holders").alias("total"))
    # An A id has no more partners than B has ids.
    totals = totals.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy("a")))
    back = listed.join(totals, ["a", "b"]).select(F.col("turn").alias("of_turn"), "place", "total", "best")

    def second(key, of_turn: pa.Table, values: pa.Table) -> pa.Table:
        row = {c: of_turn.column(c)[0] for c in of_turn.column_names}
        order = np.argsort(values.column("place").to_numpy())
        total = values.column("total").to_numpy()[order]
        best = values.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        unpacker = zstandard.ZstdDecompressor()
        place, often = (np.frombuffer(unpacker.decompress(row[c].as_py()), "<u4").astype(np.int64) for c in ("places", "often"))
        end = np.cumsum(row["pairs_of"].values.to_numpy())
        summed = [np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(often * x[place])])[end], prepend=0) for x in (best, total)]
        out = [row["ids"].values, *(row[c].values for c in _NUMBERS), *(pa.array(x, pa.int64()) for x in summed), row["shas"].values]
        return pa.Table.from_arrays(out, names=["doc_key", *_NUMBERS, "n_best", "count_sum", "groups_sha256"])

    made = f"doc_key {kind}, {', '.join(f'{c} long' for c in _NUMBERS)}, n_best long, count_sum long, groups_sha256 string"
    held = turns.drop("pair_a", "pair_b", "holders")
    return held.groupBy("turn").cogroup(back.groupBy("of_turn")).applyInArrow(second, made).withColumnRenamed("doc_key", id_col)
