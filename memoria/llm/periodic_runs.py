"""Periodic runs of words: Main-Lorentz divide and conquer over interned word ids."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, in_turns, mix, numbered, word_spans

_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 20
#: The gaps of words, as the operator's contract lists them.
_GAPS = b" \t\n\x0b\x0c\r"


class Words:
    """Word ids of several texts, one after the other, and the lengths of common extensions between places of a text.

    A common extension is the value of a Z-function: how many words from one place on equal those from another on. It is
    taken for many places at a time by halving steps over a running polynomial hash of the ids; who uses the lengths
    compares the words themselves afterwards.
    """

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        n = len(ids)
        self.power = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n, _BASE, U64)]))
        self.run = np.zeros(n + 1, U64)
        np.cumsum(mix(ids.astype(U64) + U64(1)) * self.power[:n], out=self.run[1:])

    def _alike(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i on and from j > i on have one hash."""
        return (self.run[i + n] - self.run[i]) * self.power[j - i] == self.run[j + n] - self.run[j]

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j > i on, `most` at the most."""
        found = np.zeros(len(i), np.int64)
        for bit in reversed(range(int(most.max(initial=0)).bit_length())):
            longer = found + (1 << bit)
            may = np.flatnonzero(longer <= most)
            may = may[self._alike(i[may], j[may], longer[may])]
            found[may] = longer[may]
        return found

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words that end before i equal those that end before j > i, `most` at the most."""
        found = np.zeros(len(i), np.int64)
        for bit in reversed(range(int(most.max(initial=0)).bit_length())):
            longer = found + (1 << bit)
            may = np.flatnonzero(longer <= most)
            may = may[self._alike(i[may] - longer[may], j[may] - longer[may], longer[may])]
            found[may] = longer[may]
        return found


def _crossing(ids: np.ndarray, low: np.ndarray, high: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, place, period) that may start a run of `times` periods over the middle of its segment: the words from
    place on and those a period later are to be compared. A run has a whole period before the middle (place is a period
    before it) or nearly all of it after (place is the middle); either way at least two equal words in a row touch it."""
    middle = (low + high) >> 1
    reach = (high - low) // times
    seg = np.repeat(np.arange(len(low), dtype=np.int32), reach)
    period = np.arange(len(seg), dtype=np.int64) - np.repeat(np.cumsum(reach) - reach, reach) + 1
    at = middle[seg]
    before = at - period
    # Places at a text's ends: what is compared there wrongly is settled by the extensions, which know the ends.
    last = len(ids) - 1
    mid = ids[middle]
    near = ids[np.maximum(middle - 1, 0)]
    ahead = (ids[before] == mid[seg]) & (ids[before + 1] == ids[np.minimum(middle + 1, last)][seg])
    behind = (ids[np.maximum(before - 1, 0)] == near[seg]) & (ids[np.maximum(before - 2, 0)] == ids[np.maximum(middle - 2, 0)][seg])
    left = np.flatnonzero(ahead | behind)
    after = np.minimum(at + period, last)
    right = np.flatnonzero((ids[after] == mid[seg]) & (ids[np.minimum(after + 1, last)] == ids[np.minimum(middle + 1, last)][seg]))
    return np.concatenate([seg[left], seg[right]]), np.concatenate([before[left], at[right]]), np.concatenate([period[left], period[right]])


def _exact(ids: np.ndarray, start: int, end: int, period: int) -> bool:
    return bool(np.array_equal(ids[start : end - period], ids[start + period : end]))


def _by_words(ids: np.ndarray, low: int, high: int, place: int, period: int) -> tuple[int, int]:
    """The stretch around place with that period, word by word."""
    s = e = place
    while s > low and ids[s - 1] == ids[s - 1 + period]:
        s -= 1
    while e + period < high and ids[e] == ids[e + period]:
        e += 1
    return s, e + period


def find_runs(ids: np.ndarray, ends: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (text, start, length, period) of all maximal runs of `times` periods and `least` words, by text and start.

    ids: word ids of the texts one after the other; ends: where each text ends. Every text is halved again and again;
    at each middle the runs that cross it come from common extensions forwards and backwards, for every period that fits
    in the segment `times` times, and extensions go on to the text's ends. Pieces of a run that lower middles find again
    become the same interval, of which the smallest period stays. All segments of a level are worked off together, and
    every run found is compared word by word.
    """
    words = Words(ids)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]).astype(np.int64)
    low, high, text = starts, ends.astype(np.int64), np.arange(len(ends))
    found = []
    while True:
        big = high - low >= least
        low, high, text = low[big], high[big], text[big]
        if not len(low):
            break
        seg, place, period = _crossing(ids, low, high, times)
        of = text[seg]
        far = place + period
        ok = far < ends[of]
        of, place, period, far = of[ok], place[ok], period[ok], far[ok]
        start = place - words.backward(place, far, place - starts[of])
        end = far + words.forward(place, far, ends[of] - far)
        ok = end - start >= np.maximum(least, times * period)
        found.append(np.stack([of[ok], start[ok], end[ok], period[ok], place[ok]], axis=1))
        middle = (low + high) >> 1
        low, high, text = np.concatenate([low, middle]), np.concatenate([middle, high]), np.concatenate([text, text])
    rows = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
    rows = _smallest(rows)
    for k, (of, start, end, period, place) in enumerate(rows.tolist()):
        if not _exact(ids, start, end, period):
            rows[k, 1:3] = _by_words(ids, int(starts[of]), int(ends[of]), place, period)
    rows = _smallest(rows[rows[:, 2] - rows[:, 1] >= np.maximum(least, times * rows[:, 3])])
    return np.stack([rows[:, 0], rows[:, 1] - starts[rows[:, 0]], rows[:, 2] - rows[:, 1], rows[:, 3]], axis=1)


def _smallest(rows: np.ndarray) -> np.ndarray:
    """One row for each interval, that with the smallest period."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    return rows[first]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run after its first period; runs: rows (start, length, period)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:n]) > 0


def _slices(data: bytes) -> Iterator[bytes]:
    """The text in slices of about a megabyte that cut no word."""
    at = 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        while end < len(data) and data[end] not in _GAPS:
            end += 1
        yield data[at:end]
        at = end


class _Text:
    """A text's words as the operator counts them; `order` names the original word of each, None where it is its own."""

    def __init__(self, key: str | None, text: str | None, intern: dict[bytes, int]) -> None:
        self.data = (text or "").encode("utf-8", "surrogatepass")
        # bytes.split() splits at just the gaps of the contract.
        parts = [np.fromiter(map(intern.__getitem__, piece.split()), np.int32) for piece in _slices(self.data)]
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.order: np.ndarray | None = None
        n = len(self.ids)
        h = zlib.crc32(key.encode()) if key is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            order = np.arange(n)
            order[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
            self.order, self.ids = order, self.ids[order]

    def digest(self, gone: np.ndarray | None) -> str:
        """SHA-256 of the words that stay, joined by one space."""
        out = hashlib.sha256()
        if gone is None and self.order is None:
            some = False
            for piece in _slices(self.data):
                joined = b" ".join(piece.split())
                out.update(b" " + joined if some and joined else joined)
                some = some or bool(joined)
            return out.hexdigest()
        order = self.order if self.order is not None else np.arange(len(self.ids))
        order = order if gone is None else order[~gone]
        _, start, end = word_spans(self.data)
        for k in range(0, len(order), 1 << 16):
            part = order[k : k + (1 << 16)]
            joined = b" ".join([self.data[s:e] for s, e in zip(start[part].tolist(), end[part].tolist(), strict=True)])
            out.update(b" " + joined if k else joined)
        return out.hexdigest()


def _described(text: _Text, runs: np.ndarray) -> tuple:
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    if not len(runs):
        return (0, None, None, None, None, hashlib.sha256().hexdigest(), text.digest(None))
    start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
    return (len(runs), start, length, period, 1000 * length // period, hashlib.sha256(listed.encode()).hexdigest(), text.digest(dropped(len(text.ids), runs)))


def described(rows: list[tuple[str | None, str | None]], least: int = 6, times: int = 4) -> list[tuple]:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each (id as text, text)."""
    intern = numbered()
    texts = [_Text(key, text, intern) for key, text in rows]
    ends = np.cumsum([len(t.ids) for t in texts])
    runs = find_runs(np.concatenate([t.ids for t in texts]), ends, least, times)
    cuts = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    return [_described(t, runs[cuts[k] : cuts[k + 1], 1:]) for k, t in enumerate(texts)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4, turn_bytes: int = 4_000_000) -> DataFrame:
    """Runs of words of every whole text, a row per document: id, n_runs, the longest run, digests of all runs and of
    the text without the repeats.

    A run is a maximal stretch of words with smallest period q, `times` * q words and `least` words long at least. Texts
    are taken in turns of about turn_bytes, a longer text on its own, so memory follows the longest text. Nothing is
    shuffled. Null, empty and blank texts have no words: no runs and the digest of nothing. A null id leaves the words
    as they are; repeated rows get a row each; other columns play no part; an empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    columns = f"doc_key {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.string()] * 2
        for part in in_turns(batches, 2, turn_bytes):
            made = described(list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)), least, times)
            cols = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_key", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(id_col).cast("string").alias("shown"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, columns).withColumnRenamed("doc_key", id_col)
