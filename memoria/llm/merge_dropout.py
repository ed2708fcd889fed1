"""SentencePiece encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, mix

SPACE = "▁"
_M64 = (1 << 64) - 1
_ONE, _TWO = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Symbols from here on are characters that are no piece: this plus the code point.
_CHAR = 1 << 17
_NONE = np.int64(1) << 62
#: Longer words go through the heap, one by one.
_WIDE = 64


def _candidate(i: int, j: int, score: int) -> int:
    """The number of a candidate merge: where its two parts begin in the word, and the piece it gives."""
    return ((i << 42) ^ (j << 21) ^ score) & _M64


def _below(key: int, candidate: int, cut: int) -> bool:
    """The keyed hash decision on a candidate: key picks document and the word's place, cut is the rate of 2^24."""
    x = ((key ^ candidate) * _ONE) & _M64
    return (((x ^ (x >> 29)) * _TWO) & _M64) >> 40 < cut


class MergeDropout:
    """Encoder and decoder over a SentencePiece merge model with byte fallback.

    Words (a run of space marks and what follows up to the next) are segmented alone, as no piece has a space mark
    after another character. All adjacent pairs that form a piece stand on an agenda by score, then place; a pair taken
    from it is skipped where a hash keyed by seed, document and the word's place falls below the rate. So each
    occurrence of a word has decisions of its own. Rate 0 gives the library's own ids. The agendas of many words of one
    length are worked off side by side, a candidate of each at a time.
    """

    def __init__(self, path: str, seed: int, rate: float) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        self.byte_id = np.zeros(256, np.int64)
        pieces: dict[str, tuple[int, int]] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                pieces[piece] = i, -round(sp.get_score(i))
                self.bytes.append(piece.replace(SPACE, " ").encode())
        assert not any(SPACE in p.lstrip(SPACE) for p in pieces), "a piece crosses words"
        assert len(self.bytes) < _CHAR
        self.cut, self.seed = round(rate * (1 << 24)), seed & _M64
        # The symbol of every character: its piece, or a number of its own. A space is the space mark; a space mark that
        # is part of the text is a character without a piece.
        self.symbol = np.arange(0x110000, dtype=np.int64) + _CHAR
        for p, (i, _) in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[32] = self.symbol[ord(SPACE)]
        self.symbol[ord(SPACE)] = _CHAR + ord(SPACE)
        part = lambda p: pieces[p][0] if p in pieces else _CHAR + ord(p) if len(p) == 1 else None
        pairs = sorted(
            (left << 21 | right, score << 17 | i)
            for p, (i, score) in pieces.items() for k in range(1, len(p)) if (left := part(p[:k])) is not None and (right := part(p[k:])) is not None
        )
        self.pairs = np.array([x for x, _ in pairs] + [_NONE], np.int64)
        self.gives = np.array([x for _, x in pairs] + [_NONE], np.int64)

    def _merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Score and piece of merging two symbols, as one number; _NONE where they form no piece."""
        pair = left << 21 | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.gives[at], _NONE)

    def _side_by_side(self, x: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Work off the agendas of words of one length (rows of x, in place); which symbols are left."""
        rows, n = x.shape
        stays = np.ones((rows, n), bool)
        if n < 2:
            return stays
        # The agenda: of every symbol the merge with the next one. after and before link the symbols left.
        agenda = np.full((rows, n), _NONE)
        agenda[:, :-1] = self._merge(x[:, :-1], x[:, 1:])
        after = np.tile(np.arange(1, n + 1), (rows, 1))
        before = np.tile(np.arange(-1, n - 1), (rows, 1))
        going = np.arange(rows)
        while True:
            now = agenda[going]
            i = now.argmin(1)
            best = now[np.arange(len(going)), i]
            open_ = best != _NONE
            if not open_.all():
                going, i, best = going[open_], i[open_], best[open_]
                if not len(going):
                    return stays
            r, j = going, after[going, i]
            if self.cut:
                h = (key[r] ^ (i << 42 ^ j << 21 ^ best >> 17).view(U64)) * U64(_ONE)
                h = (h ^ (h >> U64(29))) * U64(_TWO)
                skip = (h >> U64(40)) < U64(self.cut)
                agenda[r[skip], i[skip]] = _NONE
                take = ~skip
                r, i, j, best = r[take], i[take], j[take], best[take]
            x[r, i] = made = best & (1 << 17) - 1
            stays[r, j] = False
            agenda[r, j] = _NONE
            after[r, i] = k = after[r, j]
            more = k < n
            fresh = np.full(len(r), _NONE)
            before[r[more], k[more]] = i[more]
            fresh[more] = self._merge(made[more], x[r[more], k[more]])
            agenda[r, i] = fresh
            p = before[r, i]
            more = p >= 0
            agenda[r[more], p[more]] = self._merge(x[r[more], p[more]], made[more])

    def _alone(self, x: np.ndarray, key: int) -> np.ndarray:
        """The same for one long word, with a heap; the symbols that are left."""
        symbols: list[int | None] = x.tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(s, i, i + 1, symbols[i], symbols[i + 1]) for i, s in enumerate(self._merge(x[:-1], x[1:]).tolist()) if s != _NONE]
        heapify(agenda)

        def push(i: int, j: int) -> None:
            a, b = symbols[i], symbols[j]
            at = int(np.searchsorted(self.pairs, a << 21 | b))
            if self.pairs[at] == a << 21 | b:
                heappush(agenda, (int(self.gives[at]), i, j, a, b))

        while agenda:
            best, i, j, a, b = heappop(agenda)
            # A pair is stale when either part has since been merged.
            if symbols[i] != a or after[i] != j or symbols[j] != b:
                continue
            if _below(key, _candidate(i, j, best >> 17), self.cut):
                continue
            symbols[i], symbols[j] = best & (1 << 17) - 1, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                push(i, k)
            if (p := before[i]) >= 0:
                push(p, i)
        return np.array([s for s in symbols if s is not None], np.int64)

    def _spelled(self, x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces for the characters among the symbols that are no piece; ends are places to keep track of."""
        odd = x >= _CHAR
        if not odd.any():
            return x, ends
        c = x[odd] - _CHAR
        size = np.ones(len(x), np.int64)
        size[odd] += (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        out = np.repeat(x, size)
        raw = "".join(map(chr, c.tolist())).encode("utf-8", "surrogatepass")
        out[out >= _CHAR] = self.byte_id[np.frombuffer(raw, np.uint8)]
        return out, np.concatenate([[0], np.cumsum(size)])[ends]

    def encode_all(self, texts: list[str], keys: list[int], rows: int = 8192) -> list[np.ndarray]:
        """Ids of whole texts; a text's key and a word's place pick the word's decisions."""
        # Every text gets a space before it; words begin at a space that no space stands before.
        texts, known = [" " + t if t else "" for t in texts], [k & _M64 for k in keys]
        c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        x = self.symbol[c]
        first = np.cumsum([0, *map(len, texts)])
        space = c == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[first[:-1][np.diff(first) > 0]] = True
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(x)))
        word = np.searchsorted(start, first)
        with np.errstate(over="ignore"):
            place = np.arange(len(start), dtype=U64) - np.repeat(word[:-1], np.diff(word)).astype(U64)
            key = mix(mix(place * U64(0x9E3779B97F4A7C15) + (np.repeat(np.array(known, U64), np.diff(word)) ^ U64(self.seed))))
            stays = np.ones(len(x), bool)
            order = np.argsort(size, kind="stable")
            lengths = size[order]
            at = 0
            while at < len(order):
                n = int(lengths[at])
                if n > _WIDE:
                    lo = int(start[order[at]])
                    found = self._alone(x[lo : lo + n], int(key[order[at]]))
                    x[lo : lo + len(found)] = found
                    stays[lo + len(found) : lo + n] = False
                    at += 1
                    continue
                end = min(int(np.searchsorted(lengths, n, "right")), at + rows)
                places = start[order[at:end], None] + np.arange(n)
                part = x[places]
                stays[places] = self._side_by_side(part, key[order[at:end]])
                x[places] = part
                at = end
        left = np.concatenate([[0], np.cumsum(stays)])[first]
        ids, ends = self._spelled(x[stays], left)
        return [ids[lo:hi].astype(np.uint16) for lo, hi in zip(ends.tolist(), ends[1:].tolist(), strict=False)]

    def encode(self, text: str, key: int) -> np.ndarray:
        return self.encode_all([text], [key])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: pieces joined, without the one space that encoding put first."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


_loaded: dict[tuple, MergeDropout] = {}


def merge_dropout(*args) -> MergeDropout:
    if args not in _loaded:
        _loaded[args] = MergeDropout(*args)
    return _loaded[args]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.1, seed: int = 0) -> DataFrame:
    """One row per document: (id_col, ids array<int>, n_ids, lossless). lossless says that decoding the ids gave the
    whole text again.

    model: path of a SentencePiece merge model with byte fallback. The same seed, id and text give the same ids
    wherever the row is. Null or empty text gives no ids and is lossless; a null id is a key of its own; repeated rows
    each give a row; extra columns are ignored; an empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.xxhash64(F.col(id_col), F.lit(seed)).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merge_dropout(model, seed, rate)

        def batch(key_column: pa.Array, ids: list[np.ndarray], same: list[bool]) -> pa.RecordBatch:
            sizes = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
            return pa.RecordBatch.from_arrays([key_column, lists, pa.array(sizes), pa.array(same, pa.bool_())], names=[id_col, "ids", "n_ids", "lossless"])

        for b in batches:
            keys, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            start = 0
            while start < len(texts):
                # Turns of about a million characters bound a task's memory.
                end, size = start, 0
                while end < len(texts) and size < 1_000_000:
                    size += len(texts[end])
                    end += 1
                ids = bpe.encode_all(texts[start:end], keys[start:end])
                yield batch(b.column(0).slice(start, end - start), ids, [bpe.decode(x.tolist()) == t for x, t in zip(ids, texts[start:end], strict=True)])
                start = end

    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_ids long, lossless boolean")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """The rows with the text of their ids; null ids give null."""
    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        bpe = merge_dropout(model, 0, 0.0)
        return ids.map(lambda x: None if x is None else bpe.decode(list(x)))

    return encoded.withColumn(out_col, text(F.col(ids_col)))
