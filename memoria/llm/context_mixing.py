"""Language-model scores by logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import in_turns, lowered, mix, stash, unmix, unstash

#: Stands before a text as its context and after it as its end; no byte of UTF-8 has this value.
_END = 255
_PIECE = 1 << 21
_PRIOR = 0.1
_BUCKETS = 33
#: A fit takes so many passes at most, fewer where one gains less than this share of the cost, and pulls weights to equal ones.
_PASSES, _ENOUGH, _PULL = 5, 1e-3, 1.0


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 2 when divided by 7; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 7 == 2, F.lit(False))


def windows_of(raws: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows of the texts, for each byte and each text's end the place of its window among them, and
    where each text ends. A window is a symbol in the lowest 8 bits and the `depth` (6 at most) bytes before it, the nearest
    lowest."""
    pad = bytes([_END]) * depth
    data = bytes([_END]) * 7 + b"".join(r + pad for r in raws)
    n = len(data) - 7
    # The eight bytes up to each place as one number, the place's own byte lowest.
    upto = np.ndarray((n,), ">u8", data, 0, (1,))
    ends = np.cumsum(np.array([len(r) + 1 for r in raws], np.int64))
    # Of the bytes between two texts only the first is a symbol, the end.
    symbol = np.ones(n, bool)
    for k in range(1, depth):
        symbol[ends - 1 + np.arange(len(raws)) * (depth - 1) + k] = False
    codes = np.zeros(int(symbol.sum()), np.int32)
    known: list[np.ndarray] = []
    cuts = [0]
    count = 0
    for at in range(0, len(symbol), _PIECE):
        window = upto[at : at + _PIECE].astype(np.int64) & ((1 << 8 * (depth + 1)) - 1)
        part, found = pd.factorize(window[symbol[at : at + _PIECE]])
        codes[cuts[-1] : cuts[-1] + len(part)] = part + count
        cuts.append(cuts[-1] + len(part))
        known.append(found)
        count += len(found)
    if not known:
        return np.zeros(0, np.int64), codes, ends
    place, found = pd.factorize(np.concatenate(known))
    place = place.astype(np.int32)
    for low, high in zip(cuts, cuts[1:], strict=False):
        codes[low:high] = place[codes[low:high]]
    return found, codes, ends


def context_key(order: int, context: np.ndarray, depth: int) -> np.ndarray:
    """A hash of order and context bytes. It is one to one, so different contexts never share counts."""
    return mix(((np.int64(order) << np.int64(8 * depth)) | context).astype(np.uint64)).astype(np.int64)


def context_of(key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and context bytes of context_key's hashes."""
    found = unmix(key.astype(np.uint64)).astype(np.int64)
    return found >> 8 * depth, found & ((1 << 8 * depth) - 1)


def contexts_of(windows: np.ndarray, depth: int) -> np.ndarray:
    """Keys of all contexts of order 0 to depth that the windows have."""
    return np.concatenate([context_key(k, np.unique((windows >> 8) & ((1 << 8 * k) - 1)), depth) for k in range(depth + 1)])


def grams_of(windows: np.ndarray, seen: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of a context, symbol after it, how often) for all contexts of order 0 to depth."""
    out = []
    for k in range(depth + 1):
        pairs, back = np.unique(windows & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        out.append((context_key(k, pairs >> 8, depth), pairs & 255, np.bincount(back, weights=seen, minlength=len(pairs)).astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Counts:
    """How often each symbol followed each of some contexts."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys = keys[order]
        flat = np.repeat(np.argsort(order), sizes) * 256 + symbols
        by = np.argsort(flat)
        self.flat = flat[by]
        self.sum = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts[by])])

    def bits(self, keys: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of the symbols' 8 bits: how often a 0 and how often a 1 followed the context and the bits before."""
        row = np.searchsorted(self.keys, keys)
        row[row == len(self.keys)] = 0
        known = self.keys[row] == keys if len(self.keys) else np.zeros(len(keys), bool)
        base = row * 256
        upto = lambda symbol: self.sum[np.searchsorted(self.flat, base + symbol)] * known
        low, high = upto(0), upto(256)
        for bit in range(7, -1, -1):
            middle = upto((symbols >> bit | 1) << bit)
            yield middle - low, high - middle
            one = (symbols >> bit & 1).astype(bool)
            low, high = np.where(one, middle, low), np.where(one, high, middle)


@dataclass
class Mixer:
    """Weights of the predictors for each gate, and the map that refines the mixed probability."""

    weights: np.ndarray
    refined: np.ndarray

    @classmethod
    def new(cls, depth: int) -> Mixer:
        steps = 1 / (1 + np.exp(-np.linspace(-8, 8, _BUCKETS)))
        return cls(np.full((4 * (depth + 2), depth + 2), 1 / (depth + 1)), np.tile(steps, (256, 1)))

    def probability(self, inputs: np.ndarray, gate: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Mixed and final probability of a 1, and the refining map's bucket and the share of the next one."""
        stretched = np.clip(np.einsum("nk,nk->n", inputs, self.weights[gate]), -7.999, 7.999)
        mixed = 1 / (1 + np.exp(-stretched))
        at = (stretched + 8) * ((_BUCKETS - 1) / 16)
        bucket = at.astype(np.int64)
        share = at - bucket
        refined = self.refined[node, bucket] * (1 - share) + self.refined[node, bucket + 1] * share
        return mixed, np.clip((mixed + refined) / 2, 1e-5, 1 - 1e-5), bucket, share


def predictions(windows: np.ndarray, counts: Counts, depth: int, without: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the 8 bits of the windows' symbols: the predictors' inputs, the gate, the bits before it, the bit.

    A predictor's input is the log odds of its counts. The gate is the longest context that was seen and how often, so
    each has weights of its own. without: occurrences of the window itself that the counts leave out."""
    orders = []
    for k in range(depth + 1):
        pairs, back = np.unique(windows & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        orders.append((counts.bits(context_key(k, pairs >> 8, depth), pairs & 255), back))
    symbol = windows & 255
    for bit in range(7, -1, -1):
        one = symbol >> bit & 1
        inputs = np.ones((len(windows), depth + 2))
        gate = np.zeros(len(windows), np.int64)
        for k, (bits, back) in enumerate(orders):
            zeros, ones = next(bits)
            n0, n1 = zeros[back], ones[back]
            if without:
                n0, n1 = np.maximum(n0 - without * (1 - one), 0), np.maximum(n1 - without * one, 0)
            inputs[:, k] = np.log((n1 + _PRIOR) / (n0 + _PRIOR))
            n = n0 + n1
            gate = np.where(n > 0, 4 * (k + 1) + (n > 1) + (n > 3) + (n > 15), gate)
        yield inputs, gate, (1 << (7 - bit)) | (symbol >> (bit + 1)), one


def _slopes(windows: np.ndarray, seen: np.ndarray, counts: Counts, mixer: Mixer, depth: int) -> np.ndarray:
    """Of each gate the coding cost of all occurrences of the windows, its slope and its curvature in the gate's weights. Counts
    leave the predicted occurrence out."""
    k = mixer.weights.shape[1]
    out = np.zeros((len(mixer.weights), 1 + k + k * k))
    for at in range(0, len(windows), _PIECE // 16):
        times = seen[at : at + _PIECE // 16].astype(np.float64)
        for inputs, gate, _, one in predictions(windows[at : at + _PIECE // 16], counts, depth, without=1):
            by = np.argsort(gate, kind="stable")
            x, bit, n = inputs[by], one[by], times[by]
            cuts = np.searchsorted(gate[by], np.arange(len(out) + 1))
            for g in np.flatnonzero(np.diff(cuts)):
                low, high = cuts[g], cuts[g + 1]
                p = 1 / (1 + np.exp(-np.clip(x[low:high] @ mixer.weights[g], -7.999, 7.999)))
                out[g, 0] -= n[low:high] @ np.log(np.where(bit[low:high] == 1, p, 1 - p))
                out[g, 1 : k + 1] += (n[low:high] * (bit[low:high] - p)) @ x[low:high]
                out[g, k + 1 :] += ((x[low:high] * (n[low:high] * p * (1 - p))[:, None]).T @ x[low:high]).ravel()
    return out


def _bits_near(windows: np.ndarray, seen: np.ndarray, counts: Counts, mixer: Mixer, depth: int) -> np.ndarray:
    """For each entry of the refining map how many bits fall to it, and how many of them are 1; a bit between two buckets
    is shared out between them."""
    out = np.zeros((2, mixer.refined.size))
    for at in range(0, len(windows), _PIECE // 16):
        times = seen[at : at + _PIECE // 16].astype(np.float64)
        for inputs, gate, node, one in predictions(windows[at : at + _PIECE // 16], counts, depth, without=1):
            _, _, bucket, share = mixer.probability(inputs, gate, node)
            for place, part in ((bucket, times * (1 - share)), (bucket + 1, times * share)):
                flat = node * _BUCKETS + place
                out[0] += np.bincount(flat, weights=part, minlength=out.shape[1])
                out[1] += np.bincount(flat, weights=part * one, minlength=out.shape[1])
    return out


def _fit(total: Callable[[Callable, Mixer], np.ndarray], depth: int) -> Mixer:
    """The mixer for all occurrences of all windows. total: the sum of what a function of (windows, seen, counts, mixer,
    depth) gives for every part of them.

    Each gate's weights take Newton's steps down its cost, halved where one went too far; a weak pull to equal weights
    settles gates that few bits meet. Then the map takes the share of ones of each of its entries. Sums do not depend on
    how the windows are dealt out."""
    mixer = Mixer.new(depth)
    start, k = mixer.weights.copy(), mixer.weights.shape[1]
    best, least, slopes = start, np.full(len(start), np.inf), np.zeros((len(start), 1 + k + k * k))
    for _ in range(_PASSES):
        found = total(_slopes, mixer)
        cost = found[:, 0] + _PULL / 2 * ((mixer.weights - start) ** 2).sum(axis=1)
        better = cost < least
        gained = (least - cost)[better].sum() / max(cost.sum(), 1)
        best, least, slopes = np.where(better[:, None], mixer.weights, best), np.minimum(cost, least), np.where(better[:, None], found, slopes)
        if gained < _ENOUGH:
            break
        curve = slopes[:, k + 1 :].reshape(-1, k, k) + _PULL * np.eye(k)
        step = np.linalg.solve(curve, (slopes[:, 1 : k + 1] - _PULL * (best - start))[:, :, None])[:, :, 0]
        mixer.weights = np.where(better[:, None], best + step, (best + mixer.weights) / 2)
    mixer.weights = best
    bits, ones = total(_bits_near, mixer).reshape(2, *mixer.refined.shape)
    mixer.refined = (ones + mixer.refined) / (bits + 1)
    return mixer


def fit(raws: list[bytes], counts: Counts, depth: int) -> Mixer:
    """The mixer for all places of some texts."""
    windows, codes, _ = windows_of(raws, depth)
    seen = np.bincount(codes, minlength=len(windows))
    return _fit(lambda work, mixer: work(windows, seen, counts, mixer, depth), depth)


def fit_all(followed: DataFrame, depth: int, part: int = 100_000) -> Mixer:
    """The mixer for all places of all training texts, from their counts (key, symbols, counts) alone: the longest contexts
    with their symbols are the distinct windows, and how often each occurs.

    Contexts meet in parts of about `part` by their last two bytes, which a window's contexts of two bytes and more have in
    common; the few shorter ones go along with every task. Only sums come back."""
    low = min(2, depth)
    keys = np.concatenate([np.zeros(0, np.int64), *(context_key(k, np.arange(256**k), depth) for k in range(low))])
    keys = followed.sparkSession.createDataFrame(pa.table({"key": pa.array(keys, pa.int64())}))
    short = followed.join(F.broadcast(keys), "key").toArrow()
    parts = -(-max(followed.count(), 1) // part)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, context = context_of(batch.column(0).to_numpy(), depth)
            own = mix((context & ((1 << 8 * low) - 1)).astype(np.uint64)) % np.uint64(parts)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), *batch.columns], names=["part", "key", "symbols", "counts"]).filter(pa.array(order >= low))

    dealt = followed.select("key", "symbols", "counts").mapInArrow(deal, "part long, key long, symbols array<long>, counts array<long>")
    packed = stash(dealt.groupBy("part").agg(*(F.collect_list(c).alias(c) for c in ("key", "symbols", "counts"))), "zstd")

    def total(work: Callable, mixer: Mixer) -> np.ndarray:
        def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: np.ndarray | None = None
            for batch in batches:
                for i in range(batch.num_rows):
                    rows = pa.table([batch.column(c).slice(i, 1).flatten() for c in ("key", "symbols", "counts")], names=["key", "symbols", "counts"])
                    order, context = context_of(rows.column("key").to_numpy(), depth)
                    sizes = pa.compute.list_value_length(rows.column("symbols")).to_numpy()
                    symbols, seen = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("symbols", "counts"))
                    whole = np.repeat(order == depth, sizes)
                    windows = (np.repeat(context, sizes) << 8 | symbols)[whole]
                    by = np.argsort(windows)
                    found = work(windows[by], seen[whole][by], _counted(pa.concat_tables([rows, short.select(rows.column_names).cast(rows.schema)])), mixer, depth)
                    out = found if out is None else out + found
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.ravel()])], names=["sums"])

        empty = np.zeros(0, np.int64)
        out = work(empty, empty, Counts(empty, empty, empty, empty), mixer, depth)
        sums = packed.select("key", "symbols", "counts").mapInArrow(summed, "sums array<double>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).toArrow()
        out.ravel()[sums.column("pos").to_numpy()] = sums.column("n").to_numpy()
        return out

    mixer = _fit(total, depth)
    unstash(packed)
    return mixer


def log10_probability(windows: np.ndarray, counts: Counts, mixer: Mixer, depth: int) -> np.ndarray:
    """Of each window's symbol after its context."""
    out = np.zeros(len(windows))
    for at in range(0, len(windows), _PIECE // 16):
        part = windows[at : at + _PIECE // 16]
        for inputs, gate, node, one in predictions(part, counts, depth):
            p = mixer.probability(inputs, gate, node)[1]
            out[at : at + len(part)] += np.log10(np.where(one == 1, p, 1 - p))
    return out


def tokens_of(raws: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens, the place of every token among them, and where each text ends. The end token is the empty word.

    Arrow splits at just the white space of the contract and numbers the words; it leaves empty ones at a text's ends."""
    cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(r) for r in raws], dtype=np.int64)])
    texts = pa.LargeStringArray.from_buffers(len(raws), pa.py_buffer(cuts), pa.py_buffer(b"".join(raws)))
    split = pa.compute.ascii_split_whitespace(texts)
    words = split.flatten()
    some = pa.compute.binary_length(words).to_numpy(zero_copy_only=False) > 0
    numbered = words.filter(pa.array(some)).dictionary_encode()
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(some)])[split.offsets.to_numpy()]
    ends = upto[1:] + np.arange(1, len(raws) + 1)
    codes = np.zeros(len(numbered) + len(raws), np.int32)
    inner = np.ones(len(codes), bool)
    inner[ends - 1] = False
    codes[inner] = numbered.indices.to_numpy(zero_copy_only=False) + 1
    return pa.concat_arrays([pa.array([""], pa.string()), numbered.dictionary.cast(pa.string())]), codes, ends


def _blocks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about _PIECE places in all, a longer text alone."""
    low = 0
    while low < len(ends):
        start = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, start + _PIECE, "right")))
        yield low, high
        low = high


def _sums(values: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each text's sum of the values that its codes name; every text has a code at least."""
    out = np.zeros(len(ends))
    for low, high in _blocks(ends):
        start = ends[low - 1] if low else 0
        cut = np.concatenate([np.zeros(1, np.int64), ends[low : high - 1] - start])
        out[low:high] = np.add.reduceat(values[codes[start : ends[high - 1]]], cut)
    return out


def _of_train(codes: np.ndarray, ends: np.ndarray, train: np.ndarray, n: int) -> np.ndarray:
    """How often each code is in training texts."""
    out = np.zeros(n, np.int64)
    for low, high in _blocks(ends):
        start = ends[low - 1] if low else 0
        sizes = np.diff(ends[low:high], prepend=start)
        out += np.bincount(codes[start : ends[high - 1]][np.repeat(train[low:high], sizes)], minlength=n)
    return out


def _counted(rows: pa.Table) -> Counts:
    symbols, counts = (rows.column(c).combine_chunks() for c in ("symbols", "counts"))
    sizes = pa.compute.list_value_length(symbols).to_numpy(zero_copy_only=False) if len(symbols) else np.zeros(0, np.int64)
    return Counts(rows.column("key").to_numpy(), sizes, symbols.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts.flatten().to_numpy(zero_copy_only=False))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 4, turn_bytes: int = 8_000_000) -> DataFrame:
    """The model's log10 probability of every whole text, a row per document, next to that of single tokens.

    The model codes a text's bytes (A-Z in lower case) and its end bit by bit. For the contexts of 0 to `depth` bytes it
    has one predictor each, whose counts come from all documents that are not held out; their log odds are mixed by
    weights that a gate selects, and the result is refined by a map. Counts, weights and map all come from every place of
    every one of these documents (see fit_all).

    Tasks read texts in turns of about turn_bytes (a longer text on its own) and write each turn with its distinct
    windows, contexts and tokens. Counts are summed by key and go back to the turns that asked for them, so only distinct
    keys of a turn are shuffled, never places of texts, and no task gets the counts of the corpus.

    Columns: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte (the end
    counts as a byte). Null and empty texts are the end alone; a null id is not held out; repeated rows count and get a
    row each; other columns play no part; an empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held"))
    names = ["turn", "ids", "held", "sizes", "texts", "gram_key", "gram_symbol", "gram_n", "contexts", "words", "word_seen"]

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=1)
        for k, batch in enumerate(in_turns(batches, 1, turn_bytes)):
            raws = [lowered(t) for t in batch.column(1).to_pylist()]
            train = ~batch.column(2).to_numpy(zero_copy_only=False)
            windows, codes, ends = windows_of(raws, depth)
            seen = _of_train(codes, ends, train, len(windows))
            words, word_codes, word_ends = tokens_of(raws)
            listed = [*grams_of(windows[seen > 0], seen[seen > 0], depth), contexts_of(windows, depth)]
            one = [pa.array([(part << 32) | k]), *(pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in (0, 2))]
            one += [pa.array([[len(r) for r in raws]], pa.list_(pa.int64())), pa.array([packer.compress(b"".join(raws))], pa.binary())]
            one += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in listed]
            word_seen = pa.array(_of_train(word_codes, word_ends, train, len(words)), pa.int64())
            one += [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, word_seen)]
            yield pa.RecordBatch.from_arrays(one, names=names)

    longs = ", ".join(f"{c} array<long>" for c in ("gram_key", "gram_symbol", "gram_n", "contexts"))
    turns = stash(rows.mapInArrow(first, f"turn long, ids array<{kind}>, held array<boolean>, sizes array<long>, texts binary, {longs}, words array<string>, word_seen array<long>"), "zstd")

    # Symbols after every context, over all training texts.
    grams = turns.select(F.explode(F.arrays_zip("gram_key", "gram_symbol", "gram_n")).alias("g"))
    grams = grams.groupBy(F.col("g.gram_key").alias("key"), F.col("g.gram_symbol").alias("symbol")).agg(F.sum("g.gram_n").alias("n"))
    # A context has no more symbols than a byte has values.
    grams = grams.groupBy("key").agg(F.collect_list(F.struct("symbol", "n")).alias("after"))
    followed = stash(grams.select("key", F.col("after.symbol").alias("symbols"), F.col("after.n").alias("counts")))
    asked = turns.select(F.col("turn").alias("of_turn"), F.explode("contexts").alias("key"))
    # What goes back to a turn goes as one row, which has no more entries than the turn has bytes. Lists of one
    # aggregate are in one order; plain numbers take half the room of structs.
    lists = lambda *names: [F.collect_list(n).alias(n) for n in names]
    contexts = asked.join(followed, "key").groupBy("of_turn").agg(*lists("key", "symbols", "counts"))

    # Tokens: all rows of a token (one a turn at most) meet in the shuffle that sums them.
    tokens = turns.select("turn", F.posexplode(F.arrays_zip("words", "word_seen")).alias("place", "w"))
    tokens = tokens.select("turn", "place", F.col("w.words").alias("word"), F.col("w.word_seen").alias("n"))
    of_word = Window.partitionBy("word")
    tokens = stash(tokens.select("turn", "place", "n", F.sum("n").over(of_word).alias("total"), F.count("*").over(of_word).alias("turns")), "zstd")
    # A known token has `turns` rows, so the rows with that many turns hold rows / turns tokens.
    known = tokens.groupBy("turns").agg(F.sum("n").alias("n"), F.expr("count_if(total > 0) div turns").alias("known"))
    train_tokens, distinct = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()

    mixer = fit_all(followed, depth)

    places = tokens.groupBy(F.col("turn").alias("of_turn")).agg(*lists("place", "total"))
    made = f"doc_key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"

    schema = to_arrow_schema(StructType.fromDDL(made))

    def second(key, turn: pa.Table, values: pa.Table) -> pa.Table:
        row = {c: turn.column(c)[0] for c in turn.column_names}
        text = zstandard.ZstdDecompressor().decompress(row["texts"].as_py())
        cuts = np.cumsum(row["sizes"].values.to_numpy())
        raws = [text[s:e] for s, e in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
        one = {c: pa.concat_arrays(values.column(c).chunks).flatten() for c in ("key", "symbols", "counts", "place", "total")}
        windows, codes, ends = windows_of(raws, depth)
        scores = _sums(log10_probability(windows, _counted(pa.table([one[c] for c in ("key", "symbols", "counts")], names=["key", "symbols", "counts"])), mixer, depth), codes, ends)
        del codes
        total = one["total"].to_numpy()[np.argsort(one["place"].to_numpy())]
        _, codes, word_ends = tokens_of(raws)
        base = _sums(np.log10((total + 1) / (train_tokens + distinct + 1)), codes, word_ends)
        n_known = _sums((total > 0).astype(np.float64), codes, word_ends)
        n = len(raws)
        size = np.diff(ends, prepend=0)
        numbers = [np.diff(word_ends, prepend=0), n_known, np.full(n, train_tokens), base, scores, size - 1, -scores / np.log10(2) / size]
        types = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.int64(), pa.float64()]
        return pa.Table.from_arrays([row["ids"].values, row["held"].values, *(pa.array(x).cast(t) for x, t in zip(numbers, types, strict=True))], schema=schema)

    read = turns.select("turn", "ids", "held", "sizes", "texts")
    return read.groupBy("turn").cogroup(contexts.unionByName(places, allowMissingColumns=True).groupBy("of_turn")).applyInArrow(second, made).withColumnRenamed("doc_key", id_col)
