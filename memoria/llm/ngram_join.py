"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, Forest, block_pairs, components, fresh, join_by_key, mix, shingle_set, stash, unstash, whole_groups

#: Bits of the first look at a pair, and of the widest bitmap: 4,096 sets of a tile then hold 16 MB. Wider sets only pass
#: the second look more often.
_BITS = 512
_WIDEST = 1 << 15


class Measure:
    """Jaccard similarity of at least num/den, in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.low: list[int] = [1]

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def largest(self, n: int) -> int:
        """The largest set that a set of n can link with."""
        return n * self.den // self.num

    def band(self, n: int) -> int:
        """Bands grow so that a set's partners lie in its own band or the next one up or down."""
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, self.largest(self.low[-1] - 1) + 1))
        return bisect_right(self.low, n) - 1

    def differing(self, band: int) -> int:
        """The most elements in which two linked sets differ, the smaller being of this band."""
        while len(self.low) < band + 2:
            self.band(self.low[-1])
        n = self.low[band + 1] - 1
        return (n + self.largest(n)) * (self.den - self.num) // (self.den + self.num)


@lru_cache
def _measure(num: int, den: int) -> Measure:
    return Measure(num, den)


def _node(a: np.ndarray) -> int:
    """A set's own 64-bit fingerprint. Two different sets share one with a chance of n^2 / 2^65."""
    return int.from_bytes(hashlib.blake2b(a.tobytes(), digest_size=8).digest(), "little", signed=True)


def _width(n: int) -> int:
    """Bits of the bitmap of a set of n: some four to each element."""
    return min(max(_BITS, 4 << (n - 1).bit_length()), _WIDEST)


def _bitmap(a: np.ndarray) -> bytes:
    size = _width(len(a))
    bits = np.zeros(size, np.uint8)
    bits[(a & U64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    """A bitmap made narrower: an element's place is its hash modulo the size, a power of two."""
    return np.bitwise_or.reduce(np.frombuffer(bitmap, U64).reshape(-1, size // 64), axis=0)


@lru_cache(maxsize=4096)
def _segments(d: int) -> int:
    """Into how many segments of the hash range two sets are cut that differ in at most d elements, so that one at least
    surely holds the same elements, and some, in both. Over d of them always do, but for empty ones, which some more
    make up for; of many, hashing leaves one alike with all but a chance of 1e-9 already among fewer."""
    k = (d + 1) * 11 // 10 + 4
    while k > 2 and -(k - 1) * log1p(-exp(-d / (k - 1))) > 21:
        k -= 1
    return k


def _segment_keys(a: np.ndarray, m: Measure) -> np.ndarray:
    """Keys of which two linked sets share at least one.

    Sets of a band's class differ in at most d elements. The hash range is cut into segments (see _segments) and what
    stands in each is a key; empty segments, which any two sets may share, are none. Of small sets each of the first
    elements is a key: as many as two linked sets cannot both lack.
    """
    n, own = len(a), m.band(len(a))
    keys = []
    for band in {max(own - 1, 0), own}:
        d = m.differing(band)
        if d <= 8:
            first = a[: n - -(-n * m.num // m.den) + 1]
            keys.append(mix(first + mix(U64(band + 1) << np.full(1, 40, U64))))
            continue
        k = _segments(d)
        at = ((a >> U64(32)) * U64(k)) >> U64(32)
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        keys.append(mix(np.add.reduceat(mix(a), start) + mix(at[start] + U64(k << 32))))
    return np.unique(np.concatenate(keys)).view(np.int64)


class Looks:
    """Bit counts of pairs of a tile's sets: 512 bits first, then as many as the smaller set's bitmap has. Sets differ
    in at least as many elements as their bitmaps in bits, so the overlap is at most half of what is left of both
    sizes."""

    def __init__(self, n: np.ndarray, bitmaps: list[bytes], num: int, den: int) -> None:
        self.n, self.bitmaps, self.num, self.den = n, bitmaps, num, den
        self.short = np.stack([_folded(x, _BITS) for x in bitmaps])
        self.wide = np.array([8 * len(x) for x in bitmaps])

    def _left(self, i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = self.n[i] + self.n[j]
        both = (total - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)) // 2
        return np.flatnonzero(self.den * both >= self.num * (total - both))

    def passing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The places of the pairs that the bit counts leave."""
        a, b = self.n[i], self.n[j]
        ok = np.flatnonzero(self.den * np.minimum(a, b) >= self.num * np.maximum(a, b))
        ok = ok[self._left(i[ok], j[ok], self.short[i[ok]], self.short[j[ok]])]
        size = np.minimum(self.wide[i[ok]], self.wide[j[ok]])
        out = [ok[size == _BITS]]
        for w in np.unique(size[size > _BITS]).tolist():
            at = ok[size == w]
            rows, places = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
            bits = np.stack([_folded(self.bitmaps[r], w) for r in rows.tolist()])
            out.append(at[self._left(i[at], j[at], bits[places[: len(at)]], bits[places[len(at) :]])])
        return np.sort(np.concatenate(out))


def _groups(tile: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
    return zip(cuts, cuts[1:], strict=False)


def _named(most: int):
    """Of a partition sorted by tile and node, the tiles of two nodes or more, with their least node as lead. A tile of at
    most `most` nodes takes a name that tells its nodes, so that tiles of the same nodes become one; big says which have
    more, and keep their name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def made(tile: np.ndarray, node: np.ndarray, lead: np.ndarray, big: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(tile), pa.array(node), pa.array(lead), pa.array(np.full(len(tile), big))], names=["tile", "node", "lead", "big"])

        def emit(tile: np.ndarray, node: np.ndarray, big: bool, lead: int | None = None) -> pa.RecordBatch | None:
            start = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            size = np.diff(np.append(start, len(tile)))
            if big:
                return made(tile, node, np.repeat(node[start], size) if lead is None else np.full(len(tile), lead), True)
            sums = np.add.reduceat(mix(node.view(U64)), start)
            name = mix(sums + size.astype(U64)).view(np.int64)
            _, once = np.unique(name, return_index=True)
            new = [k for k in once[size[once] > 1].tolist() if int(name[k]) not in seen]
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(name[new].tolist())
            keep = np.zeros(len(start), bool)
            keep[new] = True
            rows = np.repeat(keep, size)
            if not rows.any():
                return None
            return made(np.repeat(name, size)[rows], node[rows], np.repeat(node[start], size)[rows], False)

        tile = node = np.zeros(0, np.int64)
        flowing: int | None = None  # the lead of the held tile, where that is big and part of it has left
        for b in batches:
            tile, node = np.concatenate([tile, b.column(0).to_numpy()]), np.concatenate([node, b.column(1).to_numpy()])
            # Repeated rows of a set are one.
            fresh_row = np.append(True, (tile[1:] != tile[:-1]) | (node[1:] != node[:-1])) if len(tile) else np.zeros(0, bool)
            tile, node = tile[fresh_row], node[fresh_row]
            if not len(tile):
                continue
            if flowing is not None and tile[0] == tile[-1]:
                if len(tile) > 1:
                    yield emit(tile[:-1], node[:-1], True, flowing)
                    tile, node = tile[-1:], node[-1:]
                continue
            if flowing is not None:
                end = int((tile != tile[0]).argmax())
                yield emit(tile[:end], node[:end], True, flowing)
                tile, node, flowing = tile[end:], node[end:], None
            last = int((tile == tile[-1]).argmax())
            for found in _split(tile[:last], node[:last], most, emit):
                yield found
            tile, node = tile[last:], node[last:]
            if len(tile) > most:
                flowing = int(node[0])
                yield emit(tile[:-1], node[:-1], True)
                tile, node = tile[-1:], node[-1:]
        if flowing is not None:
            yield emit(tile, node, True, flowing)
        else:
            yield from _split(tile, node, most, emit)

    return run


def _split(tile: np.ndarray, node: np.ndarray, most: int, emit) -> Iterator[pa.RecordBatch]:
    """Whole tiles: the big ones as they are, the others together."""
    if not len(tile):
        return
    start = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
    size = np.diff(np.append(start, len(tile)))
    big = np.repeat(size > most, size)
    if big.any():
        yield emit(tile[big], node[big], True)
    if not big.all() and (found := emit(tile[~big], node[~big], False)) is not None:
        yield found


def _tile_links(num: int, den: int, few: int = 32):
    """Spanning links between the groups (known) of nodes, among the pairs that the bitmaps leave in each tile of a
    partition sorted by tile and size. Nodes of one group, or that links found before join, need no look."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for t in whole_groups(batches, "tile"):
            tile, node, known, n, side = (t.column(c).to_numpy() for c in ("tile", "node", "known", "n", "side"))
            cuts = list(_groups(tile))
            small = np.concatenate([np.full(hi - lo, hi - lo <= few) for lo, hi in cuts])
            looks = Looks(n, t.column("bits").to_pylist(), num, den)
            out: list[tuple[int, int]] = []

            def join(i: np.ndarray, j: np.ndarray, node=node, known=known, out=out) -> None:
                for a, b, ka, kb in zip(node[i].tolist(), node[j].tolist(), known[i].tolist(), known[j].tolist(), strict=True):
                    if forest.join(ka, kb):
                        out.append((min(a, b), max(a, b)))

            left, step = np.flatnonzero(small), 1
            while True:
                left = left[left < len(tile) - step]
                left = left[tile[left] == tile[left + step]]
                if not len(left):
                    break
                new = left[(known[left] != known[left + step]) & ((side[left] | side[left + step]) == 3)]
                ok = looks.passing(new, new + step)
                join(new[ok], new[ok] + step)
                step += 1
            for lo, hi in cuts:
                if hi - lo <= few:
                    continue
                root = np.array([forest.find(x) for x in known[lo:hi].tolist()])
                for i in range(hi - lo - 1):
                    end = int(np.searchsorted(n[lo:hi], n[lo + i] * den // num, "right"))
                    j = np.flatnonzero((root[i + 1 : end] != root[i]) & ((side[lo + i + 1 : lo + end] | side[lo + i]) == 3)) + i + 1
                    if not len(j):
                        continue
                    for y in j[looks.passing(np.full(len(j), lo + i), lo + j)].tolist():
                        if root[y] != root[i]:
                            join(np.array([lo + i]), np.array([lo + y]))
                            root[root == root[y]] = root[i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _starred(num: int, den: int, k: int):
    """Of tiles of a leader's text (side 0) and others, the links whose sorted arrays intersect in enough elements."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _measure(num, den)
        held, lead = None, None
        for t in batches:
            out: list[tuple[int, int]] = []
            for tile, side, node, text in zip(*(t.column(c).to_pylist() for c in ("tile", "side", "node", "text")), strict=True):
                a = shingle_set(text, k)
                if _node(a) != node:
                    continue
                if tile != held:
                    held, lead = tile, None
                if side == 0:
                    lead = (node, a)
                elif lead and m.linked(len(np.intersect1d(lead[1], a, assume_unique=True)), len(lead[1]), len(a)):
                    out.append((lead[0], node))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def _verified(num: int, den: int, k: int):
    """Spanning links among the pairs of two blocks, not joined yet, whose sorted arrays intersect in enough elements."""

    def links(tile: pa.Table) -> Iterator[tuple[int, int]]:
        m = _measure(num, den)
        sets: dict[int, np.ndarray] = {}
        side: dict[int, int] = {}
        known: dict[int, int] = {}
        for node, text, first, group in zip(*(tile.column(c).to_pylist() for c in ("node", "text", "side", "known")), strict=True):
            if node not in sets and _node(a := shingle_set(text, k)) == node:
                sets[node] = a
            side[node] = side.get(node, 0) | first
            known[node] = group
        nodes = sorted(sets, key=lambda x: (len(sets[x]), x))
        if len(nodes) < 2:
            return
        n = np.array([len(sets[x]) for x in nodes], np.int64)
        looks = Looks(n, [_bitmap(sets[x]) for x in nodes], num, den)
        sides, group = np.array([side[x] for x in nodes]), np.array([known[x] for x in nodes])
        for i in range(len(nodes) - 1):
            j = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
            j = j[(sides[i] | sides[j]) == 3]
            for y in j[looks.passing(np.full(len(j), i), j)].tolist():
                if group[y] != group[i]:
                    a, b = nodes[i], nodes[y]
                    if m.linked(len(np.intersect1d(sets[a], sets[b], assume_unique=True)), len(sets[a]), len(sets[b])):
                        group[group == group[y]] = group[i]
                        yield a, b

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "tile"):
            out: list[tuple[int, int]] = []
            for lo, hi in _groups(t.column("tile").to_numpy()):
                if hi - lo > 1:
                    out += links(t.slice(lo, hi - lo))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


@dataclass
class Joined:
    """member: (id, text_hash, n, node) of every row; node is null without a shingle. group: (node, component) of the
    nodes that have links, component being the least node."""

    member: DataFrame
    group: DataFrame


def _join(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, tile_rows: int, block: int) -> Joined:
    """See similar_groups."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text")).withColumn("key", F.coalesce("id", "text_hash"))

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _measure(num, den)
        for b in batches:
            sets = (shingle_set(t, k) for t in b.column(3).to_pylist())
            made = [(len(a), m.band(len(a)), _node(a), _bitmap(a)) if len(a) else (0, None, None, None) for a in sets]
            columns = [pa.array([x[c] for x in made], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], names=["id", "key", "text_hash", "n", "band", "node", "bits"])

    def signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _measure(num, den)
        seen: set[int] = set()
        for b in batches:
            nodes, keys = [], []
            size = 0
            for text in b.column(0).to_pylist():
                a = shingle_set(text, k)
                if len(a) and (node := _node(a)) not in seen:
                    seen.add(node)
                    found = _segment_keys(a, m)
                    nodes.append(np.full(len(found), node, np.int64))
                    keys.append(found)
                    size += len(found)
                    if size > 200_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["tile", "node"])
                        nodes, keys, size = [], [], 0
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["tile", "node"])

    member = stash(rows.select("id", "key", "text_hash", "text").mapInArrow(members, "id long, key long, text_hash long, n long, band int, node long, bits binary"))
    node = member.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("band").alias("band"), F.min_by("text_hash", "key").alias("text_hash"), F.min("key").alias("key"))
    node = stash(node)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sig = rows.select("text").mapInArrow(signatures, "tile long, node long")
    named = stash(sig.repartition(parts, "tile").sortWithinPartitions("tile", "node").mapInArrow(_named(tile_rows), "tile long, node long, lead long, big boolean"))
    place = stash(node.select("node", "band", "key", "text_hash").join(named.select("node").distinct(), "node"))
    # The text of each node that has a candidate, once. By shuffling both sides: a broadcast would only suit small inputs.
    # Rows of other texts under one key and hash are told apart where the texts are read.
    text = place.select("node", "key", "text_hash").hint("shuffle_merge").join(rows.select("key", "text_hash", "text"), ["key", "text_hash"])
    text = stash(text.select("node", "text"))

    def links(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are linked, each leader's text being read against many."""
        counts = pairs.groupBy("a").agg(F.count("*").alias("count"))
        dealt = join_by_key(pairs, counts, "a", "count").withColumn("tile", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / block).cast("long"))))
        asked = dealt.select("tile", F.lit(0).alias("side"), F.col("a").alias("node")).distinct().union(dealt.select("tile", F.lit(1), "b"))
        asked = asked.join(text, "node").select("tile", "side", "node", "text")
        return stash(asked.repartition(parts, "tile").sortWithinPartitions("tile", "side", "node").mapInArrow(_starred(num, den, k), "a long, b long"))

    # First each node with that least node of a tile that it shares the most tiles with. Tiles whose nodes this joins are done.
    star = named.where("node <> lead").groupBy("lead", "node").agg(F.count("*").alias("tiles"))
    found = links(star.groupBy(F.col("node").alias("b")).agg(F.max_by("lead", F.struct("tiles", "lead")).alias("a")).select("a", "b"))
    group = stash(components(found))
    label = node.select("node", "n", "bits").join(group, "node", "left").select("node", "n", "bits", F.coalesce("component", "node").alias("known"))
    rest = stash(named.select("tile", "node", "big").distinct().join(label.select("node", "known"), "node"))
    unstash(named)
    mixed = rest.groupBy("tile").agg(F.count("*").alias("count"), (F.min("known") < F.max("known")).alias("mixed")).where("mixed").drop("mixed")
    open_ = join_by_key(rest, mixed, "tile", "count")
    big = block_pairs(open_.where("big"), "tile", "count", tile_rows).select("tile", "node", "side")
    tiles = open_.where("not big").select("tile", "node", F.lit(3).alias("side")).unionByName(big).join(label, "node")
    near = tiles.repartition(parts, "tile").sortWithinPartitions("tile", "n", "node").mapInArrow(_tile_links(num, den), "a long, b long")
    near = stash(near.distinct())
    # Families: what the links and the candidates left connect. One candidate between any two groups is checked.
    family = stash(components(found.union(near)).withColumnRenamed("component", "family").join(place.select("node", "band"), "node"))
    label = family.join(group, "node", "left").select("node", F.coalesce("component", "node").alias("known"))
    across = near.join(label.toDF("a", "ka"), "a").join(label.toDF("b", "kb"), "b").where("ka <> kb")
    found = found.union(links(across.groupBy(F.least("ka", "kb"), F.greatest("ka", "kb")).agg(F.min_by("a", F.struct("a", "b")).alias("a"), F.min_by("b", F.struct("a", "b")).alias("b")).select("a", "b")))
    group = stash(components(found))
    # Families that are still several groups: every pair of different groups that the bitmaps leave, in tiles of size
    # bands. All nodes meet those outside the family's largest group, so a large group costs its size times the strays.
    label = family.join(group, "node", "left").select("family", "node", "band", F.coalesce("component", "node").alias("known"))
    kinds = label.groupBy("family", "known").agg(F.count("*").alias("size"))
    several = kinds.groupBy("family").agg(F.count("*").alias("groups"), F.max_by("known", F.struct("size", "known")).alias("main")).where("groups > 1")
    loose = stash(label.join(several.select("family", "main"), "family").withColumn("stray", F.col("known") != F.col("main")))
    # Class b compares sets of band b with each other and with those of band b + 1, which visit it.
    visits = loose.select("node", "known", "stray", "family", F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    classes = visits.groupBy("family", "band").agg(F.sum((~F.col("stray")).cast("long")).alias("mains"), F.sum(F.col("stray").cast("long")).alias("strays")).where("strays > 0 and strays + mains > 1")
    visits = visits.join(classes, ["family", "band"]).withColumn("tile", F.xxhash64("family", "band"))
    pairs = _stray_pairs(visits, block).select("tile", "node", "known", "side").join(text, "node")
    pairs = pairs.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(_verified(num, den, k), "a long, b long")
    group = stash(components(found.union(pairs)))
    unstash(text, family, loose, near, place, rest)
    return Joined(member.select("id", "text_hash", "n", "node"), group)


def _stray_pairs(rows: DataFrame, most: int) -> DataFrame:
    """Rows for the pairs of blocks of a tile of which one at least holds strays: columns mains and strays count both.
    Adds side: 1 and 2 for the pair's blocks, 3 where both are one."""
    main, extra = (F.greatest(F.ceil(F.col(c) / most), F.lit(0)).cast("long") for c in ("mains", "strays"))
    rows = rows.withColumn("main_", main).withColumn("extra_", extra)
    spread = F.xxhash64("node", F.lit(7))
    rows = rows.withColumn("block_", F.when(F.col("stray"), F.col("main_") + F.pmod(spread, F.col("extra_"))).otherwise(F.pmod(spread, F.col("main_"))))
    first = F.when(F.col("stray"), F.lit(0).cast("long")).otherwise(F.col("main_"))
    rows = rows.withColumn("other_", F.explode(F.sequence(first, F.col("main_") + F.col("extra_") - 1)))
    side = F.when(F.col("block_") == F.col("other_"), 3).when(F.col("block_") < F.col("other_"), 1).otherwise(2)
    return rows.withColumn("side", side).withColumn("tile", F.xxhash64("tile", F.least("block_", "other_"), F.greatest("block_", "other_")))


def _with_groups(found: Joined) -> DataFrame:
    """member with its group: the component's least node, or the own node; null without a shingle."""
    counts = found.member.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"))
    table = counts.join(found.group, "node", "left").select("node", F.coalesce("component", "node").alias("group"), "copies")
    out = join_by_key(found.member.where("node is not null"), table, "node", "copies").drop("copies")
    return out.unionByName(found.member.where("node is null").withColumn("group", F.lit(None).cast("long")))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5, tile_rows: int = 4096, block: int = 256) -> DataFrame:
    """One row per document: (id_col, n_shingles, component_id) of the graph whose links are Jaccard >= num/den on sets
    of k-word shingles of the text with A-Z lower-cased; words are `[^\\x20\\x09-\\x0D]+`.

    1. Equal sets become one node. Every node emits the keys of its band's segments (see _segment_keys): two linked
       sets share one at least, so nothing is lost, and sets that merely share a frequent passage seldom do.
    2. Nodes under one key form a tile, and tiles of the same nodes are one; bitmaps bound each pair's overlap from
       above. First each node meets the tile mate that it shares most tiles with, by exact intersection of sorted
       arrays; tiles whose nodes that joins are done. Of the others, those of over tile_rows rows in pairs of blocks, a
       spanning forest of the pairs that the bit counts leave between groups is kept.
    3. The components of links and that forest hold every linked pair. The forest's pairs are checked; where a component
       is still several groups, tiles of its size bands (at most 2 * block texts) are checked by bitmap and exact
       intersection, skipping pairs already joined.
    4. The components of the verified links are the groups; component_id is the smallest id in one.

    A document with fewer than k words has its whole sequence as its one shingle; null, empty or blank text has no
    shingle and is linked with nothing: its component_id is its own id. Null ids take part, but are no component_id
    unless all are null. Repeated rows are one node and each get a row. Other columns are ignored.
    """
    rows = _with_groups(_join(docs, id_col, text_col, k, num, den, tile_rows, block))
    least = rows.where("node is not null").groupBy("group").agg(F.min("id").alias("component_id"), F.count("*").alias("size"))
    out = join_by_key(rows.where("node is not null"), least, "group", "size").select("id", "n", "component_id")
    out = out.unionByName(rows.where("node is null").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5, tile_rows: int = 4096, block: int = 256) -> DataFrame:
    """The documents, of each group one: the row with the smallest id, of ids that repeat the one whose text has the
    smallest hash, of equal rows any. Null ids come last. Documents that link with nothing, such as empty ones, all
    stay. A row is told by its id and its text, so rows of other texts under one id are none of its business."""
    rows = _with_groups(_join(docs, id_col, text_col, k, num, den, tile_rows, block)).where("node is not null")
    rows = rows.groupBy("group", "id", "text_hash").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("id").isNull(), "id", "text_hash")
    first = rows.groupBy("group").agg(F.min(order).alias("first"), F.count("*").alias("size"))
    rows = stash(join_by_key(rows, first, "group", "size").withColumn("stays", order == F.col("first")))
    id_, hash_ = fresh(docs, "gone_id", "gone_hash")
    named = lambda df: df.select(F.col("id").alias(id_), F.col("text_hash").alias(hash_))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(hash_))
    left = docs.join(named(rows.where("not stays")), same, "left_anti")
    twice = named(rows.where("stays and copies > 1"))
    if twice.isEmpty():
        return left
    once = left.join(twice, same, "left_semi").withColumn(hash_, F.xxhash64(F.col(text_col).cast("string"))).dropDuplicates([id_col, hash_]).drop(hash_)
    return left.join(twice, same, "left_anti").unionByName(once)
