"""Embedding near-dedup by NN-descent."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import block_pairs, components, stash, whole_groups

_EDGE = "u long, v long, cos double, link boolean"


def _node(group: int, raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=group.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, node, group, vec) of every row; node, group and vec are null where the vector links with nothing. vec is
    the vector's bytes, of 32-bit floats where those hold it exactly and of 64-bit floats otherwise."""
    for b in batches:
        nodes, groups, vecs = [], [], []
        for label, values in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            x = None if label is None or not values or None in values else np.array(values, np.float64)
            if x is None or not np.isfinite(x).all() or not x.any():
                nodes.append(None), groups.append(None), vecs.append(None)
                continue
            with np.errstate(over="ignore"):
                short = x.astype(np.float32)
            raw = short.tobytes() if (short == x).all() else x.tobytes()
            group = int.from_bytes(hashlib.blake2b(f"{len(x)}:{label}".encode(), digest_size=8).digest(), "little", signed=True)
            nodes.append(_node(group, x.tobytes())), groups.append(group), vecs.append(len(x).to_bytes(4, "little") + raw)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(groups, pa.int64()), pa.array(vecs, pa.binary())], names=["id", "node", "group", "vec"])


def _matrix(vecs: list[bytes]) -> np.ndarray:
    """Unit rows in double precision; all of one dimension."""
    x = np.stack([np.frombuffer(v, np.float32 if len(v) == 4 + 4 * int.from_bytes(v[:4], "little") else np.float64, offset=4).astype(np.float64) for v in vecs])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cuts(t: pa.Table, key: str) -> Iterator[pa.Table]:
    values = t.column(key).to_numpy()
    at = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    for lo, hi in zip(at, at[1:], strict=False):
        if hi - lo > 1:
            yield t.slice(lo, hi - lo)


def _edges(u: list[np.ndarray], v: list[np.ndarray], c: list[np.ndarray], link: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v, c, link)], names=["u", "v", "cos", "link"])


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric matrix of links: the places that its edges join."""
    left = near.any(1)
    i, j = [], []
    while left.any():
        todo = [int(left.argmax())]
        left[todo] = False
        while todo:
            x = todo.pop()
            new = np.flatnonzero(near[x] & left).tolist()
            left[new] = False
            i += [x] * len(new)
            j += new
            todo += new
    return np.array(i, np.int64), np.array(j, np.int64)


def _cells(tables: int, seed: int):
    """Deal every node to one cell in each table, by the signs of its products with random directions; bits says how many."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            tiles, rows = [], []
            for i, (vec, group, bits) in enumerate(zip(b.column("vec").to_pylist(), b.column("group").to_pylist(), b.column("bits").to_pylist(), strict=True)):
                x = _matrix([vec])[0]
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([seed, len(x)]).normal(size=(tables * 32, len(x)))
                signs = (planes[len(x)] @ x > 0).reshape(tables, 32)[:, :bits]
                for t in range(tables):
                    name = group.to_bytes(8, "little", signed=True) + bytes([t]) + np.packbits(signs[t]).tobytes()
                    tiles.append(int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little", signed=True))
                    rows.append(i)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int64()), b.column("node").take(take), b.column("vec").take(take)], names=["tile", "node", "vec"])

    return run


def _nearest(k: int, threshold: float):
    """Each node's k nearest in its cell, and a forest of all the cell's links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "tile"):
            u, v, c, link = [], [], [], []
            for t in _cuts(table, "tile"):
                node, x = t.column("node").to_numpy(), _matrix(t.column("vec").to_pylist())
                s = x @ x.T
                np.fill_diagonal(s, -2)
                top = np.argpartition(-s, min(k, len(s) - 1) - 1, axis=1)[:, : min(k, len(s) - 1)]
                u.append(np.repeat(node, top.shape[1])), v.append(node[top].ravel()), c.append(np.take_along_axis(s, top, 1).ravel()), link.append(np.zeros(top.size, bool))
                i, j = _forest(s >= threshold)
                u.append(node[i]), v.append(node[j]), c.append(s[i, j]), link.append(np.ones(len(i), bool))
            if u:
                yield _edges(u, v, c, link)

    return run


def _joined(threshold: float):
    """Local joins: the neighbours of each centre are compared with each other; pairs that would enter one of their
    lists are kept, and a forest of all the links, which no list has to have room for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "center"):
            u, v, c, link = [], [], [], []
            for t in _cuts(table, "center"):
                node, worst, x = t.column("node").to_numpy(), t.column("worst").to_numpy(), _matrix(t.column("vec").to_pylist())
                s = x @ x.T
                np.fill_diagonal(s, -2)
                i, j = np.nonzero((s > worst[:, None]) & (node[:, None] != node[None, :]))
                u.append(node[i]), v.append(node[j]), c.append(s[i, j]), link.append(np.zeros(len(i), bool))
                i, j = _forest(s >= threshold)
                u.append(node[i]), v.append(node[j]), c.append(s[i, j]), link.append(np.ones(len(i), bool))
            if u:
                yield _edges(u, v, c, link)

    return run


def _lists(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """Each node's best k, or the best 2k where all of the k are links: a saturated list is enlarged."""
    best = edges.groupBy("u", "v").agg(F.max("cos").alias("cos"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("cos"), "v"))).where(F.col("place") <= 2 * k)
    kth = F.min(F.when(F.col("place") == k, F.col("cos"))).over(Window.partitionBy("u"))
    return best.withColumn("kth", kth).where((F.col("place") <= k) | (F.col("kth") >= threshold)).select("u", "v", "cos")


def _descend(graph: DataFrame, nodes: DataFrame, k: int, threshold: float, parts: int) -> DataFrame:
    """One round: neighbours of neighbours, over forward lists and as many reverse entries, meet at each centre."""
    reverse = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "cos")
    reverse = reverse.withColumn("place", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("cos"), "v"))).where(F.col("place") <= k).drop("place")
    worst = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("cos")).otherwise(F.lit(-2.0)).alias("worst"))
    meet = graph.select("u", "v").union(reverse.select("u", "v")).distinct().select(F.col("u").alias("center"), F.col("v").alias("node"))
    known = nodes.select("node", "vec").join(worst, F.col("node") == F.col("u"), "left").select("node", "vec", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    meet = meet.join(known, "node").select("center", "node", "worst", "vec")
    return meet.repartition(parts, "center").sortWithinPartitions("center", "node").mapInArrow(_joined(threshold), _EDGE)


def _counted(threshold: float):
    """Links of every node within a tile: the copies counted of the other nodes whose cosine reaches the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "tile"):
            nodes, links = [], []
            for t in _cuts(table, "tile"):
                x, copies, side = _matrix(t.column("vec").to_pylist()), t.column("copies").to_numpy(), t.column("side").to_numpy()
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                if (side != 3).any():
                    near &= side[:, None] != side[None, :]
                nodes.append(t.column("node").to_numpy()), links.append(near @ copies)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(links))], names=["node", "links"])

    return run


def _audit(nodes: DataFrame, groups: DataFrame, threshold: float, sample: int) -> float:
    """Of the links that brute force finds between at most about `sample` nodes and all nodes, the share whose ends
    the graph has in one component. The sample is drawn by the nodes' hash and is all that reaches the driver."""
    n = max(nodes.count(), 1)
    asked = nodes.where(F.pmod("node", F.lit(1 << 30)) < (sample << 30) // n).select("node", "group", "vec").limit(2 * sample).collect()
    if not asked:
        return 1.0
    by: dict[int, list] = {}
    for r in asked:
        by.setdefault(r.group, []).append((r.node, bytes(r.vec)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {g: (np.array([x[0] for x in q]), _matrix([x[1] for x in q])) for g, q in by.items()}
        for b in batches:
            group, node = np.array(b.column("group").to_pylist()), np.array(b.column("node").to_pylist())
            for g in set(group.tolist()) & held.keys():
                own = np.flatnonzero(group == g)
                names, q = held[g]
                i, j = np.nonzero(q @ _matrix(b.column("vec").take(pa.array(own)).to_pylist()).T >= threshold)
                pairs = names[i] != node[own][j]
                yield pa.RecordBatch.from_arrays([pa.array(names[i][pairs]), pa.array(node[own][j][pairs])], names=["u", "v"])

    true = nodes.select("node", "group", "vec").mapInArrow(run, "u long, v long")
    label = groups.select(F.col("node"), F.col("component"))
    true = true.join(label.toDF("u", "cu"), "u", "left").join(label.toDF("v", "cv"), "v", "left")
    total, found = true.agg(F.count("*"), F.coalesce(F.sum((F.col("cu") == F.col("cv")).cast("long")), F.lit(0))).first()
    return found / total if total else 1.0


def similar_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98,
    k: int = 8, tables: int = 6, cell: int = 256, rounds: int = 2, recall: float = 0.995, sample: int = 512, attempts: int = 3, block: int = 1024,
) -> DataFrame:
    """One row per vector: (id_col, n_links, component_id, kept). Vectors link when their labels are equal and their
    cosine, in double precision, is threshold or more.

    Equal vectors of a label become one node with a count of copies. Lists of each node's k nearest start from random
    cells; in each round the neighbours of every node are compared with each other (reverse neighbours too) and lists
    take what is nearer, a list full of links being doubled. Every link that a cell or a local join computes takes part
    in the components, whether a list has room for it or not: each keeps a spanning forest of its links. An audit
    compares a bounded sample of nodes with all others by brute force; below the wanted recall, other cells and further
    rounds with lists of twice the length are added, and after 3 * `attempts` times it is an error. The links of each node within its component are then counted exactly, block against
    block, so a list's length bounds no count.

    A vector that is null, empty, zero, or holds a null or non-finite component, and one with a null label, links with
    nothing: n_links 0, component_id its own id. Vectors of different lengths never link. Null ids take part but name
    no component unless all are null; kept is then false. Repeated rows are copies. Other columns are ignored.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = stash(rows.mapInArrow(_read, "id long, node long, `group` long, vec binary"))
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("group").alias("group"), F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("id").alias("least"))
    nodes = stash(nodes)
    sizes = nodes.groupBy("group").agg(F.greatest(F.ceil(F.log2(F.count("*") / F.lit(cell))), F.lit(0)).cast("int").alias("bits"))
    dealt = nodes.join(sizes, "group").select("node", "group", "vec", F.least("bits", F.lit(32)).alias("bits"))

    graph = links = None
    for attempt in range(3 * attempts):
        wide = k << attempt
        cells = dealt.mapInArrow(_cells(tables, attempt), "tile long, node long, vec binary")
        # A cell of more than block nodes is dealt into several: this is only where lists start.
        count = cells.groupBy("tile").agg(F.count("*").alias("count"))
        cells = cells.join(count, "tile").withColumn("tile", F.xxhash64("tile", F.lit(attempt), F.pmod(F.xxhash64("node", F.lit(attempt)), F.ceil(F.col("count") / block).cast("long"))))
        made = stash(cells.select("tile", "node", "vec").repartition(parts, "tile").sortWithinPartitions("tile", "node").mapInArrow(_nearest(wide, threshold), _EDGE))
        for step in range(rounds + 1):
            if step:
                made = stash(_descend(graph, nodes, wide, threshold, parts))
            near, linked = made.where("not link").drop("link"), made.where("link").select("u", "v")
            graph = stash(_lists(near if graph is None else graph.union(near), wide, threshold))
            links = linked if links is None else links.union(linked)
        groups = stash(components(links.union(graph.where(F.col("cos") >= threshold).select("u", "v"))))
        found = _audit(nodes, groups, threshold, sample)
        if found >= recall:
            break
    else:
        raise RuntimeError(f"recall {found:.4f} of the audit is below {recall} after {3 * attempts} attempts")

    counts = groups.groupBy("component").agg(F.count("*").alias("count"))
    members = groups.join(counts, "component").select(F.col("component").alias("tile"), "node", "count")
    tiles = block_pairs(members, "tile", "count", block).join(nodes.select("node", "vec", "copies"), "node").select("tile", "node", "side", "vec", "copies")
    links = tiles.repartition(parts, "tile").sortWithinPartitions("tile", "node").mapInArrow(_counted(threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))

    known = nodes.select("node", "copies", "least").join(groups, "node", "left").join(links, "node", "left")
    known = known.select("node", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select(F.col("node").alias("known"), "n_links", "component_id")
    out = rows.select("id", "node").join(known, F.col("node") == F.col("known"), "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
