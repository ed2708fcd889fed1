"""Helpers shared by the training-data operators: table access, cutting lineage, hashing of words, connected components."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

U64 = np.uint64
#: Folds A-Z only, as the operators' contracts ask.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Only a local master, as in tests,
    gets a temporary folder where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='memoria-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in Arrow batches of 1,000 rows at most: both sides hold a batch whole, and texts may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def stash(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives a lost executor and fixes
    values that a second computation could number differently."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def unstash(*tables: DataFrame) -> None:
    """Delete stashed tables whose last reader is done."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/stash-" not in path:
                raise ValueError(f"{path} is no stash")
            hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def in_turns(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition again, in batches whose texts in that column have about `most` bytes in all; a longer
    text comes alone. So what a task holds follows the bytes, not the number of rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        # 16 bytes for the row itself, so that rows without text are counted as well.
        n = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        at = 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(np.cumsum(n[at:]), most - size, "right"))
            if fit:
                held.append(batch.slice(at, fit))
                size += int(n[at : at + fit].sum())
                at += fit
            elif held:
                yield pa.concat_batches(held)
                held, size = [], 0
            else:
                yield batch.slice(at, 1)
                at += 1
    if held:
        yield pa.concat_batches(held)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have yet, so that extra columns never clash with working ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """What mix made x of."""
    x = x ^ (x >> U64(31)) ^ (x >> U64(62))
    x = x * U64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> U64(27)) ^ (x >> U64(54))
    x = x * U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U64(30)) ^ (x >> U64(60))


_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, 2 * len(_powers), 1 << 16)
        fill = lambda base: np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size - 1, base, U64)]))
        _powers, _inverses = fill(U64(_BASE)), fill(U64(_INVERSE))


_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True


def word_spans(data: bytes, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and the start and end of every word; by default words are `[^\\x20\\x09-\\x0D]+`."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~gap[raw]
    turn = np.diff(inside)
    return raw, np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def numbered() -> defaultdict[bytes, int]:
    """Numbers words in the order in which they are first asked for."""
    return defaultdict(itertools.count().__next__)


def word_hashes(data: bytes) -> np.ndarray:
    return word_hashes_by(data, _GAP)


def word_hashes_by(data: bytes, gap: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: differences of a running polynomial over the bytes, scaled to the word's start."""
    raw, start, end = word_spans(data, gap)
    if not len(start):
        return np.zeros(0, U64)
    _grow(len(raw))
    run = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * _powers[: len(raw)], out=run[1:])
    return mix((run[end] - run[start]) * _inverses[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in order; with fewer words, of the whole sequence; without words, none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, U64)
    for i in range(k):
        out = mix(out * U64(0x9FB21C651E98DF25) + words[i : n - k + 1 + i] + U64(i + 1))
    return out


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(lowered(text)), k))


class Forest:
    """Union-find within one task; the smaller label is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup batches of a partition sorted by key into tables that never cut a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(key)
        last = col[batch.num_rows - 1]
        if held and held[-1].column(key)[-1].as_py() == last.as_py() and col[0].as_py() == last.as_py():
            held.append(batch)
            continue
        values = col.to_pylist()
        cut = batch.num_rows - 1
        while cut > 0 and values[cut - 1] == values[-1]:
            cut -= 1
        if held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(rows: DataFrame, tile: str, count: str, most: int) -> DataFrame:
    """Rows for every pair of blocks of a tile: a tile of over `most` rows is dealt by hash into blocks, and each row
    goes to the pairs that its block is in. Adds side: 1 and 2 for the pair's blocks, 3 where both are one."""
    blocks = F.ceil(F.col(count) / most).cast("long")
    dealt = rows.withColumn("blocks_", blocks).withColumn("block_", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks_")))
    dealt = dealt.withColumn("other_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_") - 1)))
    pair = F.xxhash64(tile, F.least("block_", "other_"), F.greatest("block_", "other_"))
    side = F.when(F.col("block_") == F.col("other_"), 3).when(F.col("block_") < F.col("other_"), 1).otherwise(2)
    return dealt.withColumn("side", side).withColumn(tile, F.when(F.col("blocks_") == 1, F.col(tile)).otherwise(pair)).drop("blocks_", "block_", "other_")


def _local_forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    seen: set[int] = set()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
            seen.add(a)
            seen.add(b)
    pairs = [(x, r) for x in seen if (r := forest.find(x)) != x]
    for i in range(0, len(pairs), 50_000):
        part = pairs[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["a", "b"])


def join_by_key(rows: DataFrame, table: DataFrame, key: str, size: str, often: int = 1000) -> DataFrame:
    """rows joined with a table that has one row for each key and, in column size, how many rows have it.

    The rows of the at most 1,000 most frequent keys with over `often` rows each stay where they are and meet a
    broadcast of those keys; the others are shuffled by key, so no task gets a frequent key's rows."""
    hot = F.broadcast(table.where(F.col(size) > often).orderBy(F.desc(size)).limit(1000))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(table, key))


def components(edges: DataFrame, rounds: int = 40, one_task: int = 1 << 18) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component the smallest node.

    Every partition first reduces its edges to a forest; then large-star and small-star steps alternate until nothing
    changes. Each step takes a minimum by node, combined before the shuffle, and joins it back by join_by_key, so a
    hub's edges never meet in one task. As soon as at most `one_task` edges are left, one task joins them. Nodes without
    edges are not returned; nulls and loops are ignored.
    """
    edges = edges.select(F.col(edges.columns[0]).alias("a"), F.col(edges.columns[1]).alias("b")).where("a is not null and b is not null and a <> b")
    e = stash(edges.mapInArrow(_local_forest, "a long, b long"))
    for _ in range(rounds):
        if e.count() <= one_task:
            before, e = e, stash(e.coalesce(1).mapInArrow(_local_forest, "a long, b long"))
            unstash(before)
            break
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        up = both.where("b > a")
        large = join_by_key(up, least, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_by_key(large, low, "a", "n")
        small = small.select("a", F.col("m").alias("b")).union(small.select("b", "m")).where("a <> b").distinct()
        before, e = e, stash(small)
        unstash(before)
        # A forest of stars: every child has one parent, and no parent is a child.
        one = e.groupBy("a").agg(F.count("*").alias("n")).select(F.col("a"), F.when(F.col("n") > 1, 1).otherwise(0).alias("many"), F.lit(0).alias("up"))
        top = e.select(F.col("b").alias("a")).distinct().select("a", F.lit(0).alias("many"), F.lit(1).alias("up"))
        state = one.union(top).groupBy("a").agg(F.max("many").alias("many"), F.count("*").alias("c"))
        if not state.where("many = 1 or c > 1").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())
