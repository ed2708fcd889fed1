"""Exact dedup by content sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import fresh, stash

#: What a row's run in its sorted partition says of it: the identifier that stays, the run's rows, the text's SHA-256,
#: whether the row is the run's first, and for the first and the last run of a partition their place among those.
_FOUND = "keep long, size long, sha string, first boolean, edge long"


@dataclass
class _Run:
    body: bytes
    sha: str
    keep: int | None
    size: int = 0


def _runs(extra: int, firsts: bool):
    """Compare every text in full with the one before it, in a partition sorted by text, then the identifier to keep
    first. Rows wait for their run's end as their `extra` leading columns only; with firsts, all but the first row of
    each run go at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[pa.RecordBatch, np.ndarray]] = []  # rows without text, and the number of each one's run
        runs: list[_Run] = []
        names: list[str] = []

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            """The held rows whose runs have ended; all of them at the end of the partition."""
            done = total if last else total - 1
            while held and int(held[0][1][-1]) < done:
                batch, number = held.pop(0)
                own = [runs[k - gone] for k in number.tolist()]
                edge = [part * 2 if k == 0 else part * 2 + 1 if last and k == total - 1 else None for k in number.tolist()]
                first = number != np.append(before[0], number[:-1])
                before[0] = number[-1]
                columns = [pa.array([r.keep for r in own], pa.int64()), pa.array([r.size for r in own], pa.int64()), pa.array([r.sha for r in own], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(first), pa.array(edge, pa.int64())], names=[*names, "keep", "size", "sha", "first", "edge"])

        total, gone, before, seen = 0, 0, [-1], -1
        for b in batches:
            names = b.schema.names[:extra]
            number = np.empty(b.num_rows, np.int64)
            for i, (key, body) in enumerate(zip(b.column(0).to_pylist(), b.column(extra).to_pylist(), strict=True)):
                if not runs or body != runs[-1].body:
                    if runs:
                        runs[-1].body = b""
                    runs.append(_Run(body, hashlib.sha256(body).hexdigest(), key))
                    total += 1
                runs[-1].size += 1
                number[i] = total - 1
            lead = b.select(names)
            if firsts and b.num_rows:
                new = number != np.append(seen, number[:-1])
                seen = number[-1]
                lead, number = lead.filter(pa.array(new)), number[new]
            if lead.num_rows:
                held.append((lead, number))
            yield from emit(False)
            oldest = min(int(held[0][1][0]) if held else total, total - 1)
            runs, gone = runs[oldest - gone :], oldest
        yield from emit(True)

    return run


def content_sorted(docs: DataFrame, id_col: str, text_col: str, keep: str, normalise=None, carry: bool = False) -> DataFrame:
    """Rows id, keep, size, sha and stays: of every run of equal texts the identifier to keep, its rows, its SHA-256, and
    whether this is the row that stays. With carry only first rows of runs in a partition, with the documents' own
    columns as a struct named doc; size is then no use."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    body = (normalise(text) if normalise else text).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *([F.struct(*docs.columns).alias("doc")] if carry else []), body.alias("body"))
    # Splitters are sampled from a short head of the bytes, a hash of all of them and the identifier, so what the sample
    # sends to the driver does not grow with the texts, and splitters fall inside a large group of copies as well: such
    # a group spreads over as many partitions as its share of the rows is worth.
    rows = rows.withColumn("head", F.substring("body", 1, 32)).withColumn("hash", F.xxhash64("body"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = F.desc_nulls_last("id") if keep == "max" else F.asc_nulls_last("id")
    dealt = rows.repartitionByRange(n, "head", "hash", best).sortWithinPartitions("head", "hash", "body", best)
    lead = ["id", *(["doc"] if carry else [])]
    shape = dealt.select(*lead).schema
    for f in _found_schema():
        shape = shape.add(f)
    found = stash(dealt.select(*lead, "body").mapInArrow(_runs(len(lead), carry), shape))
    # Only a partition's first and last run can go on in the next one: two of them at most for each partition, joined
    # by their digest. All other rows have their answer.
    edges = found.where("edge is not null").groupBy("edge", "sha").agg(F.max("size").alias("size"), F.max("keep").alias("high"), F.min("keep").alias("low"))
    whole = edges.groupBy(F.col("sha").alias("edge_sha")).agg(F.sum("size").alias("all"), F.max("high").alias("high"), F.min("low").alias("low"), F.min("edge").alias("lead"))
    inner = found.where("edge is null").select(*lead, "keep", "size", "sha", F.col("first").alias("stays"))
    outer = found.where("edge is not null").join(F.broadcast(whole), F.col("sha") == F.col("edge_sha"))
    outer = outer.select(*lead, F.col("high" if keep == "max" else "low").alias("keep"), F.col("all").alias("size"), "sha", (F.col("first") & (F.col("edge") == F.col("lead"))).alias("stays"))
    return inner.unionByName(outer)


def _found_schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(_FOUND)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise=None) -> DataFrame:
    """One row per document: (id_col, keep_id, group_size, kept, text_sha256).

    Texts are equal when their normalised bytes are identical; normalise is a Column function, by default none. Sampled
    splitters range-partition the bytes (then the id), each partition is sorted once, and each text is compared in full
    with its neighbour: runs of equal texts are the groups, their first row has the id that stays. A run that ends a
    partition may continue in the next ones; those few runs, two a partition at most, are joined by SHA-256.
    keep: "max" or "min" id stays.

    Null text counts as empty, and empty texts form a group. A row with a null id is in its group's size and is never
    kept, unless all ids of the group are null, when keep_id is null and kept is false. Repeated rows count as often as
    they occur; all rows with the kept id in a group are kept. An empty table gives an empty result; other columns are
    ignored.
    """
    rows = content_sorted(docs, id_col, text_col, keep, normalise)
    kept = F.coalesce(F.col("id") == F.col("keep"), F.lit(False)).alias("kept")
    return rows.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), kept, F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The documents without the copies: of each group of equal texts one row stays, the first of its run; see
    exact_groups. Of rows with the same id and text any one stays; a group whose ids are all null keeps one row."""
    rows = content_sorted(docs, id_col, text_col, keep, carry=True)
    return rows.where("stays").select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
