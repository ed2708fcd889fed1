"""Which records a reader may see."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def in_scope(workstream: str) -> Column:
    return (F.col("workstream_id") == workstream) | F.col("workstream_id").isNull()


def untainted(records: DataFrame, taints: DataFrame) -> DataFrame:
    return records.where(F.col("lifecycle") == "active").join(taints.select(F.col("record_id").alias("id")), "id", "left_anti")


def visible(records: DataFrame, taints: DataFrame, workstream: str) -> DataFrame:
    return untainted(records.where(in_scope(workstream)), taints)


def recallable(records: DataFrame, taints: DataFrame, workstream: str, kinds: Iterable[str] | None = None) -> DataFrame:
    rows = visible(records.where(F.col("kind") != "checkpoint"), taints, workstream)
    return rows.where(F.col("kind").isin(*kinds)) if kinds else rows


def fillable(records: DataFrame, taints: DataFrame) -> DataFrame:
    """What may be embedded: any scope, no checkpoint."""
    return untainted(records.where(F.col("kind") != "checkpoint"), taints)


def reasons(records: DataFrame, taints: DataFrame) -> DataFrame:
    """(id, eligible, reason): the record's own state before a taint; of taints the first by kind, then cause."""
    first = taints.groupBy(F.col("record_id").alias("id")).agg(F.min(F.struct("taint", "cause_id")).alias("t"))
    reason = F.when(F.col("lifecycle") != "active", F.col("lifecycle")).otherwise(F.col("t.taint"))
    return records.join(first, "id", "left").select("id", reason.isNull().alias("eligible"), reason.alias("reason"), F.when(F.col("lifecycle") == "active", F.col("t.cause_id")).alias("cause_id"))


def guarded(records: DataFrame, asked: DataFrame, workstream: str) -> DataFrame:
    """(id, status) of asked ids: not_found, scope_denied or found."""
    status = F.when(F.col("kind").isNull(), "not_found").when(in_scope(workstream), "found").otherwise("scope_denied")
    return asked.join(records.select("id", "kind", "workstream_id"), "id", "left").select("id", status.alias("status"))


def in_window(start: Column | None, end: Column | None, at: str = "created_at") -> Column:
    """start <= at < end as instants; either end may be open."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (F.col(at) >= start)
    return ok & (F.col(at) < end) if end is not None else ok
