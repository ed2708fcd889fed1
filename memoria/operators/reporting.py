"""The engine's report on its own use: a call log joined in time with what the sessions did next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def usage(calls: DataFrame) -> DataFrame:
    """(session_id, calls, searches, empty, ms) of every session."""
    return calls.groupBy("session_id").agg(F.count("*").alias("calls"), F.count_if(F.col("name") == "view").alias("searches"), F.count_if(F.col("name") == "error").alias("empty"), F.round(F.sum("ms"), 4).alias("ms"))


def latency(calls: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of each call's time. Equal times are counted before they are shuffled, and a running sum
    of the counts, spread by rounded time and put together from the spreads' totals, finds the ranks: no task holds a
    name's times."""
    counts = calls.where("ms is not null").groupBy("name", "ms").agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.log2(F.abs("ms") + 1) * 64 * F.signum("ms")).cast("long"))
    bins = counts.groupBy("name", "bin").agg(F.sum("n").alias("in_bin"))
    # At most some 64 bins for each doubling of the time: what a name has of them is bounded.
    below = F.sum("in_bin").over(Window.partitionBy("name").orderBy("bin")) - F.col("in_bin")
    bins = bins.withColumn("below", below).withColumn("total", F.sum("in_bin").over(Window.partitionBy("name")))
    run = F.col("below") + F.sum("n").over(Window.partitionBy("name", "bin").orderBy("ms"))
    rows = counts.join(bins, ["name", "bin"]).withColumn("run", run)
    at = lambda p: F.min(F.when(F.col("run") >= F.ceil(F.col("total") * p), F.col("ms")))
    found = rows.groupBy("name").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    return calls.groupBy("name").agg(F.count("*").alias("n")).join(found, "name", "left").select("name", "n", "p50", "p95")


def first_returns(returns: DataFrame) -> DataFrame:
    """The first time that each session was given each record."""
    w = Window.partitionBy("session_id", "ref").orderBy("at", "id")
    return returns.withColumn("n", F.row_number().over(w)).where("n = 1").select("session_id", "ref", "at", "id")


def used_later(first: DataFrame, acts: DataFrame) -> DataFrame:
    """(session_id, ref, read, edited, cited, used): whether a session acted on a record strictly after it was given it.
    The first act of each kind decides nothing and the last does, so acts shrink to one row a session and record before
    the join."""
    kinds = {"read": "view", "edited": "click", "cited": "purchase"}
    last = acts.groupBy("session_id", "ref").agg(*(F.max(F.when(F.col("name") == name, F.col("at"))).alias(f"last_{k}") for k, name in kinds.items()))
    rows = first.join(last, ["session_id", "ref"], "left")
    rows = rows.select("session_id", "ref", *(F.coalesce(F.col(f"last_{k}") > F.col("at"), F.lit(False)).alias(k) for k in kinds))
    return rows.withColumn("used", F.col("read") | F.col("edited") | F.col("cited"))


def edit_after(first: DataFrame, acts: DataFrame) -> DataFrame:
    """(session_id, ref, edit_at, reread): the first edit after a record was given, and whether it was read in between.
    As-of joins by sorting: one window over the union of both sides, no pair of rows is made."""
    rows = first.select("session_id", "ref", "at", "id", F.lit("given").alias("name")).unionByName(acts.select("session_id", "ref", "at", "id", "name"))
    later = Window.partitionBy("session_id", "ref").orderBy("us").rangeBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("us", F.unix_micros("at"))
    rows = rows.withColumn("edit_at", F.min(F.when(F.col("name") == "click", F.col("at"))).over(later)).withColumn("read_at", F.min(F.when(F.col("name") == "view", F.col("at"))).over(later))
    return rows.where("name = 'given' and edit_at is not null").select("session_id", "ref", "edit_at", F.coalesce(F.col("read_at") < F.col("edit_at"), F.lit(False)).alias("reread"))


def rediscovered(reads: DataFrame, covering: DataFrame, given: DataFrame) -> DataFrame:
    """(session_id, path, record): reads of a path that an older record covers, where the session was never given that
    record, whatever else it was given. reads: session_id, path, at; covering: record, path, created_at; given:
    session_id, record. A session's reads of a path shrink to its last one before they meet."""
    last = reads.groupBy("session_id", "path").agg(F.max("at").alias("at"))
    late = last.join(covering, "path").where(F.col("created_at") < F.col("at")).select("session_id", "path", "record").distinct()
    return late.join(given.select("session_id", "record").distinct(), ["session_id", "record"], "left_anti").select("session_id", "path", "record")


def reviewable(calls: DataFrame, reviews: DataFrame) -> DataFrame:
    return calls.where("name = 'view' and ref is not null").join(reviews.select(F.col("call_id").alias("id")), "id", "left_anti")


def neighbours(rows: DataFrame, key: str, pivot: str, n: int) -> DataFrame:
    """The n rows before and after each marked row of a group: (key, pivot line, line, offset)."""
    lead = F.array(*(F.struct(F.lit(k).alias("offset"), (F.lead("line", k) if k > 0 else F.lag("line", -k)).over(Window.partitionBy(key).orderBy("line")).alias("line")) for k in range(-n, n + 1) if k))
    found = rows.withColumn("around", lead).where(pivot).select(key, F.col("line").alias("pivot"), F.explode("around").alias("a"))
    return found.where("a.line is not null").select(key, "pivot", F.col("a.line").alias("line"), F.col("a.offset").cast("long").alias("offset"))
