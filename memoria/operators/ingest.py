"""Normalising transcripts: identity, replay, fill-forward, forks, calls and their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: What a message's role says about who stands behind it.
ATTRIBUTION = {"user": "user_direction", "assistant": "agent_inference", "system": "host_summary"}


def drafts(events: DataFrame) -> DataFrame:
    """Events as records to be: attribution by role, a digest of what they say, one line for a title."""
    role = F.coalesce(*(F.when(F.col("role") == r, a) for r, a in ATTRIBUTION.items()), F.lit("agent_inference"))
    return events.select("transcript", "line", role.alias("attribution"), F.sha2(F.concat_ws("\x1f", "role", "text"), 256).alias("content_hash"), F.col("text").alias("body"))


def identify(events: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Adds status: replay where key and content_hash are known, version where the key is known with other content,
    new otherwise. Of events with one key and content in the batch the first is taken."""
    keys = seen.select(*key).distinct().withColumn("known_key", F.lit(True))
    contents = seen.select(*key, "content_hash").distinct().withColumn("known_content", F.lit(True))
    once = events.groupBy(*key, "content_hash").agg(F.min("line").alias("line"))
    status = F.when(F.col("known_key").isNull(), "new").when(F.col("known_content"), "replay").otherwise("version")
    return once.join(keys, key, "left").join(contents, [*key, "content_hash"], "left").select(*key, "content_hash", "line", status.alias("status"))


def missing(seen: DataFrame, epoch: Column, key: list[str]) -> DataFrame:
    """Keys that no pass since the given epoch has met."""
    return seen.groupBy(*key).agg(F.max("seen_epoch").alias("last")).where(F.col("last") < epoch)


def fill_forward(lines: DataFrame, cols: list[str], by: str = "transcript", order: str = "line") -> DataFrame:
    """What a line does not say holds from the last that did."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def fork_prefix(child: DataFrame, parent: DataFrame) -> DataFrame:
    """(transcript, shared): how many first lines of a child equal its parent's, line by line, until they part."""
    c = child.select("transcript", "parent", "line", F.col("digest").alias("c"))
    p = parent.select(F.col("transcript").alias("parent"), "line", F.col("digest").alias("p"))
    both = c.join(p, ["parent", "line"], "left")
    parted = F.min(F.when(F.col("p").isNull() | (F.col("c") != F.col("p")), F.col("line")))
    return both.groupBy("transcript").agg(F.coalesce(parted, F.max("line") + 1).alias("shared"))


def call_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(host, transcript, call_id, call, result): each call with the first result that names it. What a sub-agent's
    transcript (session/agent-…) did counts as its session's: see session."""
    key = ["host", "transcript", "call_id"]
    first = results.where("call_id is not null").groupBy(*key).agg(F.min("line").alias("result"))
    return calls.where("call_id is not null").groupBy(*key).agg(F.min("line").alias("call")).join(first, key)


def session(transcript: Column) -> Column:
    return F.split_part(transcript, F.lit("/agent-"), F.lit(1))


def stopped(lines: DataFrame, offending: Column) -> DataFrame:
    """The lines before a transcript's first offending one; there the reading stops."""
    w = Window.partitionBy("transcript").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("off", F.max(offending.cast("int")).over(w)).where("off = 0").drop("off")


def newest_copy(files: DataFrame) -> DataFrame:
    """Of files with one id the larger, then the newer."""
    w = Window.partitionBy("id").orderBy(F.desc("size"), F.desc("modified"), "path")
    return files.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def changes(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """Adds action to a snapshot of files (path, size, source_hash, anchor_now: digest of the bytes before the cursor):
    skip where nothing changed, append where what was read still stands, rewrite where it does not, new without a cursor."""
    c = cursors.select(F.col("path").alias("p"), "byte_offset", "anchor_hash", F.col("source_hash").alias("read_hash"), "epoch")
    action = (
        F.when(F.col("byte_offset").isNull(), "new").when(F.col("source_hash") == F.col("read_hash"), "skip")
        .when((F.col("size") >= F.col("byte_offset")) & F.col("anchor_now").eqNullSafe(F.col("anchor_hash")), "append").otherwise("rewrite")
    )
    rows = files.join(c, F.col("path") == F.col("p"), "left")
    return rows.select(*files.columns, action.alias("action"), F.when(action == "append", F.col("byte_offset")).otherwise(F.lit(0)).alias("from"), (F.coalesce("epoch", F.lit(0)) + (action == "rewrite").cast("int")).alias("epoch"))


def workstream(choice: Column, session: Column, worktree: Column, task: Column, branch: Column) -> Column:
    """Which workstream a call belongs to, by what is known, surest first."""
    return F.coalesce(choice, session, worktree, task, branch)
