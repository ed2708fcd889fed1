"""Stateful ingest over replayed slices."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import views
from ..streaming import stateful
from .registry import query

_EVENTS = """t AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS k, sha256(coalesce(text, '')) AS h FROM conversations WHERE conv_id % 11 <> 5),
  stop AS (SELECT conv_id, min(turn) AS halt FROM t WHERE conv_id % 7 = 4 AND turn >= 4 GROUP BY conv_id), live AS (SELECT t.* FROM t LEFT JOIN stop USING (conv_id) WHERE halt IS NULL OR turn < halt),
  call AS (SELECT conv_id, turn + 1 AS turn, true AS called FROM live WHERE k = 2)"""


def _slices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each conversation in two slices; every slice comes twice, and the second also as one that was read too early."""
    c, turn = F.col("conv_id"), F.col("turn")
    k = (c + turn) % 5
    kind = F.when(k == 2, "tool_call").when(k == 3, "tool_result").otherwise("message")
    rows = views.table(spark, sf_dir, "conversations").select(
        F.lit("a").alias("host"), c.cast("string").alias("transcript"), F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("expected_epoch"), F.lit(None).cast("long").alias("stop_at"),
        F.when(c % 11 == 5, 2).otherwise(1).alias("candidates"), turn.alias("line_start"), F.lit("main").alias("branch"), F.concat(F.lit("e"), turn.cast("string")).alias("event_id"), kind.alias("type"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"), F.when(k == 2, turn).when(k == 3, turn - 1).cast("string").alias("call_id"), F.when(k == 2, "Bash").alias("tool"),
        F.when(k == 2, F.when(c % 3 == 0, "own").otherwise("other")).alias("tool_kind"), (~((c % 7 == 4) & (turn >= 4))).alias("in_scope"),
    )
    end = rows.groupBy("transcript").agg((F.max("line_start") + 1).alias("slice_end"))
    first = rows.where("line_start < 3").withColumn("expected", F.lit(None).cast("long")).withColumn("slice_end", F.lit(3).cast("long"))
    later = rows.where("line_start >= 3").withColumn("expected", F.lit(3).cast("long")).join(end, "transcript")
    named = lambda df, name: df.withColumn("slice", F.lit(name)).select(*(c.split()[0] for c in stateful.SLICE.split(", ")))
    early = later.withColumn("expected", F.lit(2).cast("long"))
    return named(first, "1").union(named(first, "1 again")), named(later, "2").union(named(later, "2 again")).union(named(early, "2 early"))


@query(
    f"""WITH {_EVENTS}
  SELECT CAST(conv_id AS VARCHAR) AS transcript, 'e' || turn AS event_id, CASE WHEN k = 2 THEN 'tool_call' WHEN k = 3 AND called AND conv_id % 3 = 0 THEN 'echo' ELSE 'record' END AS disposition, false AS version,
    CASE WHEN k = 3 AND called THEN 'Bash' END AS call_tool, h AS content_hash FROM live LEFT JOIN call USING (conv_id, turn)"""
)
def stateful_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream brings in from two landings of slices, run after run, equals what the whole transcripts hold."""
    base = f"{views.shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    for landing in _slices(spark, sf_dir):
        landing.write.mode("append").parquet(f"{base}/landed")
        stateful.ingest(spark, f"{base}/landed", f"{base}/applied", f"{base}/state").awaitTermination()
    rows = spark.read.schema(stateful.APPLIED).parquet(f"{base}/applied")
    return rows.where("disposition in ('record', 'tool_call', 'echo', 'replay')").select("transcript", "event_id", "disposition", "version", "call_tool", "content_hash")
