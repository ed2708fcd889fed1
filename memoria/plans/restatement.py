"""Queries of verbatim restatement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import restatement
from ..sources import views
from .registry import query

_NORMAL = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"


def _pieces(rows: str, keys: str) -> str:
    """Bodies, their lines and their sentences of 40 characters and more."""
    parts = r"list_append(regexp_split_to_array(regexp_replace(body, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), body)"
    return f"SELECT DISTINCT {keys}, piece FROM (SELECT {keys}, {_NORMAL.format('p')} AS piece FROM (SELECT {keys}, unnest({parts}) AS p FROM {rows})) WHERE length(piece) >= 40"


@query(
    f"""WITH {views.RECORDS}, pieces AS ({_pieces("records WHERE lifecycle = 'retracted'", "seq, workstream_id")}),
  texts AS (SELECT seq AS record, workstream_id, {_NORMAL.format("body")} AS normal FROM records WHERE kind = 'checkpoint')
  SELECT record, min(seq) AS cause FROM texts t JOIN pieces p ON contains(t.normal, p.piece) AND (p.workstream_id IS NULL OR p.workstream_id = t.workstream_id) GROUP BY record"""
)
def restating_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = views.records(spark, sf_dir)
    return restatement.restating_checkpoints(records.where("lifecycle = 'retracted'"), records.where("kind = 'checkpoint'"))


# A transcript is twenty documents long; every third of them is a record that the agent is shown, the others it says.
_BRANCHES = "b AS (SELECT doc_id // 20 AS branch, doc_id AS line, text AS body FROM documents)"


@query(
    f"""WITH {_BRANCHES}, pieces AS ({_pieces("b WHERE line % 3 = 0", "branch, line")}), said AS (SELECT branch, line, {_NORMAL.format("body")} AS normal FROM b WHERE line % 3 <> 0)
  SELECT DISTINCT said.branch, said.line, 'rec_' || p.line AS record FROM said JOIN pieces p ON said.branch = p.branch AND said.line > p.line AND contains(normal, piece)"""
)
def restated_echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    lines = views.table(spark, sf_dir, "documents").select(F.floor(d / 20).alias("branch"), d.alias("line"), F.col("text").alias("body"))
    shown = lines.where("line % 3 = 0").withColumn("record", F.concat(F.lit("rec_"), "line"))
    return restatement.restated_echoes(shown, lines.where("line % 3 <> 0").withColumnRenamed("body", "text"))
