"""Report and timeline queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import reporting
from ..sources import views
from .registry import query

_C = f"WITH {views.CALLS}"
_FIRST = f"{_C}, first AS (SELECT session_id, ref, called, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, ref ORDER BY called, id) AS n FROM calls WHERE name = 'view') WHERE n = 1)"


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    calls = views.call_log(spark, sf_dir)
    return calls, reporting.first_returns(calls.where("name = 'view'")), calls.where("name <> 'error'")


@query(f"{_C} SELECT session_id, count(*) AS calls, count(*) FILTER (name = 'view') AS searches, count(*) FILTER (name = 'error') AS empty, round(sum(ms), 4) AS ms FROM calls GROUP BY session_id")
def report_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.usage(views.call_log(spark, sf_dir))


@query(f"{_C} SELECT name, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95 FROM calls GROUP BY name")
def report_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.latency(views.call_log(spark, sf_dir))


@query(_FIRST + " SELECT session_id, ref, id FROM first")
def first_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)[1].select("session_id", "ref", "id")


@query(
    _FIRST
    + """ SELECT f.session_id, f.ref, coalesce(bool_or(c.name = 'view' AND c.called > f.called), false) AS read, coalesce(bool_or(c.name = 'click' AND c.called > f.called), false) AS edited,
    coalesce(bool_or(c.name = 'purchase' AND c.called > f.called), false) AS cited, coalesce(bool_or(c.called > f.called AND c.name IN ('view', 'click', 'purchase')), false) AS used
  FROM first f LEFT JOIN calls c ON c.session_id = f.session_id AND c.ref = f.ref AND c.name <> 'error' GROUP BY ALL"""
)
def used_after_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, first, acts = _split(spark, sf_dir)
    return reporting.used_later(first, acts)


@query(
    _FIRST
    + """, e AS (SELECT f.session_id, f.ref, f.called, min(c.called) AS edit_at FROM first f JOIN calls c ON c.session_id = f.session_id AND c.ref = f.ref AND c.name = 'click' AND c.called > f.called GROUP BY ALL)
  SELECT session_id, ref, epoch_us(edit_at) AS edit_us, EXISTS (SELECT 1 FROM calls c WHERE c.session_id = e.session_id AND c.ref = e.ref AND c.name = 'view' AND c.called > e.called AND c.called < e.edit_at) AS reread FROM e"""
)
def edit_after_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, first, acts = _split(spark, sf_dir)
    return reporting.edit_after(first, acts).select("session_id", "ref", F.unix_micros("edit_at").alias("edit_us"), "reread")


@query(
    f"""{_C}, covering AS (SELECT doc_id AS record, doc_id % 50 AS path, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS created_at FROM documents WHERE doc_id < 100)
  SELECT DISTINCT session_id, path, record FROM calls c JOIN covering k ON k.path = c.ref % 50 WHERE name = 'click' AND created_at < called
    AND NOT EXISTS (SELECT 1 FROM calls g WHERE g.name = 'view' AND g.session_id = c.session_id AND g.ref = k.record)"""
)
def rediscoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, d = views.call_log(spark, sf_dir), F.col("doc_id")
    covering = views.table(spark, sf_dir, "documents").where(d < 100).select(d.alias("record"), (d % 50).alias("path"), F.timestamp_seconds(F.lit(1704067200) + d * 3600).alias("created_at"))
    reads = calls.where("name = 'click'").select("session_id", (F.col("ref") % 50).alias("path"), "at")
    return reporting.rediscovered(reads, covering, calls.where("name = 'view'").select("session_id", F.col("ref").alias("record")))


@query("SELECT CASE WHEN toxic = 1 THEN 'missed' WHEN quality = 1 THEN 'good' ELSE 'partial' END AS rating, count(*) AS n FROM labels GROUP BY 1")
def review_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = F.when(F.col("toxic") == 1, "missed").when(F.col("quality") == 1, "good").otherwise("partial")
    return views.table(spark, sf_dir, "labels").groupBy(rating.alias("rating")).agg(F.count("*").alias("n"))


@query(f"{_C} SELECT id FROM calls WHERE name = 'view' AND ref IS NOT NULL AND id NOT IN (SELECT doc_id FROM labels)")
def reviewable_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.reviewable(views.call_log(spark, sf_dir), views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("call_id"))).select("id")


@query(
    """WITH t AS (SELECT conv_id AS transcript, turn AS line, role FROM conversations), o AS (SELECT *, row_number() OVER (PARTITION BY transcript ORDER BY line) AS n FROM t)
  SELECT p.transcript, p.line AS pivot, q.line, q.n - p.n AS "offset" FROM o p JOIN o q ON p.transcript = q.transcript AND q.n <> p.n AND abs(q.n - p.n) <= 2 WHERE p.role = 'user'"""
)
def timeline_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.neighbours(views.events(spark, sf_dir), "transcript", "role = 'user'", 2)


@query(
    """SELECT conv_id AS transcript, count(*) FILTER (role = 'user') AS prompts, count(*) FILTER (role = 'assistant') AS replies, bool_or(role = 'system') AS summarised, max(turn) AS last FROM conversations GROUP BY conv_id"""
)
def session_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    rows = views.events(spark, sf_dir).groupBy("transcript")
    return rows.agg(F.count_if(role == "user").alias("prompts"), F.count_if(role == "assistant").alias("replies"), F.bool_or(role == "system").alias("summarised"), F.max("line").alias("last"))


@query("SELECT conv_id AS transcript, turn AS line FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') WHERE n <= 3")
def latest_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir).where("role = 'user'").withColumn("n", F.row_number().over(Window.partitionBy("transcript").orderBy(F.desc("line"))))
    return rows.where("n <= 3").select("transcript", "line")
