"""Lineage and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import lineage
from ..sources import views
from .registry import query

_L = f"WITH RECURSIVE {views.RECORDS}, {views.LINKS}"


@query(f"{_L} SELECT from_seq AS record, to_seq AS other, relation, 'out' AS direction FROM links UNION ALL SELECT to_seq, from_seq, relation, 'in' FROM links")
def links_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.both_ways(views.links(spark, sf_dir))


@query(f"{_L} SELECT from_seq AS record, list(to_seq ORDER BY to_seq) AS cites FROM links WHERE to_seq IN (SELECT seq FROM records WHERE lifecycle = 'active') GROUP BY from_seq")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.citations(views.links(spark, sf_dir), views.records(spark, sf_dir).where("lifecycle = 'active'"))


@query(
    f"""{_L}, held AS (SELECT * FROM links WHERE relation <> 'references' AND to_seq IN (SELECT seq FROM records WHERE lifecycle = 'active')),
  walk AS (SELECT seq, seq AS root, 0 AS hops FROM records UNION ALL SELECT w.seq, h.to_seq, w.hops + 1 FROM walk w JOIN held h ON h.from_seq = w.root WHERE w.hops < 16)
  SELECT seq, arg_max(root, hops) AS root, CAST(max(hops) AS BIGINT) AS hops FROM walk GROUP BY seq"""
)
def independent_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = views.records(spark, sf_dir)
    return lineage.roots(records, lineage.parents(views.links(spark, sf_dir), records.where("lifecycle = 'active'")))


@query(
    f"""{_L}, cause AS (SELECT seq, lifecycle = 'retracted' AS wrong FROM records WHERE lifecycle <> 'active'),
  walk AS (SELECT l.from_seq AS record, CASE WHEN relation = 'derived_from' THEN 0 ELSE 1 END AS label, 1 AS d FROM cause JOIN links l ON l.to_seq = cause.seq WHERE relation = 'derived_from' OR (relation = 'supported_by' AND wrong)
    UNION SELECT l.from_seq, CASE WHEN relation = 'derived_from' THEN label ELSE 1 END, d + 1 FROM walk JOIN links l ON l.to_seq = walk.record WHERE relation <> 'references' AND d < 16)
  SELECT record, CAST(min(label) AS BIGINT) AS label FROM walk GROUP BY record"""
)
def taint_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.reliable(spark)
    causes = views.records(spark, sf_dir).where("lifecycle <> 'active'").select("seq", (F.col("lifecycle") == "retracted").alias("wrong"))
    return lineage.taint_closure(causes, views.links(spark, sf_dir)).select("record", F.col("label").cast("long").alias("label"))


_EVENTS = """ev AS (SELECT event_id AS seq, user_id AS record, CASE event_type WHEN 'view' THEN 'retract' WHEN 'click' THEN 'restore' WHEN 'signup' THEN 'correct' WHEN 'purchase' THEN 'supersede' ELSE 'restore' END AS action FROM events)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "view", "retract").when(F.col("event_type") == "signup", "correct").when(F.col("event_type") == "purchase", "supersede").otherwise("restore")
    return views.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("record"), action.alias("action"))


@query(
    f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY seq) AS n FROM ev),
  f AS (SELECT DISTINCT record, 'active' AS state, 0 AS n FROM ev UNION ALL
    SELECT f.record, CASE WHEN action = 'retract' AND state = 'active' THEN 'retracted' WHEN action = 'restore' AND state = 'retracted' THEN 'active'
      WHEN action = 'correct' AND state = 'active' THEN 'corrected' WHEN action = 'supersede' AND state = 'active' THEN 'superseded' ELSE state END, o.n FROM f JOIN o ON o.record = f.record AND o.n = f.n + 1)
  SELECT record, arg_max(state, n) AS state FROM f GROUP BY record"""
)
def lifecycle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.states(_events(spark, sf_dir))


@query("SELECT event_id AS ledger_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def ledger_unapplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("ledger_id"))
    return lineage.unapplied(ledger, views.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("ledger_id")))


@query(f"{_L} SELECT seq, CASE WHEN seq % 9 <> 0 THEN body END AS body, CASE WHEN seq % 9 = 0 THEN 'forgotten' ELSE lifecycle END AS lifecycle FROM records")
def forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = views.records(spark, sf_dir)
    return lineage.forgotten(records, records.where("seq % 9 = 0")).select("seq", "body", "lifecycle")


@query(
    f"""{_L}, gone AS (SELECT seq FROM records WHERE seq % 9 = 0)
  SELECT (SELECT count(*) FROM gone) AS records, (SELECT count(*) FROM links WHERE from_seq IN (SELECT seq FROM gone) OR to_seq IN (SELECT seq FROM gone)) AS links,
    (SELECT count(DISTINCT from_seq) FROM links WHERE to_seq IN (SELECT seq FROM gone) AND relation <> 'references') AS dependents"""
)
def forget_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = views.records(spark, sf_dir).where("seq % 9 = 0").select("seq")
    sides = views.links(spark, sf_dir).join(gone.select(F.col("seq").alias("a")), F.col("from_seq") == F.col("a"), "left").join(gone.select(F.col("seq").alias("b")), F.col("to_seq") == F.col("b"), "left")
    counts = sides.agg(F.count_if(F.col("a").isNotNull() | F.col("b").isNotNull()).alias("links"), F.count_distinct(F.when(F.col("b").isNotNull() & (F.col("relation") != "references"), F.col("from_seq"))).alias("dependents"))
    return gone.agg(F.count("*").alias("records")).crossJoin(counts)


@query(
    f"{_L}, c AS (SELECT workstream_id, seq AS record, row_number() OVER (PARTITION BY workstream_id ORDER BY seq) AS revision FROM records WHERE kind = 'checkpoint' AND workstream_id IS NOT NULL)"
    " SELECT workstream_id, max(revision) AS revision, arg_max(record, revision) AS record FROM c GROUP BY workstream_id"
)
def head_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("workstream_id").orderBy("seq")
    rows = views.records(spark, sf_dir).where("kind = 'checkpoint' and workstream_id is not null").select("workstream_id", F.col("seq").alias("record"), F.row_number().over(w).cast("long").alias("revision"))
    return lineage.head(rows).select("workstream_id", "revision", "record")


@query("SELECT conv_id, turn, (turn + 3) // 5 > turn // 5 AS nudge FROM conversations")
def checkpoint_nudges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", lineage.nudged(F.col("turn"), F.col("turn") + 3).alias("nudge"))


@query(f"{_L} SELECT from_seq, to_seq FROM links WHERE to_seq NOT IN (SELECT seq FROM records WHERE kind <> 'checkpoint')")
def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = views.records(spark, sf_dir).where("kind <> 'checkpoint'").select(F.col("seq").alias("to_seq"))
    return views.links(spark, sf_dir).join(kept, "to_seq", "left_anti").select("from_seq", "to_seq")
