"""Queries of freshness reasons, trust reasons, independent sources, vector fills and top-k scans."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors
from ..operators import eligibility, fill, freshness, lineage, ranking
from ..sources import views
from .recall import _BANDED, _VECTOR, first
from .registry import query
from .upkeep import _CHUNKS, _chunks

# Documents are files that changed in six ways since their whole text was cited; twenty to a check, of which twelve count.
_REFS = """r AS (SELECT doc_id, doc_id // 20 AS "check", text, len(string_split(text, chr(10))) AS n FROM documents WHERE text <> '' AND text NOT LIKE '%' || chr(13) || '%'),
  l AS (SELECT *, doc_id % 13 <> 0 AS local, row_number() OVER (PARTITION BY "check", doc_id % 13 <> 0 ORDER BY doc_id) AS place FROM r)"""


@query(
    f"""WITH {_REFS}
  SELECT doc_id, CASE WHEN NOT local THEN CASE WHEN doc_id % 2 = 0 THEN 'remote_unverified' ELSE 'not_checkable' END WHEN place > 12 THEN 'check_limit' WHEN doc_id % 11 = 0 THEN 'outside_worktree' WHEN doc_id % 17 = 0 THEN 'not_observed'
    WHEN doc_id % 6 = 4 THEN CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'unknown_commit' ELSE 'not_observed' END ELSE 'missing' END WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'unknown_commit' ELSE 'not_observed' END
    WHEN doc_id % 19 = 0 THEN 'too_large' WHEN doc_id % 6 = 0 THEN 'unchanged' WHEN doc_id % 6 = 1 THEN 'lines_moved' WHEN doc_id % 6 = 2 THEN 'changed_elsewhere' WHEN doc_id % 6 = 3 THEN 'lines_changed' ELSE 'changed' END AS reason FROM l"""
)
def freshness_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, body = F.col("doc_id"), F.col("text")
    rows = views.table(spark, sf_dir, "documents").where("text <> '' and instr(text, '\r') = 0")
    sha = lambda c: F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))
    n = F.size(F.split(body, "\n")).cast("long")
    path = F.concat(F.lit("f"), d.cast("string"))
    seen = d % 5 != 0
    refs = rows.select(
        "doc_id", F.floor(d / 20).alias("check"), d.alias("place"), d.alias("record"), (d % 13 != 0).alias("local"), (d % 2 == 0).alias("remote"), F.when(d % 11 != 0, path).alias("path"), (d % 17 == 0).alias("sensitive"),
        F.lit(False).alias("imported"), F.when((d % 5 == 0) & (d % 2 == 0), "lost").when(d % 5 == 0, "known").alias("commit"), F.lit(None).cast("boolean").alias("dirty"), F.when(seen, sha(body)).alias("observed_hash"),
        F.lit(1).cast("long").alias("first"), n.alias("last"), F.when(seen, sha(body)).alias("cited_hash"), F.octet_length(body).cast("long").alias("cited_bytes"), F.lit(None).cast("long").alias("cited_lines"),
    )
    now = F.when(d % 6 == 0, body).when(d % 6 == 1, F.concat(F.lit("new\n"), body)).when(d % 6 == 2, F.concat(body, F.lit("\nend"))).when(d % 6 == 3, F.lit("\x01other")).otherwise(F.concat(body, F.lit("\n"), body))
    files = rows.where(d % 6 != 4).select(path.alias("path"), F.when(d % 19 == 0, "too_large").otherwise("hashed").alias("kind"), F.when(d % 19 == 0, 1 << 21).otherwise(F.octet_length(now)).cast("long").alias("size"), sha(now).alias("hash"), now.cast("binary").alias("content"))
    known = spark.createDataFrame([("known",)], "commit string")
    state = spark.createDataFrame([], "head string, dirty array<string>")
    return freshness.checked(refs, files, state, known, per_check=12, total_bytes=1 << 40).select("doc_id", "reason")


@query(
    _BANDED
    + """, f AS (SELECT *, seq % 3 AS f1, CASE WHEN attribution = 'direct_observation' THEN 0 ELSE 1 END AS f2, CASE WHEN attribution = 'agent_inference' THEN 1 ELSE 0 END AS f3, 1 - seq % 2 AS f4 FROM banded)
  SELECT query_id, seq, EXISTS (SELECT 1 FROM f g WHERE g.query_id = f.query_id AND g.band = f.band AND g.rank < f.rank AND g.f1 > f.f1) AS by_freshness,
    EXISTS (SELECT 1 FROM f g WHERE g.query_id = f.query_id AND g.band = f.band AND g.rank < f.rank AND g.f1 = f.f1 AND g.f2 > f.f2) AS by_evidence,
    EXISTS (SELECT 1 FROM f g WHERE g.query_id = f.query_id AND g.band = f.band AND g.rank < f.rank AND g.f1 = f.f1 AND g.f2 = f.f2 AND g.f3 > f.f3) AS by_attribution,
    EXISTS (SELECT 1 FROM f g WHERE g.query_id = f.query_id AND g.band = f.band AND g.rank < f.rank AND g.f1 = f.f1 AND g.f2 = f.f2 AND g.f3 = f.f3 AND g.f4 > f.f4) AS by_roots FROM f"""
)
def trust_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which level of trust lifted a record above one that came before it."""
    attribution = F.col("attribution")
    levels = {"freshness": F.col("seq") % 3, "evidence": F.when(attribution == "direct_observation", 0).otherwise(1), "attribution": F.when(attribution == "agent_inference", 1).otherwise(0), "roots": 1 - F.col("seq") % 2}
    rows = ranking.trust_reasons(ranking.bands(first(spark, sf_dir, 30)), levels)
    return rows.select("query_id", "seq", *(F.col(f"lifted_{n}").alias(f"by_{n}") for n in levels))


@query(
    rf"""WITH RECURSIVE {views.RECORDS}, {views.LINKS},
  p AS (SELECT from_seq AS child, arg_min(to_seq, ROW(CASE WHEN relation = 'derived_from' THEN 0 ELSE 1 END, to_seq)) AS parent FROM links WHERE relation IN ('derived_from', 'supported_by') AND to_seq IN (SELECT seq FROM records WHERE lifecycle = 'active') GROUP BY 1),
  walk AS (SELECT seq, seq AS root, 0 AS d FROM records UNION ALL SELECT walk.seq, parent, d + 1 FROM walk JOIN p ON p.child = walk.root WHERE d < 16),
  s AS (SELECT r.seq, trim(regexp_replace(body, '\s+', ' ', 'g')) AS claim, CASE WHEN root % 4 < 2 THEN (root // 4) || '@' || 'h' ELSE 'record ' || root END AS source FROM (SELECT seq, arg_max(root, d) AS root FROM walk GROUP BY seq) w JOIN records r USING (seq))
  SELECT sha256(claim) AS claim, count(*) AS records, count(DISTINCT source) AS roots, min(seq) AS first_seq FROM s GROUP BY claim"""
)
def claim_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by independent source: what a record finally rests on, an imported one being its host's event."""
    records = views.records(spark, sf_dir)
    found = lineage.roots(records, lineage.parents(views.links(spark, sf_dir), records.where("lifecycle = 'active'")))
    events = records.where("seq % 4 < 2").select(F.col("seq").alias("record"), F.lit("h").alias("host"), F.floor(F.col("seq") / 4).cast("string").alias("event_id"))
    return ranking.claim_groups(records.join(lineage.source_roots(found, events).select("seq", "source"), "seq"), F.col("source"))


@query(
    _VECTOR
    + """, s AS (SELECT query_id, record, round(max(score), 6) AS score FROM (SELECT q.query_id, CAST(i.vec_id // 7 AS BIGINT) AS record, round(list_dot_product(q, v) * scale, 6) AS score FROM q, i WHERE scale IS NOT NULL) GROUP BY ALL)
  SELECT * FROM (SELECT query_id, record, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record DESC) AS rank FROM s) WHERE rank <= 10"""
)
def vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best records of every query, seven vectors to a record."""
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", vectors.unit(F.col("embedding")).alias("u")).withColumn("scale", vectors.int8_scale(F.col("u")))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("u").alias("q"))
    stored = rows.select(F.floor(F.col("vec_id") / 7).alias("record"), vectors.int8(F.col("u"), F.col("scale")).alias("values"), F.when(F.col("vec_id") % 4 != 0, F.col("scale")).alias("scale"))
    return ranking.vector_top(asked, stored, 10)


@query(
    f"""WITH {views.RECORDS}, {views.TAINTS}, {_CHUNKS.replace("stored AS", "old AS")}, top AS (SELECT max(seq) - 20 AS top FROM records),
  c AS (SELECT text_hash, CASE WHEN record > top THEN 0 WHEN workstream_id = 'en' OR workstream_id IS NULL THEN 1 ELSE 2 END AS region, -record AS newest, ordinal FROM chunks JOIN records ON seq = record, top
    WHERE lifecycle = 'active' AND id NOT IN (SELECT record_id FROM taints) AND kind <> 'checkpoint'),
  f AS (SELECT text_hash, min(ROW(region, newest, ordinal)) AS f FROM c GROUP BY text_hash)
  SELECT text_hash, (row_number() OVER (ORDER BY f, text_hash) - 1) // 60 AS step FROM f QUALIFY step < 3"""
)
def vector_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts three steps of a fill embed, the second run going on where the first was stopped."""

    def embed(texts: pd.Series) -> pd.DataFrame:
        """Eight numbers of a text's digest: the model is the caller's."""
        return pd.DataFrame({"values": [[b - 128 for b in hashlib.sha256(t.encode()).digest()[:8]] for t in texts], "scale": 1 / 128})

    able = eligibility.fillable(views.records(spark, sf_dir), views.taints(spark, sf_dir)).select("seq", "workstream_id")
    # Every step reads all hashes, so the texts are cut once.
    chunks = views.kept(spark, sf_dir, "fill-chunks", lambda: _chunks(spark, sf_dir)[0].select(F.col("record").alias("seq"), "ordinal", "text", "text_hash")).withColumn("id", F.col("seq"))
    top = views.records(spark, sf_dir).agg(F.max("seq")).first()[0] - 20
    path = f"{views.shared_dir(spark)}/fill-{uuid.uuid4().hex}"
    for steps in (1, 2):
        fill.fill(chunks, able, path, "digest", embed, "en", top, limit=60, steps=steps)
    return fill.stored(spark, path).select("text_hash", F.col("step").cast("long").alias("step"))
