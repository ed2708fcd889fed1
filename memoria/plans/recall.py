"""Recall: eligibility, BM25 and the stages after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text, vectors
from ..operators import eligibility, ranking
from ..sources import views
from .registry import query

_V = f"WITH {views.RECORDS}, {views.TAINTS}"
_ELIGIBLE = "(workstream_id = 'en' OR workstream_id IS NULL) AND lifecycle = 'active' AND id NOT IN (SELECT record_id FROM taints)"
_BM25 = rf"""{_V}, {views.QUERY_TERMS},
  tok AS (SELECT seq, unnest(regexp_extract_all(strip_accents(lower(body)), '[\p{{L}}\p{{N}}]+')) AS term FROM records),
  post AS (SELECT seq, term, count(*) AS tf FROM tok GROUP BY ALL),
  dl AS (SELECT seq, sum(tf) AS dl FROM post GROUP BY seq), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
  df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, st),
  hit AS (SELECT query_id, post.seq, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM query_terms JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (seq), st GROUP BY query_id, post.seq),
  scored AS (SELECT query_id, r.*, score FROM hit JOIN records r USING (seq) WHERE {_ELIGIBLE} AND kind <> 'checkpoint'),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, created_at DESC, seq DESC) AS rank FROM scored)"""


def able(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Recallable records without their bodies, with what else is made of them."""
    rows = views.records(spark, sf_dir).select("seq", "id", "kind", "workstream_id", "lifecycle", "attribution", "created_at", *more)
    return eligibility.recallable(rows, views.taints(spark, sf_dir), "en").drop("id", "kind", "workstream_id", "lifecycle")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.weighed(views.index(spark, sf_dir), views.queries(spark, sf_dir))


def first(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The first k BM25 matches of each query among recallable records."""
    return ranking.top(ranking.leading(views.index(spark, sf_dir), asked(spark, sf_dir), able(spark, sf_dir), k), k)


@query(_BM25 + " SELECT query_id, seq, rank, score FROM ranked WHERE rank <= 10")
def recall_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first(spark, sf_dir, 10).select("query_id", "seq", "rank", "score")


@query(_BM25 + " SELECT query_id, count(*) AS matches, min(score) AS best FROM scored GROUP BY query_id")
def recall_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.totals(views.index(spark, sf_dir), asked(spark, sf_dir), able(spark, sf_dir))


@query(
    _BM25
    + """, rel AS (SELECT *, score <= 0.5 * min(score) OVER q AS relevant, score <= 0.9 * min(score) OVER q AS close FROM scored WINDOW q AS (PARTITION BY query_id)),
  tier AS (SELECT *, CAST(contains(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') AS BIGINT) AS verbatim,
    relevant AND created_at >= TIMESTAMP '2024-01-01 02:00:00' AND created_at < TIMESTAMP '2024-01-01 08:00:00' AS windowed, close AND query_id % 2 = 0 AS newest FROM rel),
  placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY verbatim DESC, windowed DESC, newest DESC, CASE WHEN newest THEN created_at END DESC NULLS LAST, score, created_at DESC, seq DESC) AS pos FROM tier)
  SELECT query_id, seq, pos, verbatim, windowed, newest FROM placed WHERE pos <= 20"""
)
def recall_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = eligibility.in_window(F.lit("2024-01-01 02:00:00").cast("timestamp"), F.lit("2024-01-01 08:00:00").cast("timestamp"))
    phrases = text.phrases_contained(F.col("body"), F.array(F.lit("The")))
    records = able(spark, sf_dir, F.coalesce(phrases, F.lit(-1)).alias("verbatim"), F.coalesce(window, F.lit(False)).alias("in_window"))
    index, terms = views.index(spark, sf_dir), asked(spark, sf_dir)
    # A query's best score decides what is relevant, so it comes first, for all matches.
    best = ranking.totals(index, terms, records).select("query_id", "best")
    terms = terms.join(best, "query_id").withColumn("now", F.col("query_id") % 2 == 0)
    rows = ranking.tiers(ranking.leading(index, terms, records, 20, ranking.by_tier), F.col("verbatim"), F.col("in_window"), F.col("now"))
    return rows.where("pos <= 20").select("query_id", "seq", "pos", "verbatim", "windowed", "newest")


_BANDED = (
    _BM25.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, ten AS (SELECT * FROM ranked WHERE rank <= 30),
  fold AS (SELECT query_id, rank, score AS lead, 0 AS band FROM ten WHERE rank = 1
    UNION ALL SELECT t.query_id, t.rank, CASE WHEN t.score > 0.9 * f.lead THEN t.score ELSE f.lead END, f.band + CASE WHEN t.score > 0.9 * f.lead THEN 1 ELSE 0 END
    FROM fold f JOIN ten t ON t.query_id = f.query_id AND t.rank = f.rank + 1),
  banded AS (SELECT ten.*, CAST(fold.band AS BIGINT) AS band FROM ten JOIN fold USING (query_id, rank))"""
)


@query(_BANDED + " SELECT query_id, seq, rank, band FROM banded")
def relevance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bands(first(spark, sf_dir, 30)).select("query_id", "seq", "rank", "band")


@query(
    _BANDED
    + """, placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY band, seq % 3, CASE WHEN attribution = 'direct_observation' THEN 0 ELSE 1 END,
    CASE WHEN attribution = 'agent_inference' THEN 1 ELSE 0 END, seq % 2 DESC, rank) AS trust_pos FROM banded)
  SELECT query_id, seq, band, trust_pos FROM placed"""
)
def trust_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    banded = ranking.bands(first(spark, sf_dir, 30))
    attribution = F.col("attribution")
    placed = ranking.trust_order(banded, F.col("seq") % 3, F.when(attribution == "direct_observation", 0).otherwise(1), F.when(attribution == "agent_inference", 1).otherwise(0), F.col("seq") % 2)
    return placed.select("query_id", "seq", "band", "trust_pos")


@query(f"{_V} SELECT seq FROM records WHERE {_ELIGIBLE} AND kind <> 'checkpoint'")
def recallable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.recallable(views.records(spark, sf_dir), views.taints(spark, sf_dir), "en").select("seq")


@query(f"{_V} SELECT seq FROM records WHERE lifecycle = 'active' AND id NOT IN (SELECT record_id FROM taints) AND kind <> 'checkpoint'")
def fillable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.fillable(views.records(spark, sf_dir), views.taints(spark, sf_dir)).select("seq")


@query(
    f"""{_V}, first AS (SELECT record_id, min(ROW(taint, cause_id)) AS t FROM taints GROUP BY record_id)
  SELECT id, (lifecycle = 'active' AND record_id IS NULL) AS eligible, CASE WHEN lifecycle <> 'active' THEN lifecycle ELSE struct_extract_at(t, 1) END AS reason,
    CASE WHEN lifecycle = 'active' THEN struct_extract_at(t, 2) END AS cause_id FROM records LEFT JOIN first ON id = record_id"""
)
def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.reasons(views.records(spark, sf_dir), views.taints(spark, sf_dir))


@query(
    f"""{_V}, asked AS (SELECT 'rec_' || l_orderkey AS id FROM lineitem GROUP BY l_orderkey)
  SELECT a.id, CASE WHEN kind IS NULL THEN 'not_found' WHEN workstream_id = 'en' OR workstream_id IS NULL THEN 'found' ELSE 'scope_denied' END AS status
  FROM asked a LEFT JOIN records r ON a.id = r.id"""
)
def scope_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("rec_"), "l_orderkey").alias("id")).distinct()
    return eligibility.guarded(views.records(spark, sf_dir), asked, "en")


@query(f"{_V} SELECT seq, created_at FROM records WHERE kind IN ('note', 'evidence') AND created_at >= TIMESTAMP '2024-01-01 03:00:00' AND created_at < TIMESTAMP '2024-01-01 09:00:00'")
def kinds_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = eligibility.in_window(F.lit("2024-01-01 03:00:00").cast("timestamp"), F.lit("2024-01-01 09:00:00").cast("timestamp"))
    rows = views.records(spark, sf_dir).where(F.col("kind").isin("note", "evidence") & window)
    return rows.select("seq", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query(f"{_V} SELECT workstream_id, count(*) AS records FROM records WHERE lifecycle = 'active' AND id NOT IN (SELECT record_id FROM taints) AND kind NOT IN ('checkpoint', 'preference') GROUP BY workstream_id")
def work_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = eligibility.fillable(views.records(spark, sf_dir), views.taints(spark, sf_dir)).where("kind <> 'preference'")
    return rows.groupBy("workstream_id").agg(F.count("*").alias("records"))


@query(f"{_V}, recent AS (SELECT seq, row_number() OVER (ORDER BY created_at DESC, seq DESC) AS rank FROM records WHERE {_ELIGIBLE}) SELECT seq, rank FROM recent WHERE rank <= 50")
def recent_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = eligibility.visible(views.records(spark, sf_dir), views.taints(spark, sf_dir), "en").orderBy(F.desc("created_at"), F.desc("seq")).limit(50)
    return rows.select("seq", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("created_at"), F.desc("seq"))).cast("long").alias("rank"))


@query(
    rf"""{_V}, c AS (SELECT sha256(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS claim, host AS root, seq FROM records)
  SELECT claim, count(*) AS records, count(DISTINCT root) AS roots, min(seq) AS first_seq FROM c GROUP BY claim"""
)
def claim_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.claim_groups(views.records(spark, sf_dir), F.col("host"))


@query(
    rf"""{_V}, c AS (SELECT sha256(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS claim, host AS root, seq, created_at FROM records),
  f AS (SELECT *, first_value(seq) OVER (PARTITION BY claim, root ORDER BY created_at, seq) AS representative FROM c)
  SELECT claim, root, representative, seq AS copy FROM f WHERE seq <> representative"""
)
def claim_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.claim_copies(views.records(spark, sf_dir), F.col("host"))


@query(
    """SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(-127, least(127, floor((CAST(x AS DOUBLE) / n) / (m / n / 127) + 0.5))) AS INTEGER)) AS "values", round(m / n / 127, 9) AS scale
  FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n,
    list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS m FROM embeddings)"""
)
def vector_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", vectors.unit(F.col("embedding")).alias("u"))
    rows = rows.withColumn("exact", vectors.int8_scale(F.col("u")))
    return rows.select("vec_id", vectors.int8(F.col("u"), F.col("exact")).alias("values"), F.round("exact", 9).alias("scale"))


_VECTOR = """WITH n AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings),
  u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / n) AS u, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE) / n))) / 127 AS scale FROM n),
  i AS (SELECT vec_id, CAST(label AS BIGINT) AS record, list_transform(u, lambda x: CAST(greatest(-127, least(127, floor(x / scale + 0.5))) AS DOUBLE)) AS v, CASE WHEN vec_id % 4 <> 0 THEN scale END AS scale FROM u),
  q AS (SELECT vec_id AS query_id, u AS q FROM u WHERE vec_id % 20 = 0),
  best AS (SELECT query_id, record, round(max(list_dot_product(q, v) * scale), 6) AS score, CAST(count(*) AS BIGINT) AS chunks, CAST(count(scale) AS BIGINT) AS embedded FROM q, i GROUP BY ALL)"""


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20, asked of all rows as stored: whole numbers and a scale."""
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.unit(F.col("embedding")).alias("u")).withColumn("scale", vectors.int8_scale(F.col("u")))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("u").alias("q"))
    stored = rows.select(F.col("label").cast("long").alias("record"), vectors.int8(F.col("u"), F.col("scale")).alias("values"), F.when(F.col("vec_id") % 4 != 0, F.col("scale")).alias("scale"))
    return ranking.vector_scan(asked, stored)


@query(_VECTOR + " SELECT * FROM best")
def vector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir)


@query(
    _VECTOR
    + """, v AS (SELECT query_id, record AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record DESC) - 1 AS v FROM best WHERE record % 5 <> 1),
  k AS (SELECT query_id, record AS id, row_number() OVER (PARTITION BY query_id ORDER BY chunks DESC, record) - 1 AS k FROM best WHERE record % 3 <> 0),
  head AS (SELECT query_id, id, k AS place FROM k WHERE query_id % 3 = 0 AND k < 2),
  k2 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY k) - 1 AS k FROM k ANTI JOIN head USING (query_id, id)),
  v2 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY v) - 1 AS v FROM v ANTI JOIN head USING (query_id, id)),
  b AS (SELECT query_id, id, k, v FROM k2 FULL JOIN v2 USING (query_id, id) WHERE k IS NOT NULL OR v < 10),
  f AS (SELECT *, round(coalesce(1 / (61 + k), 0.0) + 1 / (61 + coalesce(v, k)), 9) AS rrf FROM b),
  p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, k NULLS LAST, v NULLS LAST, id) - 1 AS pos FROM f)
  SELECT query_id, id, rrf, pos + CASE WHEN query_id % 3 = 0 THEN (SELECT count(*) FROM head h WHERE h.query_id = p.query_id) ELSE 0 END AS pos, k IS NULL AS meaning_only, v IS NOT NULL AND (k IS NULL OR k > pos) AS meaning FROM p
  UNION ALL SELECT query_id, id, NULL, place, false, false FROM head"""
)
def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _best(spark, sf_dir).withColumnRenamed("record", "id")
    v = best.where("id % 5 <> 1").select("query_id", "id", (F.row_number().over(ranking.per_query(F.desc("score"), F.desc("id"))) - 1).cast("long").alias("v"))
    k = best.where("id % 3 <> 0").select("query_id", "id", (F.row_number().over(ranking.per_query(F.desc("chunks"), F.col("id"))) - 1).cast("long").alias("k"))
    head = k.where("query_id % 3 = 0 and k < 2").select("query_id", "id", F.col("k").alias("place"))
    return ranking.fuse(k, v, head).select("query_id", "id", "rrf", "pos", "meaning_only", "meaning")


@query(
    """WITH c AS (SELECT label AS record, vec_id % 4 <> 0 AS has FROM embeddings)
  SELECT CAST(record AS BIGINT) AS record, count(*) AS chunks, count(CASE WHEN has THEN 1 END) AS embedded, CAST(floor(100.0 * count(CASE WHEN has THEN 1 END) / count(*)) AS BIGINT) AS percent FROM c GROUP BY record"""
)
def vector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("record"))
    rows = rows.agg(F.count("*").alias("chunks"), F.count_if(F.col("vec_id") % 4 != 0).alias("embedded"))
    return rows.withColumn("percent", F.floor(100 * F.col("embedded") / F.col("chunks")).cast("long"))


@query(
    r"""WITH sent AS (SELECT doc_id AS record, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents),
  s AS (SELECT 0 AS query_id, record, ordinal, -CAST(len(regexp_extract_all(strip_accents(lower(t)), '[\p{L}\p{N}]+')) AS DOUBLE) AS score FROM sent),
  b AS (SELECT *, row_number() OVER (PARTITION BY query_id, record ORDER BY score, ordinal) AS n FROM s)
  SELECT record, ordinal, score FROM b WHERE n = 1"""
)
def best_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "documents").select(F.lit(0).alias("query_id"), F.col("doc_id").alias("record"), F.posexplode(F.split("text", "\n")).alias("ordinal", "t"))
    rows = lines.select("query_id", "record", F.col("ordinal").cast("long").alias("ordinal"), (-F.size(text.tokens(F.col("t")))).cast("double").alias("score"))
    return ranking.best_passage(rows).select("record", "ordinal", "score")
