"""Queries of small rules and of the sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rules
from ..sources import sinks, views
from .registry import query
from .upkeep import _CHUNKS

_CLAUSE = r"(?:^|[.!?;:]\s+|\n\s*)"
_LEAD = rf"(?:{_CLAUSE}|\b(?:please|you should|you must|we should|we must)\s+)"
_PROMPTS = """p AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'From now on, ' || text WHEN 1 THEN text || '. Never mind' WHEN 2 THEN text || '. never commit ' || lang WHEN 3 THEN '```' || chr(10) || 'from now on ' || text WHEN 4 THEN 'Did you remember to ' || text
    WHEN 5 THEN text || chr(10) || ' please remember to ' || lang WHEN 6 THEN 'it always fails ' || text WHEN 7 THEN 'you must ALWAYS ' || lang || text ELSE text END AS prompt FROM documents)"""


@query(
    rf"""WITH {_PROMPTS}, w AS (SELECT doc_id, regexp_replace(prompt, '(?s)```.*?(?:```|\z)', ' ', 'g') AS w FROM p)
  SELECT doc_id, regexp_matches(w, '(?i)\bfrom now on\b') OR regexp_matches(w, '(?i)\bgoing forward\b') OR regexp_matches(w, '(?i){_CLAUSE}in (?:the )?future\b') OR regexp_matches(w, '(?i)\bI(?: would|''d)? prefer\b') OR regexp_matches(w, '(?i){_CLAUSE}(?:please\s+)?remember to\b')
    OR regexp_matches(w, '(?i){_LEAD}always\s+\w') OR len(list_filter(regexp_extract_all(w, '(?i){_LEAD}never\s+(\w+)', 1), lambda n: lower(n) <> 'mind')) > 0 AS lasting FROM w WHERE w IS NOT NULL"""
)
def lasting_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t, lang = F.col("doc_id") % 9, F.col("text"), F.col("lang")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    prompt = (
        F.when(k == 0, join("From now on, ", t)).when(k == 1, join(t, ". Never mind")).when(k == 2, join(t, ". never commit ", lang)).when(k == 3, join("```\nfrom now on ", t)).when(k == 4, join("Did you remember to ", t))
        .when(k == 5, join(t, "\n please remember to ", lang)).when(k == 6, join("it always fails ", t)).when(k == 7, join("you must ALWAYS ", lang, t)).otherwise(t)
    )
    rows = views.table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt")).where("prompt is not null")
    return rows.select("doc_id", rules.states_lasting_preference(F.col("prompt")).alias("lasting"))


@query(
    """WITH c AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'memory_bootstrap' WHEN 1 THEN 'memory_recall' WHEN 2 THEN 'memory_manage' WHEN 3 THEN 'memory_record' ELSE 'memory_status' END AS name, event_id % 3 AS k FROM events)
  SELECT event_id, CASE name WHEN 'memory_bootstrap' THEN k <> 0 WHEN 'memory_recall' THEN true WHEN 'memory_status' THEN true WHEN 'memory_manage' THEN k = 1 ELSE false END AS read_only FROM c"""
)
def read_only_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    name = F.element_at(F.array(*map(F.lit, ("memory_bootstrap", "memory_recall", "memory_manage", "memory_record", "memory_status"))), (e % 5 + 1).cast("int"))
    args = F.when(e % 3 == 0, '{"importChoice":"all"}').when(e % 3 == 1, '{"action":"inspect"}').otherwise("{torn")
    return views.table(spark, sf_dir, "events").select("event_id", rules.read_only(name, args).alias("read_only"))


@query(
    """WITH s AS (SELECT doc_id, lang, source, replace(text, chr(10) || chr(10), ' ') AS status FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, lang AS goal, CASE WHEN length(status) <= 300 THEN status ELSE left(status, 299) || '…' END AS status, CASE WHEN doc_id % 3 <> 0 THEN source END AS next FROM s"""
)
def checkpoint_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints rendered from their parts and read back."""
    d = F.col("doc_id")
    none = F.array().cast("array<string>")
    rows = views.table(spark, sf_dir, "documents").where("text is not null")
    body = rules.render_checkpoint(
        F.col("lang"), F.replace("text", F.lit("\n\n"), F.lit(" ")), decisions=F.when(d % 2 == 0, F.array(F.lit("first"), F.lit("second"))).otherwise(none), nextSteps=F.when(d % 3 != 0, F.array("source", F.lit("later"))).otherwise(none),
        preferences=F.when(d % 5 == 0, F.array(F.lit("p"))).otherwise(none),
    )
    goal, status, after = rules.summarise_checkpoint(F.col("body"))
    return rows.select("doc_id", body.alias("body")).select("doc_id", goal.alias("goal"), status.alias("status"), after.alias("next"))


@query(
    """WITH w AS (SELECT c_custkey AS workstream, CASE c_custkey % 4 WHEN 0 THEN 'detached@' || c_nationkey WHEN 1 THEN NULL ELSE c_mktsegment END AS branch, c_mktsegment AS label, c_acctbal > 0 AS active, CASE WHEN c_custkey % 5 = 0 THEN 'task' END AS task_key FROM customer)
  SELECT coalesce(branch, label) AS branch, workstream FROM w WHERE active AND task_key IS NULL AND coalesce(branch, label) NOT LIKE 'detached@%' AND workstream NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)"""
)
def orphan_workstreams(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    branch = F.when(c % 4 == 0, F.concat(F.lit("detached@"), F.col("c_nationkey").cast("string"))).when(c % 4 != 1, F.col("c_mktsegment"))
    rows = views.table(spark, sf_dir, "customer").select(c.alias("workstream"), branch.alias("branch"), F.col("c_mktsegment").alias("label"), F.when(F.col("c_acctbal") > 0, "active").otherwise("closed").alias("lifecycle"), F.when(c % 5 == 0, "task").alias("task_key"))
    bindings = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("workstream"), F.col("o_orderkey").alias("worktree"))
    return rules.orphans_on_branch(rows, bindings, bindings.where("worktree % 3 = 0"), F.lit("t"))


@query(
    """WITH o AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'wst_' || md5(CAST(doc_id AS VARCHAR)) WHEN 1 THEN 'wst_' || md5(lang) || ',wst_' || md5(source) ELSE '' END AS named FROM documents)
  SELECT doc_id, named AS workstreams, CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS sessions FROM o"""
)
def bound_workstreams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workstreams and sessions that outputs name: whole JSON by its scope, clipped output by every field."""
    d = F.col("doc_id")
    field = lambda c: F.concat(F.lit('"workstreamId":"wst_'), F.md5(c.cast("string")), F.lit('"'))
    clipped = F.concat(field(F.col("lang")), F.lit(","), field(F.col("source")), F.lit(',"headRevision":3,"sessionId":"ses_'), F.md5("lang"), F.lit('","sessionId":"ses_'), F.md5("source"), F.lit('"'))
    output = F.when(d % 4 == 0, F.concat(F.lit('{"scope":{'), field(d), F.lit("}}"))).when(d % 4 == 1, clipped).when(d % 4 == 2, F.concat(F.lit('{"other":{'), field(d), F.lit("}}"))).otherwise(F.col("text"))
    rows = views.table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.coalesce(F.array_join(rules.bound_workstreams(output), ","), F.lit("")).alias("workstreams"), F.coalesce(F.size(rules.named_sessions(output)), F.lit(0)).alias("sessions"))


@query(
    f"""WITH {views.RECORDS}, {views.TAINTS}, {views.LINKS}, {_CHUNKS}, l AS (SELECT a.id AS from_id, b.id AS to_id, relation, b.lifecycle FROM links JOIN records a ON a.seq = from_seq JOIN records b ON b.seq = to_seq WHERE from_seq % 2 = 0 AND (a.workstream_id IS NULL OR b.workstream_id IS NULL OR a.workstream_id = b.workstream_id)),
  h AS (SELECT *, relation = 'derived_from' AS copy FROM l WHERE relation <> 'references'),
  t AS (SELECT from_id AS record, to_id AS cause, CASE WHEN copy THEN 'invalidated' ELSE 'quarantined' END AS taint FROM h WHERE lifecycle <> 'active' AND (copy OR lifecycle = 'retracted')
    UNION ALL SELECT from_id, cause_id, CASE WHEN copy THEN taint ELSE 'quarantined' END FROM h JOIN taints ON record_id = to_id)
  SELECT 'record' AS part, id AS key, '' AS value FROM records WHERE seq % 2 = 0 UNION ALL SELECT 'link', from_id, to_id FROM l UNION ALL SELECT 'chunk', CAST(record AS VARCHAR), text_hash FROM chunks WHERE record % 2 = 0
  UNION ALL SELECT 'taint', record, cause || ' ' || min(taint) FROM t GROUP BY record, cause"""
)
def record_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second record appended with its links, chunks and inherited taints, twice under one name."""
    records = views.records(spark, sf_dir)
    d = F.col("doc_id")
    name = d.cast("string")
    ref = lambda locator, path: F.struct(locator.alias("locator"), path.alias("path"))
    refs = views.table(spark, sf_dir, "documents").select(d.alias("seq"), F.when(d % 3 == 0, F.array(ref(F.concat(F.lit("doc/"), name), F.concat(F.lit("src/f"), name, F.lit(".py"))), ref(F.col("lang"), F.lit(None).cast("string")))).alias("refs"))
    new = records.where("seq % 2 = 0").join(refs, "seq").select("id", "seq", "kind", F.concat(F.lit("record "), "seq", F.lit(" of "), "host").alias("title"), "body", "workstream_id", "refs", F.lit("{}").alias("applicability"))
    ids = lambda c: F.concat(F.lit("rec_"), F.col(c))
    links = views.links(spark, sf_dir).select(ids("from_seq").alias("from_id"), ids("to_seq").alias("to_id"), "relation")
    taints = views.taints(spark, sf_dir).select(F.col("record_id").alias("record"), F.col("cause_id").alias("cause"), "taint")
    path = f"{views.shared_dir(spark)}/store-{uuid.uuid4().hex}"
    for _ in range(2):
        sinks.append_records(spark, path, "first", new, links, records, taints, inherit=True)
    read = lambda name, ddl: sinks.read(spark, path, name, ddl)
    row = lambda df, part, key, value: df.select(F.lit(part).alias("part"), key.alias("key"), value.alias("value"))
    return (
        row(read("records", "id string"), "record", F.col("id"), F.lit("")).union(row(read("links", "from_id string, to_id string"), "link", F.col("from_id"), F.col("to_id")))
        .union(row(read("chunks", "record long, text_hash string"), "chunk", F.col("record").cast("string"), F.col("text_hash"))).union(row(read("taints", "record string, cause string, taint string"), "taint", F.col("record"), F.concat_ws(" ", "cause", "taint")))
    )


@query(
    """WITH e AS (SELECT event_id, user_id % 7 = 0 AS private, event_id % 3 AS k, value FROM events)
  SELECT event_id, CASE WHEN NOT private AND k = 0 THEN 'q' || event_id END AS query, CASE WHEN private THEN '' WHEN k = 0 THEN 'maxBytes=5' WHEN k = 1 THEN 'kind="note",textBytes=3' ELSE 'action="forget"' END AS params,
    CASE WHEN private THEN '' WHEN k = 0 THEN 'a,b' WHEN k = 1 THEN 'rec_1' ELSE 'rec_2,rec_3' END AS returned, CAST(ceil(event_id / 4.0) AS BIGINT) AS tokens, CASE WHEN NOT private AND k = 0 THEN event_id % 2 = 0 END AS empty, NOT private AND k = 0 AS continues, CASE WHEN private THEN 'private' END AS erased FROM e"""
)
def call_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    k = e % 3
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    name = F.when(k == 0, "memory_recall").when(k == 1, "memory_record").otherwise("memory_manage")
    args = F.when(k == 0, text('{"query":"q', e, '","maxBytes":5,"secret":1}')).when(k == 1, F.lit('{"kind":"note","body":"é1"}')).otherwise(F.lit('{"action":"forget","recordId":"rec_2","recordIds":["rec_3"]}'))
    result = F.when(k == 0, text('{"empty":', e % 2 == 0, ',"continuation":"c"}')).when(k == 1, F.lit('{"recordId":"rec_1"}'))
    calls = views.table(spark, sf_dir, "events").select("event_id", name.alias("name"), args.alias("args"), result.alias("result"), F.array(F.lit("a"), F.lit("b")).alias("returned"), e.alias("bytes"), (F.col("user_id") % 7 == 0).alias("private"))
    rows = sinks.described_calls(calls)
    params = F.array_join(F.array_sort(F.transform(F.map_entries("params"), lambda p: F.concat(p["key"], F.lit("="), p["value"]))), ",")
    return rows.select("event_id", "query", params.alias("params"), F.array_join("returned", ",").alias("returned"), "tokens", "empty", "continues", "erased")
