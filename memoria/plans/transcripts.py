"""Queries over transcripts: lines with offsets, events of both hosts, commands that read files."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import shell
from ..operators import transcripts
from ..sources import jsonl, views
from .registry import query

_BUCKETS = 8
_LINES = f"""l AS (SELECT conv_id % {_BUCKETS} AS bucket, conv_id, turn, conv_id || ' ' || turn || ' ' || role || ' ' || replace(coalesce(text, ''), chr(10), chr(13)) AS line FROM conversations),
  o AS (SELECT bucket, line, sum(strlen(line) + 1) OVER (PARTITION BY bucket ORDER BY conv_id, turn, line ROWS UNBOUNDED PRECEDING) AS e, row_number() OVER (PARTITION BY bucket ORDER BY conv_id, turn, line) AS n FROM l)"""


def _files(spark: SparkSession, sf_dir: str) -> dict[int, str]:
    """The conversations as a text file for each bucket, written to the shared folder: bucket -> path."""
    rows = views.table(spark, sf_dir, "conversations")
    line = F.concat_ws(" ", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", F.translate(F.coalesce("text", F.lit("")), "\n", "\r"))
    rows = rows.select((F.col("conv_id") % _BUCKETS).alias("bucket"), "conv_id", "turn", line.alias("value")).repartition("bucket").sortWithinPartitions("bucket", "conv_id", "turn", "value")
    path = f"{views.shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    rows.select("bucket", "value").write.partitionBy("bucket").text(path)
    store, inner = jsonl.filesystem(path)
    found = store.get_file_info(pafs.FileSelector(inner, recursive=True))
    prefix = path[: -len(inner)] if path.endswith(inner) else "file://"
    return {int(f.path.split("bucket=")[1].split("/")[0]): prefix + f.path for f in found if f.path.endswith(".txt")}


def _bucket() -> Column:
    return F.regexp_extract("path", r"bucket=(\d+)", 1).cast("long")


@query(f"WITH {_LINES} SELECT bucket, CAST(e - strlen(line) - 1 AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\", sha256(line) AS line_sha256 FROM o")
def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the files with its byte offsets, read in ranges of 64 KB."""
    rows = jsonl.read_lines(spark, sorted(_files(spark, sf_dir).values()), split=64 << 10)
    return rows.select(_bucket().alias("bucket"), "start", "end", F.sha2(F.col("text").cast("binary"), 256).alias("line_sha256"))


@query(f"WITH {_LINES}, c AS (SELECT bucket, max(e) AS since FROM o WHERE n <= bucket + 3 GROUP BY bucket) SELECT bucket, CAST(e - strlen(line) - 1 AS BIGINT) AS start, sha256(line) AS line_sha256 FROM o JOIN c USING (bucket) WHERE e > since")
def resumed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each file after its first lines, from a cursor on."""
    files = _files(spark, sf_dir)
    first = jsonl.read_lines(spark, sorted(files.values())).withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("start")))
    since = {r.path: r.since for r in first.where(F.col("n") <= _bucket() + 3).groupBy("path").agg(F.max("end").alias("since")).collect()}
    rows = jsonl.read_lines(spark, sorted(files.values()), since, split=64 << 10)
    return rows.select(_bucket().alias("bucket"), "start", F.sha2(F.col("text").cast("binary"), 256).alias("line_sha256"))


def _lines(rows: DataFrame, *order: str) -> DataFrame:
    """Lines of each conversation with offsets: (transcript, start, end, text)."""
    upto = Window.partitionBy("transcript").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.octet_length("line") + 1).over(upto).cast("long"))
    return rows.select("transcript", (F.col("end") - F.octet_length("line") - 1).cast("long").alias("start"), "end", F.col("line").alias("text"))


def _json(**fields) -> Column:
    return F.to_json(F.struct(*((F.lit(v) if isinstance(v, (str, bool, int)) else v).alias(k) for k, v in fields.items())))


_TURNS = r"""t AS (SELECT conv_id, turn, coalesce(text, '') AS text, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS said, (conv_id + turn) % 6 AS k, conv_id || '-' || turn AS uuid FROM conversations)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("transcript"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("k", (F.col("transcript") + F.col("turn")) % 6).withColumn("uuid", F.concat_ws("-", F.col("transcript").cast("string"), F.col("turn").cast("string")))


@query(
    f"""WITH {_TURNS}, s AS (SELECT conv_id, min(turn) AS stop FROM t WHERE conv_id % 7 = 3 AND turn >= 3 AND k IN (0, 1, 2, 5) GROUP BY conv_id), live AS (SELECT t.* FROM t LEFT JOIN s USING (conv_id) WHERE stop IS NULL OR turn < stop)
  SELECT conv_id AS transcript, uuid AS event_id, 'message' AS type, 'user' AS role, NULL AS call_id, NULL AS summary, NULL AS tool_kind, NULL AS first_path, sha256(said) AS text_sha256 FROM live WHERE k = 0 AND said <> ''
  UNION ALL SELECT conv_id, uuid || '#1', 'message', 'assistant', NULL, NULL, NULL, NULL, sha256(said) FROM live WHERE k = 1 AND said <> ''
  UNION ALL SELECT conv_id, uuid || '#2', 'tool_call', NULL, 'c' || uuid, '$ cat d/f' || turn || '.txt', 'artifact_access', '/w/d/f' || turn || '.txt', NULL FROM live WHERE k = 1
  UNION ALL SELECT conv_id, uuid, 'tool_result', NULL, 'c' || uuid, NULL, NULL, NULL, sha256(text) FROM live WHERE k = 2"""
)
def host_a_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as the first host does, and read back to events; some transcripts stop at a later version."""
    rows = _turns(spark, sf_dir)
    version = F.when((F.col("transcript") % 7 == 3) & (F.col("turn") >= 3), "3.0.0").otherwise("2.1.200")
    head = {"uuid": F.col("uuid"), "timestamp": "2026-01-01T00:00:00Z", "cwd": "/w", "version": version}
    said = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<command:string>").alias("input"))
    thought = said.withField("type", F.lit("thinking"))
    command = F.concat(F.lit("cat d/f"), F.col("turn").cast("string"), F.lit(".txt"))
    call = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("c"), "uuid").alias("id"), F.lit("Bash").alias("name"), F.struct(command.alias("command")).alias("input"))
    result = F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("c"), "uuid").alias("tool_use_id"), F.col("text").alias("content"))
    content = lambda c: F.struct(c.alias("content"))
    line = (
        F.when(F.col("k") == 0, _json(type="user", **head, message=content(F.col("text")))).when(F.col("k") == 1, _json(type="assistant", **head, message=content(F.array(thought, said, call))))
        .when(F.col("k") == 2, _json(type="user", **head, message=content(F.array(result)))).when(F.col("k") == 3, F.lit('{"type":"summary"}')).when(F.col("k") == 4, F.lit('{"torn'))
        .otherwise(_json(type="user", isMeta=True, **head, message=content(F.col("text"))))
    )
    events, _, _ = transcripts.a_events(_lines(rows.withColumn("line", line), "turn", "line"))
    return events.select("transcript", "event_id", "type", "role", "call_id", "summary", "tool_kind", F.try_element_at("paths", F.lit(1)).alias("first_path"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query(
    f"""WITH {_TURNS}, s AS (SELECT conv_id, min(turn) AS stop FROM t WHERE conv_id % 7 = 5 AND turn >= 4 GROUP BY conv_id),
  live AS (SELECT t.* FROM t LEFT JOIN s USING (conv_id) WHERE conv_id % 7 <> 3 AND (stop IS NULL OR turn < stop)),
  c AS (SELECT *, coalesce(last_value(CASE WHEN k = 2 THEN '/w/' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '/w') AS cwd FROM live)
  SELECT conv_id AS transcript, 't' || turn AS observed_at, cwd, 'message' AS type, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END AS role, NULL AS summary, NULL AS first_path, NULL AS is_error, sha256(said) AS text_sha256 FROM c WHERE k IN (0, 1) AND said <> ''
  UNION ALL SELECT conv_id, 't' || turn, cwd, 'tool_call', NULL, '$ sed -n ''1,5p'' f', cwd || '/f', NULL, NULL FROM c WHERE k = 3
  UNION ALL SELECT conv_id, 't' || turn, cwd, 'tool_result', NULL, NULL, NULL, turn % 2 = 1, sha256(text) FROM c WHERE k = 4"""
)
def host_b_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as the second host does: a head line, folders that hold on, outputs with an exit code."""
    rows = _turns(spark, sf_dir)
    version = F.when(F.col("transcript") % 7 == 3, "0.1.0").otherwise("0.130.0")
    heads = rows.select("transcript").distinct().withColumn("turn", F.lit(-1).cast("long"))
    heads = heads.withColumn("line", _json(timestamp="t", type="session_meta", payload=F.struct(F.concat(F.lit("T"), F.col("transcript").cast("string")).alias("id"), F.lit("/w").alias("cwd"), version.alias("cli_version"))))
    time = F.concat(F.lit("t"), F.col("turn").cast("string"))
    part = lambda kind, **fields: _json(timestamp=time, type=kind, payload=F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items())))
    ordinal = (F.col("transcript") % 7 == 5) & (F.col("turn") >= 4)
    output = F.concat(F.lit("Wall time: 1 s\nProcess exited with code "), (F.col("turn") % 2).cast("string"), F.lit("\nOutput:\n"), "text")
    line = (
        F.when(F.col("k") == 0, part("event_msg", type="user_message", message=F.col("text"))).when(F.col("k") == 1, part("event_msg", type="agent_message", message=F.col("text")))
        .when(F.col("k") == 2, part("turn_context", cwd=F.concat(F.lit("/w/"), F.col("turn").cast("string"))))
        .when(F.col("k") == 3, part("response_item", type="function_call", name="exec_command", call_id=F.col("uuid"), arguments=F.lit('{"cmd":"sed -n \'1,5p\' f"}')))
        .when(F.col("k") == 4, part("response_item", type="function_call_output", call_id=F.col("uuid"), output=output)).otherwise(part("response_item", type="reasoning"))
    )
    rows = rows.withColumn("line", line)
    rows = rows.withColumn("line", F.when(ordinal, F.concat(F.substring("line", F.lit(1), F.length("line") - 1), F.lit(',"ordinal":1}'))).otherwise(F.col("line")))
    events, _, _ = transcripts.b_events(_lines(heads.unionByName(rows.select("transcript", "turn", "line")), "turn", "line"))
    return events.select("transcript", "observed_at", "cwd", "type", "role", "summary", F.try_element_at("paths", F.lit(1)).alias("first_path"), "is_error", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query(
    """WITH c AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey % 6 AS k, l_partkey AS p FROM lineitem)
  SELECT id, n, CASE k WHEN 0 THEN '/w/p' || p WHEN 1 THEN '/w/d/p' || p WHEN 2 THEN '/w/p' || p END AS first_path, CASE WHEN k <= 2 THEN 'artifact_access' ELSE 'other' END AS tool_kind,
    CASE k WHEN 0 THEN 'plain' WHEN 1 THEN 'numbered' END AS format, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 END AS first_line, CASE k WHEN 0 THEN p + 2 WHEN 1 THEN 7 END AS last_line FROM c"""
)
def shell_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that repeat few commands: which of them only read files, and which lines of which."""
    p = F.col("l_partkey")
    key = p.cast("string")
    command = (
        F.when(p % 6 == 0, F.concat(F.lit("sed -n '2,"), (p + 2).cast("string"), F.lit("p' p"), key)).when(p % 6 == 1, F.concat(F.lit("cd d && nl -ba p"), key, F.lit(" | head -7")))
        .when(p % 6 == 2, F.concat(F.lit("bash -lc 'tail -n 3 p"), key, F.lit("'"))).when(p % 6 == 3, F.concat(F.lit("cat p"), key, F.lit(" > out"))).when(p % 6 == 4, F.concat(F.lit("cat ../p"), key)).otherwise(F.concat(F.lit("grep x p"), key))
    )
    calls = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), command.alias("command"), F.lit("/w").alias("cwd"))
    rows = shell.shell_reads(calls)
    return rows.select("id", "n", F.try_element_at("paths", F.lit(1)).alias("first_path"), "tool_kind", F.col("read.format").alias("format"), F.col("read.first").alias("first_line"), F.col("read.last").alias("last_line"))
