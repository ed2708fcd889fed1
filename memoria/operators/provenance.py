"""Where records come from: imports, echoes and citations, over one table of derived references."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def references(import_events: DataFrame) -> DataFrame:
    """(host, transcript, event_id, call_id, record): the records that echoes name, a row for each.

    import_events: host, transcript, branch, event_id, record, disposition, meta (JSON). Metas that are no JSON or name
    nothing give no row; a record named twice in one echo gives one."""
    meta = F.try_parse_json("meta")
    echo = import_events.where("disposition = 'echo'").select("host", "transcript", "event_id", F.try_variant_get(meta, "$.callId", "string").alias("call_id"), F.try_variant_get(meta, "$.references", "array<string>").alias("named"))
    return echo.withColumn("record", F.explode(F.array_distinct("named"))).drop("named").where("record is not null")


def echoes_naming(edges: DataFrame, records: DataFrame) -> DataFrame:
    """(host, transcript, event_id) of the echoes that name one of the records (id)."""
    return edges.join(records.select(F.col("id").alias("record")), "record", "left_semi").select("host", "transcript", "event_id").distinct()


def calls_echoing(edges: DataFrame, records: DataFrame, import_events: DataFrame) -> DataFrame:
    """(host, transcript, event_id) of the calls whose echo names one of the records: their description may quote it."""
    named = edges.join(records.select(F.col("id").alias("record")), "record", "left_semi").select("host", "transcript", "call_id").dropna().distinct()
    calls = import_events.where("disposition = 'tool_call'").withColumn("call_id", F.try_variant_get(F.try_parse_json("meta"), "$.callId", "string"))
    return calls.join(named, ["host", "transcript", "call_id"], "left_semi").select("host", "transcript", "event_id").distinct()


def imported_from(import_events: DataFrame, records: DataFrame) -> DataFrame:
    """(record, host, transcript, branch, event_id, observed_at, agent_type) of imported records: agent_type as the host
    recorded it, `subagent` on any other branch than main, else null. A record of several events has a row for each."""
    kind = F.try_parse_json("meta")
    told = F.when(F.schema_of_variant(F.try_variant_get(kind, "$.agentType", "variant")) == "STRING", F.try_variant_get(kind, "$.agentType", "string"))
    rows = import_events.where("record is not null").select("record", "host", "transcript", "branch", "event_id", F.coalesce(told, F.when(F.col("branch") != "main", "subagent")).alias("agent_type"))
    return rows.join(records.select(F.col("id").alias("record"), F.col("created_at").alias("observed_at")), "record").select("record", "host", "transcript", "branch", "event_id", "observed_at", "agent_type")


def agent_citations(links: DataFrame, records: DataFrame, sessions: DataFrame, import_events: DataFrame, since=None) -> DataFrame:
    """(record, at, session): what records that agents wrote, not imports, cite, when and in which host session.

    links: from_id, to_id, relation (supersedes is a change, not a citation); records: id, session, created_at; sessions:
    session, host_session. since: only what was written then or later."""
    written = records.join(import_events.where("record is not null").select(F.col("record").alias("id")), "id", "left_anti")
    if since is not None:
        written = written.where(F.col("created_at") >= since)
    by = written.join(sessions.select("session", "host_session"), "session", "left").select(F.col("id").alias("from_id"), F.col("created_at").alias("at"), F.coalesce("host_session", "session").alias("session"))
    return links.where("relation <> 'supersedes'").join(by, "from_id").select(F.col("to_id").alias("record"), "at", "session")
