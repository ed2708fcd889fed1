"""Schemas of the library's tables, enumerations and limits."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Fixed values.
KINDS = ("evidence", "note", "preference", "constraint", "decision", "attempt", "question", "next_step", "reference", "checkpoint", "correction")
ATTRIBUTIONS = ("user_direction", "direct_observation", "agent_inference")
REVIEW_STATES = ("unreviewed", "accepted", "disputed", "retracted")
LIFECYCLES = ("active", "corrected", "superseded", "retracted", "forgotten")
RELATIONS = ("supported_by", "derived_from", "supersedes", "references", "related_to")
TAINTS = ("invalidated", "quarantined")
CHUNK_BYTES = 1000
QUERY_TERMS = 32
SEQUENCE = 500
DEPTH = 16

_DDL = {
    "records": "seq long, id string, kind string, title string, body string, workstream_id string, session_id string, source_id string, host string, attribution string, "
    "review_state string, freshness string, content_hash string, superseded_by string, created_at timestamp, lifecycle string",
    "links": "from_id string, to_id string, relation string, created_at timestamp",
    "taints": "record_id string, cause_id string, taint string, created_at timestamp",
    "lifecycle_events": "seq long, ledger_id string, record_id string, action string, replacement_id string, reason string, created_at timestamp",
    "import_events": "host string, transcript_id string, branch string, event_id string, content_hash string, record_id string, disposition string, seen_epoch long, created_at timestamp",
    "import_cursors": "host string, transcript_id string, path string, byte_offset long, anchor_hash string, file_size long, epoch long, state string, source_hash string",
    "chunks": "id string, record_id string, ordinal int, field string, text string, terms string, text_hash string",
    "chunk_vectors": "model string, text_hash string, `values` array<tinyint>, scale double",
    "call_log": "id long, at timestamp, session_id string, source string, name string, outcome string, query string, returned array<string>, bytes long, tokens long, empty boolean, ms double, stages map<string,double>",
    "call_reviews": "call_id long, rating string, note string, rated_at timestamp",
}

TABLES = tuple(_DDL)


def schema(name: str) -> StructType:
    """A table's schema; needs a session, which parses it."""
    return StructType.fromDDL(_DDL[name])
