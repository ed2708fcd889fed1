"""Sessions and transcripts that belong to one conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .upkeep import private_sessions


def session_transcripts(cursors: DataFrame, named: DataFrame) -> DataFrame:
    """(session, host, transcript): the edges between sessions and transcripts, by import or because the transcript's own
    tool output names the session. Both: session, host, transcript; each edge once, edges with a null end not at all."""
    cols = ["session", "host", "transcript"]
    return cursors.select(*cols).union(named.select(*cols)).dropna().distinct()


def conversation_sessions(asked: DataFrame, sessions: DataFrame, cursors: DataFrame, named: DataFrame, private_transcripts: DataFrame) -> DataFrame:
    """(session, linked): of each asked session itself and the sessions that share a transcript with it.

    sessions: session, host, host_session, private; asked: session. Private transcripts (host, transcript) are not
    crossed, and no private session is bridged in, by its own mark or that of another session of its host session. Each
    pair once. The work is asked edges times the sessions of their transcripts, which is the result; a transcript that
    very many sessions share is joined like any other key, which Spark splits where it is skewed.
    """
    edges = session_transcripts(cursors, named)
    open_ = edges.join(private_transcripts.select("host", "transcript").distinct(), ["host", "transcript"], "left_anti")
    mine = open_.join(asked.select("session").distinct(), "session", "left_semi")
    pairs = mine.join(open_.select("host", "transcript", F.col("session").alias("linked")), ["host", "transcript"]).where("session <> linked").select("session", "linked").distinct()
    known = sessions.select(F.col("session").alias("linked"))
    hidden = private_sessions(sessions).select(F.col("session").alias("linked"))
    pairs = pairs.join(known, "linked", "left_semi").join(hidden, "linked", "left_anti").select("session", "linked")
    return asked.select("session", F.col("session").alias("linked")).where("session is not null").distinct().union(pairs)


def session_neighbours(asked: DataFrame, records: DataFrame, linked: DataFrame, around: int) -> DataFrame:
    """(asked, seq, side, place): of each asked record up to `around` records of its conversation on either side, nearest
    first, by time and seq. asked, records: seq, session, created_at; linked: (session, linked) of the asked sessions. A
    record without a session has none; a record's other copies at one instant are told apart by seq."""
    mine = asked.select(F.col("seq").alias("asked"), "session", F.struct("created_at", "seq").alias("at")).where("session is not null")
    other = records.select("seq", F.col("session").alias("linked"), F.struct("created_at", "seq").alias("then"))
    rows = mine.join(linked, "session").join(other, "linked").where("at <> then")
    rows = rows.withColumn("side", F.when(F.col("then") < F.col("at"), "before").otherwise("after"))
    near = Window.partitionBy("asked", "side").orderBy(F.desc(F.when(F.col("side") == "before", F.col("then"))), F.col("then"))
    return rows.withColumn("place", F.row_number().over(near).cast("long")).where(F.col("place") <= around).select("asked", "seq", "side", "place")


def same_host_session(sessions: DataFrame) -> DataFrame:
    """(session, other): all sessions of a session's host session, itself included; one without a host session is alone."""
    by = sessions.select("session", "host", "host_session")
    pairs = by.join(by.select("host", "host_session", F.col("session").alias("other")), ["host", "host_session"]).select("session", "other")
    return pairs.union(sessions.select("session", F.col("session").alias("other"))).distinct()


def transcripts_of(host_sessions: DataFrame, sessions: DataFrame, cursors: DataFrame, named: DataFrame) -> DataFrame:
    """(host, host_session, transcript_host, transcript): the transcripts that belong to host sessions: the one of that
    id, those whose own tool output names one of its sessions, and what was imported into sessions of either (a
    sub-agent's transcript is imported into its parent's)."""
    key = ["host", "host_session"]
    asked = host_sessions.select(*key).dropna().distinct()
    own = asked.select(*key, F.col("host").alias("transcript_host"), F.col("host_session").alias("transcript"))
    of = asked.join(sessions.select(*key, "session"), key)
    by_name = of.join(named.select("session", F.col("host").alias("transcript_host"), "transcript"), "session").select(*own.columns)
    found = own.union(by_name).distinct()
    imported = cursors.join(sessions.select("session", F.col("host").alias("th"), F.col("host_session").alias("t")), "session").select("th", "t", F.col("host").alias("also_host"), F.col("transcript").alias("also"))
    more = found.join(imported, (F.col("transcript_host") == F.col("th")) & (F.col("transcript") == F.col("t"))).select(*key, F.col("also_host").alias("transcript_host"), F.col("also").alias("transcript"))
    return found.union(more).distinct()
