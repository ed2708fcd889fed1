"""Chunks and their vectors, private sessions, observations and their copies, counters, changes and ordered reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text

#: What a bit of a record's reasons says.
REASONS = {"phrase": 1, "window": 2, "newest": 4, "trust": 8, "meaning": 16, "meaning_only": 32}


def chunks(records: DataFrame, pieces: Callable[[Column], Column] = text.split_text, gaps: bool = False) -> DataFrame:
    """(record, ordinal, field, text, terms, text_hash): a record's title, its body in pieces of at most 1000 bytes cut at
    white space, and the places that its references name (refs, an array of locator and path; optional), if any. terms:
    the words within the chunk's identifiers. Null and empty titles and bodies give no chunk. pieces: how a body is cut;
    gaps: whether a null title and a null or empty body take their places all the same, as chunks of nulls.

    Every row is cut where it lies; nothing is shuffled."""
    if "refs" not in records.columns:
        records = records.withColumn("refs", F.lit(None).cast("array<struct<locator: string, path: string>>"))
    rows = records.withColumn("pieces_", pieces(F.col("body")))
    one = lambda field, t: F.when(t != "", F.array(F.struct(F.lit(field).alias("field"), t.alias("text"))))
    named = F.array_join(F.transform("refs", lambda r: F.concat_ws(" ", F.when(r["locator"] != "", r["locator"]), F.when(r["path"] != "", r["path"]))), "\n")
    none = F.array().cast("array<struct<field: string, text: string>>")
    title = one("title", F.col("title"))
    bodies = F.transform("pieces_", lambda t: F.struct(F.lit("body").alias("field"), t.alias("text")))
    if gaps:
        gap = F.array(F.lit(None).cast("struct<field: string, text: string>"))
        title, bodies = F.when(F.col("title").isNull(), gap).otherwise(title), F.when(F.col("body") != "", bodies).otherwise(gap)
    made = F.concat(*(F.coalesce(c, none) for c in (title, bodies, one("refs", named))))
    rows = rows.select(F.col("seq").alias("record"), F.posexplode(made).alias("ordinal", "c"))
    return rows.select("record", F.col("ordinal").cast("long").alias("ordinal"), "c.field", "c.text", text.identifier_terms(F.col("c.text")).alias("terms"), F.sha2(F.col("c.text").cast("binary"), 256).alias("text_hash"))


def each_with_each(records: DataFrame) -> DataFrame:
    """The records (seq, body and others); where several have one seq, each of them with each of their bodies that is not
    empty, if any. Only rows of such a seq are shuffled; its numbers are sent to every task."""
    several = F.broadcast(records.groupBy("seq").count().where("count > 1").select("seq"))
    alone, again = (records.join(several, "seq", how) for how in ("left_anti", "left_semi"))
    return alone.unionByName(again.drop("body").join(again.where("body <> ''").select("seq", "body"), "seq", "left"))


def missing_chunks(chunks: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """(record, ordinal, text_hash) of texts without a vector, each once where it is newest, newest first."""
    rows = chunks.join(vectors.select("text_hash"), "text_hash", "left_anti")
    newest = rows.groupBy("text_hash").agg(F.max(F.struct("record", "ordinal")).alias("c")).select("c.record", "c.ordinal", "text_hash")
    return newest.orderBy(F.desc("record"), F.desc("ordinal"), "text_hash").limit(limit)


def orphan_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    return vectors.join(chunks.select("text_hash"), "text_hash", "left_anti")


def storable_vectors(new: DataFrame, vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """New vectors of texts that a chunk still has and that have none yet."""
    return new.dropDuplicates(["text_hash"]).join(chunks.select("text_hash"), "text_hash", "left_semi").join(vectors.select("text_hash"), "text_hash", "left_anti")


def best_chunk(chunks: DataFrame, score: Column) -> DataFrame:
    """(record, text): of each record's body chunks the best scored, the earliest of ties."""
    return chunks.where("field = 'body'").groupBy("record").agg(F.min_by("text", F.struct(score, "ordinal")).alias("text"))


def candidates(wanted: DataFrame, records: DataFrame, best: DataFrame) -> DataFrame:
    """The records of an ordered list (place, seq), in its order, with their best passage where they have one."""
    rows = records.join(F.broadcast(wanted), "seq")
    return rows.join(best.select(F.col("record").alias("seq"), "text"), "seq", "left")


def private_sessions(sessions: DataFrame) -> DataFrame:
    """The sessions that are private, by their own mark or that of a session of the same host session."""
    marked = sessions.where("private and host_session is not null").select("host", "host_session").distinct().withColumn("sibling", F.lit(True))
    rows = sessions.join(marked, ["host", "host_session"], "left")
    return rows.where(F.col("private") | F.coalesce("sibling", F.lit(False))).select("session", "host", "host_session")


def blanked(calls: DataFrame, private: DataFrame, columns: list[str]) -> DataFrame:
    """The calls; those of private sessions without the given columns' values."""
    mark = private.select(F.col("session").alias("blank_"))
    rows = calls.join(mark, F.col("session_id") == F.col("blank_"), "left")
    return rows.withColumns({c: F.when(F.col("blank_").isNull(), F.col(c)) for c in columns}).drop("blank_")


def same_observation(events: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, copy): the records that other transcripts' copies of a target's host event made."""
    t = targets.select(F.col("record").alias("target"), "host", "event_id")
    return events.join(t, ["host", "event_id"]).where("record <> target").select("target", F.col("record").alias("copy")).distinct()


def left_to_forget(records: DataFrame, sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """Records written by one of the sessions or imported from one of the sources, each once."""
    by = records.join(sessions, "session_id", "left_semi").select("seq")
    return by.union(records.join(sources, "source_id", "left_semi").select("seq")).distinct()


def calls_returning(calls: DataFrame, gone: DataFrame) -> DataFrame:
    """Calls of whose returned records, a JSON list, one is gone."""
    rows = calls.select("id", F.explode(F.from_json("returned", "array<long>")).alias("seq"))
    return rows.join(gone.select("seq"), "seq", "left_semi").select("id").distinct()


def late_summaries(summaries: DataFrame, tainted: DataFrame) -> DataFrame:
    """(seq, cause): host summaries written at or after a tainted record of their source, with the first such record. The
    tainted shrink to one a source before they meet."""
    first = tainted.groupBy("source_id").agg(F.min(F.struct("created_at", "seq")).alias("first"))
    rows = summaries.join(first, "source_id").where(F.col("created_at") >= F.col("first.created_at"))
    return rows.where(F.col("seq") != F.col("first.seq")).select("seq", F.col("first.seq").alias("cause"))


def captured(links: DataFrame, records: DataFrame, said: Column) -> DataFrame:
    """(claim, evidence): supported_by links whose evidence was observed directly and holds what the claim says, white
    space aside."""
    squash = lambda c: F.regexp_replace(c, r"\s+", "")
    claim = records.select(F.col("seq").alias("from_seq"), squash(said).alias("said"))
    held = records.where("attribution = 'direct_observation'").select(F.col("seq").alias("to_seq"), squash(F.col("body")).alias("held"))
    rows = links.where("relation = 'supported_by'").join(claim, "from_seq").join(held, "to_seq")
    return rows.where(F.contains("held", F.col("said"))).select(F.col("from_seq").alias("claim"), F.col("to_seq").alias("evidence"))


def merge_counters(counters: DataFrame, by: list[str], snapshot: list[str]) -> DataFrame:
    """Counters (by, pass, name, n) of several passes as one: sums, but for names of which the last pass's stands."""
    last = F.max(F.struct("pass", "n"))["n"]
    return counters.groupBy(*by, "name").agg(F.when(F.col("name").isin(snapshot), last).otherwise(F.sum("n")).alias("n"))


def merged_usage(usage: DataFrame) -> DataFrame:
    """Reports of several workspaces as one."""
    return usage.agg(F.count("*").alias("sessions"), F.count_if(F.col("searches") > 0).alias("searched"), F.sum("searches").alias("searches"), F.sum("empty").alias("empty"), F.round(F.sum("ms"), 3).alias("ms"))


def changes_since(events: DataFrame, watermark: int, most: int = 5) -> DataFrame:
    """(workstream_id, seq, record, omitted): each workstream's first changes after the watermark, and how many more
    there are."""
    return latest(events.where(F.col("seq") > watermark), "workstream_id", [F.col("seq")], most).select("workstream_id", "seq", "record", "omitted")


def latest(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group, with their place, and how many more the group has."""
    total = rows.groupBy(F.col(by).alias("total_of")).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("omitted"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("place") <= most)
    return rows.join(total, F.col(by).eqNullSafe(F.col("total_of"))).drop("total_of")


def within_bytes(rows: DataFrame, by: str, size: Column, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group that together take at most so many bytes."""
    return rows.withColumn("bytes", F.sum(size).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("bytes") <= most)


def sample(rows: DataFrame, by: str, key: Column, seed: str, most: int = 10) -> DataFrame:
    """At most so many rows of each group, drawn by a seeded hash."""
    drawn = F.sha2(F.concat(key.cast("string"), F.lit(f":{seed}")), 256)
    return rows.withColumn("drawn", F.row_number().over(Window.partitionBy(by).orderBy(drawn))).where(F.col("drawn") <= most).drop("drawn")


def shown_before(lines: DataFrame) -> DataFrame:
    """Adds shown: how many different records a branch has been shown up to each line. A record counts where it first
    comes, so a running sum does what a set of all would."""
    first = F.row_number().over(Window.partitionBy("branch", "record").orderBy("line")) == 1
    w = Window.partitionBy("branch").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("first", first & F.col("record").isNotNull()).withColumn("shown", F.sum(F.col("first").cast("long")).over(w)).drop("first")


def upsert_taints(taints: DataFrame, new: DataFrame) -> DataFrame:
    """One taint for each record and cause: of those that meet, the stronger (lower) label."""
    return taints.unionByName(new).groupBy("record", "cause").agg(F.min("label").alias("label"))


def restored_taints(taints: DataFrame, restored: DataFrame) -> DataFrame:
    """The taints without those that restored records caused."""
    return taints.join(restored.select(F.col("record").alias("cause")), "cause", "left_anti")


def related(links: DataFrame, events: DataFrame) -> DataFrame:
    """(record, role, other): what an inspection shows beside a record, each once."""
    by = lambda relation, role, a, b: links.where(F.col("relation") == relation).select(F.col(a).alias("record"), F.lit(role).alias("role"), F.col(b).alias("other"))
    rows = by("supported_by", "evidence", "from_seq", "to_seq").union(by("derived_from", "derived", "to_seq", "from_seq")).union(by("references", "reference", "from_seq", "to_seq"))
    return rows.union(events.where("replacement is not null").select("record", F.lit("replacement"), "replacement")).distinct()


def reasons(flags: dict[str, Column]) -> Column:
    """The bits of the reasons that hold."""
    out = F.lit(0)
    for name, holds in flags.items():
        out = out.bitwiseOR(F.when(holds, REASONS[name]).otherwise(0))
    return out


def version_key(version: Column) -> Column:
    """A version's numbers, so that arrays compare as versions do; a pre-release comes before its release."""
    numbers = F.transform(F.split(F.regexp_extract(version, r"^(\d+\.\d+\.\d+)", 1), r"\."), lambda n: n.try_cast("int"))
    return F.concat(numbers, F.array(F.when(version.contains("-"), 0).otherwise(1)))


def within_versions(version: Column, low: str, below: str) -> Column:
    return (version_key(version) >= version_key(F.lit(low))) & (version_key(version) < version_key(F.lit(below)))


def relative_path(root: Column, path: Column) -> Column:
    """A path from the root of a worktree on; null where it lies outside."""
    return F.when(path == root, ".").when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path)))


def result_title(title: Column) -> tuple[Column, Column, Column]:
    """Tool, error mark and summary of `tool[ (error)]: summary`; null where a title is none."""
    pattern = r"(?s)^(\S+?)( \(error\))?: (.*)$"
    ok = title.rlike(pattern)
    return F.when(ok, F.regexp_extract(title, pattern, 1)), F.when(ok, F.regexp_extract(title, pattern, 2) != ""), F.when(ok, F.regexp_extract(title, pattern, 3))


def best_by_record(hits: DataFrame, record: Column) -> DataFrame:
    """(query_id, seq, score): each record's best chunk."""
    return hits.groupBy("query_id", record.alias("seq")).agg(F.min("score").alias("score"))
