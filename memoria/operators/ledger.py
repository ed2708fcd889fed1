"""Replaying the ledger: ordered changes and their effects on every table that holds what a record said."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.schemas import DEPTH
from .lineage import TRANSITIONS, WRONG, unapplied

#: What stands in place of a forgotten record's words.
FORGOTTEN_HASH, FORGOTTEN_REASON, REPLAYED = "forgotten", "[forgotten]", "replayed from the ledger"


@dataclass(frozen=True)
class Store:
    """The tables that a change touches.

    records: seq, title, body, content_hash, workstream_id, lifecycle, superseded_by, retracted_at; events: record, host,
    event_id; links: from_seq, to_seq, relation; chunks: record, ordinal, text, text_hash; vectors: model, text_hash;
    calls: id, query, returned (array of seq); taints: record, cause, taint; suppressions: host, event_id, cause;
    lifecycle_events: ledger_id, seq, record, action, reason. More columns may be there and stay."""

    records: DataFrame
    events: DataFrame
    links: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    calls: DataFrame
    taints: DataFrame
    suppressions: DataFrame
    lifecycle_events: DataFrame


def observations(records: DataFrame, events: DataFrame) -> DataFrame:
    """(seq, observation): records imported from one host event are copies of one observation; any other is its own."""
    event = events.where("host is not null and event_id is not null").groupBy(F.col("record").alias("seq")).agg(F.min(F.struct("host", "event_id")).alias("e"))
    rows = records.select("seq").join(event, "seq", "left")
    return rows.select("seq", F.when(F.col("e").isNotNull(), F.to_json("e")).otherwise(F.concat(F.lit("record "), F.col("seq").cast("string"))).alias("observation"))


def _moved(state: Column, action: Column) -> Column:
    """The state after an action, as it was where the action does not apply."""
    return F.coalesce(*(F.when((action == a) & (state == old), F.lit(new)) for a, old, new in TRANSITIONS), state)


def _settled(entries: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """(entries with their observation and whether they apply, records' observations).

    An observation's entries are folded in order over the states of the records that they name; an entry applies where
    its record's state allows it, and then changes every copy that allows it. A restore applies only if the newest change
    before it is a retraction. A fold holds an observation's entries and the records named in them, not its copies."""
    of = observations(store.records, store.events)
    targets = entries.join(of.select(F.col("seq").alias("of_seq"), "observation"), F.col("record") == F.col("of_seq"), "left").drop("of_seq")
    state = store.records.select(F.col("seq").alias("record"), F.col("lifecycle").alias("start"))
    named = targets.where("observation is not null").join(state, "record", "left")
    before = store.lifecycle_events.select("record", F.struct("seq", "action").alias("e")).join(of.select(F.col("seq").alias("record"), "observation"), "record")
    last = before.groupBy("observation").agg(F.max("e").alias("e")).select("observation", F.col("e.action").alias("last"))
    groups = named.groupBy("observation").agg(
        F.array_sort(F.collect_list(F.struct("seq", "ledger_id", "record", "action"))).alias("todo"), F.map_from_entries(F.collect_set(F.struct(F.col("record").alias("key"), F.col("start").alias("value")))).alias("states")
    )
    groups = groups.join(last, "observation", "left")
    start = F.struct("states", F.coalesce("last", F.lit("")).alias("last"), F.array().cast("array<struct<ledger_id: string, ok: boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        now = F.element_at(acc["states"], x["record"])
        ok = (_moved(now, x["action"]) != now) & ((x["action"] != "restore") | (acc["last"] == "retract"))
        states = F.when(ok, F.transform_values(acc["states"], lambda _, s: _moved(s, x["action"]))).otherwise(acc["states"])
        # A change that does not apply is still written down as the newest one.
        return F.struct(states.alias("states"), x["action"].alias("last"), F.concat(acc["out"], F.array(F.struct(x["ledger_id"].cast("string").alias("ledger_id"), ok.alias("ok")))).alias("out"))

    folded = groups.select(F.explode(F.aggregate("todo", start, step, lambda acc: acc["out"])).alias("o")).select(F.col("o.ledger_id").alias("done"), F.col("o.ok").alias("ok"))
    rows = targets.join(folded, F.col("ledger_id").cast("string") == F.col("done"), "left").drop("done")
    return rows.withColumn("ok", F.coalesce("ok", F.lit(False))), of


def _dependents(causes: DataFrame, links: DataFrame, exclude: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(record, cause, taint) of what rests on a change's records, as lineage.taint_closure, but for each cause apart.
    causes: cause, seq, wrong, in which one cause may have several copies; exclude: (cause, seq) that it does not taint."""
    edges = links.where(F.col("relation").isin("derived_from", "supported_by")).select(F.col("from_seq").alias("child"), F.col("to_seq").alias("on"), (F.col("relation") == "derived_from").alias("derived")).checkpoint()
    frontier = causes.select("cause", "seq", F.lit(0).alias("label"), F.col("wrong").alias("spreads"))
    levels: list[DataFrame] = []
    for _ in range(depth):
        hit = frontier.join(edges, F.col("seq") == F.col("on")).where(F.col("derived") | F.col("spreads"))
        hit = hit.groupBy("cause", F.col("child").alias("seq")).agg(F.min(F.when(F.col("derived"), F.col("label")).otherwise(1)).alias("label"))
        hit = hit.join(exclude, ["cause", "seq"], "left_anti")
        if levels:
            known = levels[0]
            for level in levels[1:]:
                known = known.union(level)
            known = known.groupBy("cause", "seq").agg(F.min("label").alias("old"))
            hit = hit.join(known, ["cause", "seq"], "left").where(F.col("old").isNull() | (F.col("label") < F.col("old"))).drop("old")
        hit = hit.select("cause", "seq", "label").checkpoint()
        if hit.isEmpty():
            break
        levels.append(hit)
        frontier = hit.select("cause", "seq", "label", F.lit(True).alias("spreads"))
    found = levels[0] if levels else causes.select("cause", "seq", F.lit(0).alias("label")).limit(0)
    for level in levels[1:]:
        found = found.union(level)
    found = found.groupBy(F.col("seq").alias("record"), "cause").agg(F.min("label").alias("label"))
    return found.select("record", "cause", F.when(F.col("label") == 0, "invalidated").otherwise("quarantined").alias("taint"))


def replay(ledger: DataFrame, store: Store) -> Store:
    """The store after every ledger entry that it lacks, in order; replaying again changes nothing.

    ledger: seq, ledger_id, record, action, replacement, at, events (array of host, event_id). An entry whose record is
    unknown or past the change alters no record, but its host events are still suppressed and it is written down. A
    change moves the record and the copies of its observation; taints what rests on them, or for a restore takes back what
    they caused; forget blanks the records, drops their chunks, the links from and to them and the vectors that no other
    chunk's text has, and blanks the queries of the calls that returned them and the reasons of their earlier changes.
    Equal ledger ids count once (the first), null ids and null records are ignored. spark.checkpoint must be set.
    """
    once = Window.partitionBy("ledger_id").orderBy("seq")
    entries = unapplied(ledger.where("ledger_id is not null and record is not null"), store.lifecycle_events)
    entries = entries.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
    settled, of = _settled(entries, store)
    settled = settled.checkpoint()

    # Every copy goes through its observation's applied changes in order.
    todo = settled.where("ok").groupBy("observation").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "replacement", "at"))).alias("todo"))
    known = store.records.select(F.col("seq").alias("known"))
    todo_for = of.join(todo, "observation")
    state = F.struct(F.col("lifecycle").alias("lifecycle"), F.col("superseded_by").alias("by"), F.col("retracted_at").alias("retracted"), F.lit(False).alias("gone"))

    def step(acc: Column, x: Column) -> Column:
        to = _moved(acc["lifecycle"], x["action"])
        ok = to != acc["lifecycle"]
        restored = ok & (x["action"] == "restore")
        return F.struct(
            to.alias("lifecycle"), F.when(ok & (x["action"] != "restore"), F.coalesce(x["replacement"], acc["by"])).otherwise(acc["by"]).alias("by"),
            F.when(restored, F.lit(None).cast(store.records.schema["retracted_at"].dataType)).when(ok & to.isin("retracted", "forgotten"), x["at"]).otherwise(acc["retracted"]).alias("retracted"),
            (acc["gone"] | (ok & (x["action"] == "forget"))).alias("gone"),
        )

    joined = store.records.join(todo_for.select(F.col("seq").alias("of_seq"), "todo"), F.col("seq") == F.col("of_seq"), "left")
    joined = joined.withColumn("now", F.when(F.col("todo").isNotNull(), F.aggregate("todo", state, step)))
    # A replacement counts only where that record is here.
    joined = joined.join(known, F.col("now.by") == F.col("known"), "left").withColumn("by", F.coalesce("known", "superseded_by"))
    changed, gone = F.col("now").isNotNull(), F.coalesce("now.gone", F.lit(False))
    records = joined.withColumns({
        "lifecycle": F.when(changed, F.col("now.lifecycle")).otherwise(F.col("lifecycle")), "superseded_by": F.when(changed, F.col("by")).otherwise(F.col("superseded_by")),
        "retracted_at": F.when(changed, F.col("now.retracted")).otherwise(F.col("retracted_at")), "title": F.when(~gone, F.col("title")), "body": F.when(gone, "").otherwise(F.col("body")),
        "content_hash": F.when(gone, FORGOTTEN_HASH).otherwise(F.col("content_hash")), "gone_": gone,
    })
    records = records.select(*store.records.columns, "gone_").checkpoint()
    gone_now = records.where("gone_").select("seq")

    # Causes are the records named in changes that stand at the end; what a later restore takes back never shows.
    restores = settled.where("ok and action = 'restore'").groupBy("observation").agg(F.max("seq").alias("restored"))
    standing = settled.where("ok and action <> 'restore'").join(restores, "observation", "left").where("restored is null or seq > restored")
    copies = of.join(standing.select("observation", F.col("record").alias("cause"), F.col("action").isin(*WRONG).alias("wrong")), "observation").select("cause", "seq", "wrong")
    copies = copies.groupBy("cause", "seq").agg(F.max("wrong").alias("wrong"))
    new = _dependents(copies, store.links, copies.select("cause", "seq"))
    restored = of.join(settled.where("ok and action = 'restore'").select("observation").distinct(), "observation", "left_semi").select(F.col("seq").alias("cause"))
    kept = store.taints.join(restored, "cause", "left_anti").select(*store.taints.columns)
    # Of taints that meet the stronger stays; invalidated comes first by name too.
    more = [c for c in store.taints.columns if c not in ("record", "cause", "taint")]
    both = kept.select("record", "cause", "taint", *more).unionByName(new.withColumns({c: F.lit(None).cast(store.taints.schema[c].dataType) for c in more}))
    taints = both.groupBy("record", "cause").agg(F.min("taint").alias("taint"), *(F.max(c).alias(c) for c in more)).select(*store.taints.columns)

    blocked = settled.where("action <> 'restore'").select(F.explode("events").alias("e"), F.col("record").alias("cause")).select("e.host", "e.event_id", "cause")
    free = settled.where("action = 'restore'").join(of.select(F.col("seq").alias("cause"), F.col("observation").alias("of_")), F.col("observation") == F.col("of_")).select("cause").distinct()
    # A restore releases what came before it, so only causes without a later change stay blocked.
    late = settled.groupBy("record").agg(F.max_by("action", "seq").alias("last")).where("last <> 'restore'").select(F.col("record").alias("cause"))
    held = store.suppressions.select("host", "event_id", "cause").join(free, "cause", "left_anti").select("host", "event_id", "cause").union(blocked.join(late, "cause", "left_semi").select("host", "event_id", "cause"))

    chunks = store.chunks.join(gone_now.select(F.col("seq").alias("record")), "record", "left_anti").select(*store.chunks.columns)
    dropped = store.chunks.join(gone_now.select(F.col("seq").alias("record")), "record", "left_semi").select("text_hash").distinct().join(chunks.select("text_hash"), "text_hash", "left_anti")
    links = store.links.join(gone_now.select(F.col("seq").alias("from_seq")), "from_seq", "left_anti").join(gone_now.select(F.col("seq").alias("to_seq")), "to_seq", "left_anti").select(*store.links.columns)
    asked = store.calls.select("id", F.explode("returned").alias("seq")).join(gone_now, "seq", "left_semi").select(F.col("id").alias("blank_")).distinct()
    calls = store.calls.join(asked, F.col("id") == F.col("blank_"), "left").withColumn("query", F.when(F.col("blank_").isNull(), F.col("query"))).select(*store.calls.columns)

    written = store.lifecycle_events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top"))
    extra = [c for c in store.lifecycle_events.columns if c not in ("ledger_id", "seq", "record", "action", "reason")]
    appended = settled.crossJoin(F.broadcast(written)).select("ledger_id", (F.col("top") + F.col("seq")).alias("seq"), "record", "action", F.lit(REPLAYED).alias("reason"), *(F.lit(None).cast(store.lifecycle_events.schema[c].dataType).alias(c) for c in extra))
    earlier = store.lifecycle_events.join(gone_now.select(F.col("seq").alias("gone_seq")), F.col("record") == F.col("gone_seq"), "left")
    earlier = earlier.withColumn("reason", F.when(F.col("gone_seq").isNotNull(), FORGOTTEN_REASON).otherwise(F.col("reason"))).select(*store.lifecycle_events.columns)
    return replace(
        store, records=records.select(*store.records.columns), links=links, chunks=chunks, vectors=store.vectors.join(dropped, "text_hash", "left_anti").select(*store.vectors.columns), calls=calls, taints=taints,
        suppressions=held.distinct(), lifecycle_events=earlier.unionByName(appended),
    )

