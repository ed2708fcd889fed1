"""The provenance graph: links, independent roots, taint closure, lifecycle and the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.schemas import DEPTH, LIFECYCLES

# What an action makes of a record in which state, and how strongly its dependents are tainted.
TRANSITIONS = (
    ("correct", "active", "corrected"), ("supersede", "active", "superseded"), ("retract", "active", "retracted"), ("restore", "retracted", "active"),
    ("forget", "active", "forgotten"), ("forget", "corrected", "forgotten"), ("forget", "superseded", "forgotten"), ("forget", "retracted", "forgotten"),
)
WRONG = ("correct", "retract", "forget")


def both_ways(links: DataFrame) -> DataFrame:
    """(record, other, relation, direction) of every link, seen from both ends."""
    out = links.select(F.col("from_seq").alias("record"), F.col("to_seq").alias("other"), "relation", F.lit("out").alias("direction"))
    return out.unionAll(links.select("to_seq", "from_seq", "relation", F.lit("in")))


def citations(links: DataFrame, visible: DataFrame) -> DataFrame:
    """(record, cites): the visible records that each one cites, in order."""
    seen = links.join(visible.select(F.col("seq").alias("to_seq")), "to_seq", "left_semi")
    return seen.groupBy(F.col("from_seq").alias("record")).agg(F.sort_array(F.collect_list("to_seq")).alias("cites"))


def parents(links: DataFrame, visible: DataFrame) -> DataFrame:
    """(child, parent): the one record that each rests on. derived_from comes before supported_by, then the lowest."""
    held = links.where(F.col("relation").isin("derived_from", "supported_by")).join(visible.select(F.col("seq").alias("to_seq")), "to_seq", "left_semi")
    best = F.min(F.struct(F.when(F.col("relation") == "derived_from", 0).otherwise(1).alias("kind"), "to_seq"))
    return held.groupBy(F.col("from_seq").alias("child")).agg(best.alias("b")).select("child", F.col("b.to_seq").alias("parent"))


def roots(nodes: DataFrame, parent: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(seq, root, hops): the record that each one finally rests on, at most depth steps up.

    Pointers are doubled: after step i each record knows its ancestor 2^i steps up, so 16 levels take 4 joins. On a
    cycle the walk stops after depth steps, at whatever record it has reached.
    """
    at = nodes.select("seq").join(parent, F.col("seq") == F.col("child"), "left").select("seq", F.coalesce("parent", "seq").alias("root"), F.col("parent").isNotNull().cast("long").alias("hops"))
    step = 1
    while step < depth:
        up = at.select(F.col("seq").alias("up"), F.col("root").alias("further"), F.col("hops").alias("more"))
        at = at.join(up, F.col("root") == F.col("up"), "left").select("seq", F.coalesce("further", "root").alias("root"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        step *= 2
    return at


def source_roots(found: DataFrame, events: DataFrame) -> DataFrame:
    """Adds source to roots: what an independent root is known by. A root that was imported is the host's event, so copies
    of one event count once, whichever record holds them; any other root is its record. events: record, host, event_id."""
    event = events.where("host is not null and event_id is not null").groupBy(F.col("record").alias("root_of")).agg(F.min(F.struct("host", "event_id")).alias("e"))
    rows = found.join(event, F.col("root") == F.col("root_of"), "left")
    return rows.withColumn("source", F.when(F.col("e").isNotNull(), F.concat_ws("@", "e.event_id", "e.host")).otherwise(F.concat(F.lit("record "), F.col("root").cast("string")))).drop("e", "root_of")


def taint_closure(causes: DataFrame, links: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(record, label) of all that rests on wrong or outdated records, at most depth levels down; label 0 invalidated,
    1 quarantined, the stronger winning.

    causes: (seq, wrong). What is derived from a cause is invalidated; what is supported by a wrong one is quarantined.
    A record derived from a tainted one takes its label; one supported by a tainted one is quarantined. A level is one
    join; a record reached again with a stronger label passes that on.
    """
    edges = links.where(F.col("relation").isin("derived_from", "supported_by")).select(F.col("from_seq").alias("child"), F.col("to_seq").alias("on"), (F.col("relation") == "derived_from").alias("derived"))
    # Edges are written once, and what is found is cut with each level, so no plan grows with the depth.
    edges = edges.checkpoint()
    frontier = causes.select("seq", F.lit(0).alias("label"), F.col("wrong").alias("spreads"))
    found = None
    for _ in range(depth):
        hit = frontier.join(edges, F.col("seq") == F.col("on")).where(F.col("derived") | F.col("spreads"))
        hit = hit.groupBy(F.col("child").alias("seq")).agg(F.min(F.when(F.col("derived"), F.col("label")).otherwise(1)).alias("label"))
        if found is not None:
            known = found.select(F.col("seq").alias("k"), F.col("label").alias("old"))
            hit = hit.join(known, F.col("seq") == F.col("k"), "left").where(F.col("old").isNull() | (F.col("label") < F.col("old"))).select("seq", "label")
        hit = hit.checkpoint()
        if hit.isEmpty():
            break
        found = hit if found is None else found.union(hit).groupBy("seq").agg(F.min("label").alias("label")).checkpoint()
        frontier = hit.select("seq", "label", F.lit(True).alias("spreads"))
    empty = causes.select("seq", F.lit(0).alias("label")).limit(0)
    return (found if found is not None else empty).select(F.col("seq").alias("record"), "label")


def apply_transitions(actions: Column, start: str = "active") -> Column:
    """The state after folding an ordered array of actions, impossible ones ignored."""
    step = lambda state, a: F.coalesce(*(F.when((a == action) & (state == old), F.lit(new)) for action, old, new in TRANSITIONS), state)
    return F.aggregate(actions, F.lit(start), step)


def states(events: DataFrame, span: int = 4096) -> DataFrame:
    """(record, state): every record's events folded in order. Each stretch of `span` sequence numbers is folded first, from
    every state that a record may be in; so no group holds more of a record's events than that, nor one stretch a row."""
    rows = events.groupBy("record", F.floor(F.col("seq") / span).alias("part")).agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("e"))
    rows = rows.select("record", "part", F.transform("e", lambda e: e["action"]).alias("actions"))
    known = F.map_from_arrays(F.array(*map(F.lit, LIFECYCLES)), F.array(*(apply_transitions(F.col("actions"), s) for s in LIFECYCLES)))
    rows = rows.select("record", "part", known.alias("to")).groupBy("record").agg(F.array_sort(F.collect_list(F.struct("part", F.map_entries("to").alias("to")))).alias("parts"))
    step = lambda state, p: F.element_at(F.map_from_entries(p["to"]), state)
    return rows.select("record", F.aggregate("parts", F.lit("active"), step).alias("state"))


def unapplied(ledger: DataFrame, applied: DataFrame) -> DataFrame:
    return ledger.join(applied.select("ledger_id"), "ledger_id", "left_anti")


def forgotten(records: DataFrame, gone: DataFrame) -> DataFrame:
    """The records with the payload of forgotten ones blanked; the tombstone stays."""
    mark = gone.select(F.col("seq").alias("g"), F.lit(True).alias("was"))
    rows = records.join(mark, F.col("seq") == F.col("g"), "left")
    return rows.withColumn("body", F.when(F.col("was").isNull(), F.col("body"))).withColumn("lifecycle", F.when(F.col("was"), "forgotten").otherwise(F.col("lifecycle"))).drop("g", "was")


def head(checkpoints: DataFrame) -> DataFrame:
    """The checkpoint of each workstream's highest revision."""
    w = Window.partitionBy("workstream_id").orderBy(F.desc("revision"))
    return checkpoints.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def nudged(before: Column, turns: Column, every: int = 5) -> Column:
    """Whether a count of turns has crossed a multiple since it was last looked at."""
    return F.floor(turns / every) > F.floor(before / every)
