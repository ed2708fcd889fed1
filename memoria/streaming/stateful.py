"""Stateful ingest: slices of transcripts applied against cursors, calls and events that live in the stream's state."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The states of a cursor.
ACTIVE, STOPPED, QUARANTINED, HELD = "active", "stopped", "quarantined", "held"
#: What a slice's event carries, next to the slice it lies in.
SLICE = (
    "host string, transcript string, slice string, epoch long, expected long, expected_epoch long, slice_end long, stop_at long, candidates int, "
    "line_start long, branch string, event_id string, type string, content_hash string, call_id string, tool string, tool_kind string, in_scope boolean"
)
APPLIED = "host string, transcript string, slice string, branch string, event_id string, content_hash string, disposition string, version boolean, call_tool string, state string, byte_offset long, epoch long"
_OUT = Row(*(c.split()[0] for c in APPLIED.split(", ")))
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ingest(StatefulProcessor):
    """A transcript's cursor, its calls and what its events said so far.

    A slice names the cursor (offset and epoch) that it was read from. It is applied only where the cursor still stands
    there, and moves it in the same step: a slice that is delivered again, or was read beside another, is refused and
    changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "byte_offset long, epoch long, state string")
        self.calls = handle.getMapState("calls", "call_id string", "tool string, tool_kind string")
        self.seen = handle.getMapState("seen", "branch string, event_id string", "hashes string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        slices: dict[tuple, list[Row]] = {}
        for row in rows:
            if row.epoch is not None:
                slices.setdefault((row.epoch, -1 if row.expected is None else row.expected, str(row.slice)), []).append(row)
        # Asking the state is what an event costs, so the cursor is asked once; nothing is known of a transcript without one.
        self.live = self.cursor.get() if self.cursor.exists() else None
        self.empty = self.live is None
        self.known_calls: dict[tuple, tuple | None] = {}
        self.known_hashes: dict[tuple, list[str]] = {}
        for epoch, _, name in sorted(slices):
            events = slices[epoch, _, name]
            events.sort(key=lambda e: (e.line_start is None, e.line_start or 0, e.event_id is None, e.event_id or ""))
            yield from (_OUT(*values) for values in self._slice(key, name, epoch, events))

    def _slice(self, key, name: str, epoch: int, rows: list[Row]) -> Iterator[tuple]:
        first, live = rows[0], self.live
        at = lambda kind, state, offset, event=None, version=False, tool=None: (
            *key, name, event.branch if event is not None else None, event.event_id if event is not None else None, event.content_hash if event is not None else None,
            kind, version, tool, state, offset, epoch if kind != "refused" else (live[1] if live else None),
        )
        expected = None if first.expected is None else (first.expected, first.expected_epoch)
        if (live is None) != (expected is None) or (live is not None and (live[:2] != expected or live[2] == QUARANTINED)):
            yield at("refused", live[2] if live else None, live[0] if live else None)
            return
        if live is None and (first.candidates or 0) > 1:
            # Which workstream it belongs to is not known, so nothing of it is taken and no cursor opens.
            yield at("held", HELD, None)
            return
        state, offset = ACTIVE, first.slice_end
        if first.stop_at is not None:
            state, offset = STOPPED, first.stop_at
        for event in rows:
            if event.event_id is None or (state == STOPPED and event.line_start is not None and event.line_start >= offset):
                continue
            if not event.in_scope:
                state, offset = QUARANTINED, event.line_start
                break
            yield self._event(at, event, state)
        self.live = (offset, epoch, state)
        self.cursor.update(self.live)
        yield at("cursor", state, offset)

    def _call(self, call_id) -> tuple | None:
        if (call_id,) not in self.known_calls:
            held = not self.empty and self.calls.containsKey((call_id,))
            self.known_calls[(call_id,)] = self.calls.getValue((call_id,)) if held else None
        return self.known_calls[(call_id,)]

    def _hashes(self, place: tuple) -> list[str]:
        if place not in self.known_hashes:
            held = not self.empty and self.seen.containsKey(place)
            self.known_hashes[place] = json.loads(self.seen.getValue(place)[0]) if held else []
        return self.known_hashes[place]

    def _event(self, at, event: Row, state: str) -> tuple:
        place = (event.branch, event.event_id)
        hashes = self._hashes(place)
        tool = kind = None
        if event.type == "tool_call":
            self.known_calls[(event.call_id,)] = (event.tool, event.tool_kind)
            self.calls.updateValue((event.call_id,), (event.tool, event.tool_kind))
        elif event.type == "tool_result" and (call := self._call(event.call_id)):
            tool, kind = call
        if event.content_hash in hashes:
            return at("replay", state, None, event, False, tool)
        self.known_hashes[place] = [*hashes, event.content_hash]
        self.seen.updateValue(place, (json.dumps(self.known_hashes[place]),))
        # What the memory's own tools answered is an echo, not an observation.
        echo = event.type == "tool_result" and tool is not None and kind == "own"
        return at("tool_call" if event.type == "tool_call" else "echo" if echo else "record", state, None, event, bool(hashes), tool)


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which this kind of state needs, for the queries that start meanwhile."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def applied(slices: DataFrame) -> DataFrame:
    """What a stream of slices' events (SLICE) does, as rows of APPLIED.

    A row for each event that a slice brings in (record, tool_call, echo; version: its identity was known with other
    content; replay: with this content; call_tool: the tool of the call that a result answers, whichever slice held it),
    one for each slice that moved the cursor (disposition cursor), was refused or is held. A slice without events is one
    row without event_id. Events at or after stop_at are left for a later slice; the first event out of scope quarantines
    the transcript from its line on, and no later slice is taken."""
    return slices.groupBy("host", "transcript").transformWithState(Ingest(), APPLIED, "Append", "None")


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Apply the slices that have landed in source (Parquet of SLICE) since the last run, append what they did to out,
    and stop. State and sink go by Spark's checkpoint: a run that is lost is repeated from its last finished batch."""
    slices = spark.readStream.schema(SLICE).option("maxFilesPerTrigger", files).parquet(source)
    with rocks(spark):
        return applied(slices).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
