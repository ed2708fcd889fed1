"""Conversations, ledger replay, provenance, passages, fingerprints, stems and stateful ingest on hand-made rows."""

import hashlib
import random

import pytest
from pyspark.sql import Row, functions as F

from memoria.functions import stemming, text
from memoria.operators import conversations, fingerprints, ledger, provenance, ranking
from memoria.sources import views
from memoria.streaming import stateful


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_shared_transcript_bridges_three_sessions(spark):
    make = spark.createDataFrame
    sessions = make([("s1", "h", "x", False), ("s2", "h", "y", False), ("s3", "h", None, False), ("p", "h", "z", True), ("q", "h", "z", False), ("s4", "h", "w", False)], "session string, host string, host_session string, private boolean")
    cursors = make([("s1", "h", "t1"), ("s2", "h", "t1"), ("q", "h", "t1"), ("s4", "h", "secret"), ("s1", "h", "secret"), ("gone", "h", "t1"), (None, "h", "t1")], "session string, host string, transcript string")
    named = make([("s3", "h", "t1"), ("s3", "h", "t1"), ("p", "h", "t1"), ("s4", "i", "t1")], "session string, host string, transcript string")
    private = make([("h", "secret"), ("h", "secret")], "host string, transcript string")
    asked = make([("s1",), ("s4",), ("p",), ("s1",), (None,)], "session string")
    linked = conversations.conversation_sessions(asked, sessions, cursors, named, private)
    # q is of the private p's host session; s4 shares only a private transcript and another host's t1.
    assert rows(linked) == sorted([("s1", "s1"), ("s1", "s2"), ("s1", "s3"), ("s4", "s4"), ("p", "p"), ("p", "s1"), ("p", "s2"), ("p", "s3")], key=repr)
    records = make([(1, "s1", 5), (2, "s2", 4), (3, "s3", 5), (4, "s4", 5), (5, "s1", 9), (6, "s2", 1), (7, None, 5)], "seq long, session string, created_at long")
    got = conversations.session_neighbours(records.where("seq in (1, 7)"), records, linked, 1)
    assert rows(got) == [(1, 2, "before", 1), (1, 3, "after", 1)]
    assert ("s1", "s2") not in rows(conversations.same_host_session(sessions)) and ("q", "p") in rows(conversations.same_host_session(sessions))
    of = conversations.transcripts_of(make([("h", "x")], "host string, host_session string"), sessions, cursors, make([("s1", "h", "y")], "session string, host string, transcript string"))
    assert rows(of) == sorted([("h", "x", "h", t) for t in ("x", "y", "t1", "secret")])


def store(spark):
    make = spark.createDataFrame
    return ledger.Store(
        records=make([(i, "t", f"body {i}", f"c{i}", None, "active", None, None) for i in range(1, 9)], "seq long, title string, body string, content_hash string, workstream_id string, lifecycle string, superseded_by long, retracted_at string"),
        events=make([(1, "h", "e1"), (2, "h", "e1"), (8, "h", None)], "record long, host string, event_id string"),
        links=make([(3, 1, "derived_from"), (4, 2, "supported_by"), (5, 3, "derived_from"), (2, 1, "derived_from"), (7, 6, "references")], "from_seq long, to_seq long, relation string"),
        chunks=make([(1, 0, "same", "hs"), (6, 0, "same", "hs"), (2, 0, "own", "ho")], "record long, ordinal int, text string, text_hash string"),
        vectors=make([("m", "hs"), ("m", "ho"), ("n", "ho"), ("m", "other")], "model string, text_hash string"),
        calls=make([(1, "ask", [1, 6]), (2, "other", [6]), (3, "none", [])], "id long, query string, returned array<long>"),
        taints=make([(9, 1, "quarantined"), (9, 6, "invalidated")], "record long, cause long, taint string"),
        suppressions=make([("h", "old", 6)], "host string, event_id string, cause long"),
        lifecycle_events=make([("l0", 1, 1, "note", "quotes body 1")], "ledger_id string, seq long, record long, action string, reason string"),
    )


def entries(spark, *todo):
    ddl = "seq long, ledger_id string, record long, action string, replacement long, at string, events array<struct<host: string, event_id: string>>"
    return spark.createDataFrame([(k + 1, name, record, action, replacement, f"t{k + 1}", [("h", e) for e in events]) for k, (name, record, action, replacement, events) in enumerate(todo)], ddl)


def states(s):
    return {r.seq: (r.lifecycle, r.superseded_by, r.retracted_at) for r in s.records.collect()}


def test_forget_takes_the_payload_from_every_table(spark):
    views.reliable(spark)
    todo = entries(spark, ("l0", 6, "forget", None, []), ("l1", 1, "forget", None, ["e1"]), ("l1", 6, "retract", None, []), (None, 6, "retract", None, []))
    once = ledger.replay(todo, store(spark))
    assert {k: v[0] for k, v in states(once).items()} == {1: "forgotten", 2: "forgotten", **dict.fromkeys(range(3, 9), "active")}
    assert {(r.seq, r.title, r.body, r.content_hash) for r in once.records.where("seq < 3").collect()} == {(1, None, "", "forgotten"), (2, None, "", "forgotten")}
    assert rows(once.chunks) == [(6, 0, "same", "hs")] and rows(once.vectors) == [("m", "hs"), ("m", "other")]
    assert rows(once.links) == [(5, 3, "derived_from"), (7, 6, "references")]
    assert rows(once.calls.select("id", "query")) == [(1, None), (2, "other"), (3, "none")]
    assert rows(once.taints) == sorted([(3, 1, "invalidated"), (4, 1, "quarantined"), (5, 1, "invalidated"), (9, 1, "quarantined"), (9, 6, "invalidated")])
    assert rows(once.suppressions) == [("h", "e1", 1), ("h", "old", 6)]
    assert rows(once.lifecycle_events.select("ledger_id", "record", "reason")) == [("l0", 1, "[forgotten]"), ("l1", 1, "replayed from the ledger")]
    twice = ledger.replay(todo, once)
    for name in store(spark).__dataclass_fields__:
        assert rows(getattr(once, name)) == rows(getattr(twice, name)), name


def test_changes_in_order_and_restores(spark):
    views.reliable(spark)
    todo = entries(
        spark, ("a", 1, "retract", None, ["e1"]), ("b", 1, "restore", None, []), ("c", 1, "restore", None, []), ("d", 6, "supersede", 7, []), ("e", 6, "retract", None, []), ("f", 99, "forget", None, ["e9"]),
        ("g", 7, "supersede", 77, []), ("h", 8, "retract", None, ["e8"]),
    )
    after = ledger.replay(todo, store(spark))
    assert states(after) == {**{k: ("active", None, None) for k in (1, 2, 3, 4, 5)}, 6: ("superseded", 7, None), 7: ("superseded", None, None), 8: ("retracted", None, "t8")}
    # The restore took back what the retraction of 1 had tainted and suppressed; unknown records still block their events.
    assert rows(after.taints) == [(9, 6, "invalidated")] and rows(after.suppressions) == [("h", "e8", 8), ("h", "e9", 99), ("h", "old", 6)]
    assert after.lifecycle_events.count() == 9 and rows(after.chunks) == rows(store(spark).chunks)
    # A superseded record's copies are outdated, but what merely rests on it is not wrong.
    later = ledger.replay(entries(spark, ("z", 1, "supersede", None, [])), store(spark))
    assert rows(later.taints.where("cause = 1 and record <> 9")) == [(3, 1, "invalidated"), (5, 1, "invalidated")]
    assert ledger.replay(todo.limit(0), store(spark)).lifecycle_events.count() == 1


def test_provenance(spark):
    ddl = "host string, transcript string, branch string, event_id string, record string, disposition string, meta string"
    events = spark.createDataFrame(
        [
            ("h", "t", "main", "e1", "r1", "record", '{"agentType":"helper"}'), ("h", "t", "side", "e2", "r2", "record", '{"agentType":5}'), ("h", "t", "main", "e3", "r3", "record", "no json"), ("h", "t", "main", "c1", None, "tool_call", '{"callId":"k1"}'),
            ("h", "t", "main", "c2", None, "tool_call", '{"callId":"k2"}'), ("h", "t", "main", "o1", None, "echo", '{"callId":"k1","references":["r1","r1","rx"]}'), ("h", "t", "main", "o2", None, "echo", '{"references":null}'), ("h", "u", "main", "o3", None, "echo", None),
        ],
        ddl,
    )
    records = spark.createDataFrame([("r1", "s", 1), ("r2", "s", 2), ("r3", "s", 3), ("own", "s", 4), ("lone", None, 5)], "id string, session string, created_at long")
    edges = provenance.references(events)
    assert rows(edges.select("event_id", "record")) == [("o1", "r1"), ("o1", "rx")]
    assert rows(provenance.echoes_naming(edges, records)) == [("h", "t", "o1")]
    assert rows(provenance.calls_echoing(edges, records, events)) == [("h", "t", "c1")]
    assert {(r.record, r.agent_type, r.observed_at) for r in provenance.imported_from(events, records).collect()} == {("r1", "helper", 1), ("r2", "subagent", 2), ("r3", None, 3)}
    links = spark.createDataFrame([("own", "r1", "references"), ("own", "r2", "supersedes"), ("r1", "r2", "derived_from"), ("lone", "r3", "supported_by")], "from_id string, to_id string, relation string")
    sessions = spark.createDataFrame([("s", "hs")], "session string, host_session string")
    assert rows(provenance.agent_citations(links, records, sessions, events)) == [("r1", 4, "hs"), ("r3", 5, None)]
    assert rows(provenance.agent_citations(links, records, sessions, events, 5)) == [("r3", 5, None)]


def passage_by_loop(t, most):
    total = len(t.encode())
    if total <= most:
        return t, 0
    head, tail, n = "", "", 0
    for c in t:
        if n + len(c.encode()) > most * 3 // 4:
            break
        head, n = head + c, n + len(c.encode())
    n = 0
    for c in reversed(t):
        if n + len(c.encode()) > most - most * 3 // 4:
            break
        tail, n = c + tail, n + len(c.encode())
    omitted = total - len(head.encode()) - len(tail.encode())
    return f"{head}\n[… {omitted:,} bytes omitted …]\n{tail}", omitted


def test_bounded_passages_equal_a_byte_loop(spark):
    rng = random.Random(1)
    texts = ["", "short"] + ["".join(rng.choice("aé€😀\n") for _ in range(rng.randint(0, 90))) for _ in range(300)] + ["é" * 3000]
    for most in (20, 41, 100):
        passage, omitted = text.bounded_passage(F.col("t"), most)
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", passage.alias("p"), omitted.alias("n")).collect()
        assert all((r.p, r.n) == passage_by_loop(r.t, most) for r in got)
    passage, omitted = text.bounded_passage(F.col("t"), 20)
    assert spark.createDataFrame([(None,)], "t string").select(passage.alias("p")).first().p is None


# Words and stems as the published description of the algorithm gives them.
PORTER = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll tested test finds find generalizations gener oscillators oscil is is by by""".split()


def test_stems(spark):
    for word, want in zip(PORTER[::2], PORTER[1::2], strict=True):
        assert stemming.stem(word) == want, word
    assert [stemming.stem(w) for w in ("a", "été", "x86s", "y" * 80 + "s", "")] == ["a", "été", "x86s", "y" * 80 + "s", ""]
    index = spark.createDataFrame([(1, "tested", 2), (1, "testing", 1), (2, "cats", 1), (2, None, 1)], "id long, term string, tf long")
    table = stemming.stems(index)
    assert rows(ranking.stem_postings(index, table)) == [(1, "test", 3), (2, "cat", 1)]
    asked = stemming.stemmed(spark.createDataFrame([(7, "tests")], "query_id long, term string"), stemming.stems(spark.createDataFrame([("tests",)], "term string")))
    assert rows(ranking.bm25(ranking.stem_postings(index, table), asked).select("query_id", "id")) == [(7, 1)]


def sha(s):
    return "sha256:" + hashlib.sha256(s.encode()).hexdigest()


N = "l1\nl2\r\n\nl4"
CITED = "l1\nl2\n\nl4"
READS = [
    # format, first, last, text, intact, window, trimmed -> (observed, first, last, cited text, cited lines)
    ("plain", None, None, "a\nb\n", True, None, False, ("a\nb\n", None, None, None, None)),
    ("plain", None, None, "a\nb\nc\n", True, None, True, None), ("plain", None, None, "a\nb\n", False, None, False, None), ("plain", None, None, "a\nb\n", None, None, False, None), ("plain", None, None, "", True, None, False, None),
    ("plain", 3, 6, N + "\n", True, None, False, (None, 3, 6, CITED, None)), ("plain", 3, 9, N, True, None, False, (None, 3, 6, CITED, None)), ("plain", 3, 5, N, True, None, False, None), ("plain", 3, 6, "a\n\n \t\nb\n", True, None, False, None),
    ("plain", 3, 6, N, True, None, True, (None, 3, 6, CITED, None)), ("plain", 3, 8, N, True, None, True, (None, 3, 8, CITED, 4)), ("plain", 3, 4, N, True, None, True, None),
    ("numbered", None, None, "     1\ta\n     2\tb\n     3\tc\n", True, None, False, (None, 1, 3, "a\nb\nc", None)), ("numbered", 5, 9, "5\ta\n6\tb\n7\tc", True, None, False, (None, 5, 7, "a\nb\nc", None)),
    ("numbered", None, None, "     1\ta\n     3\tb\n     4\tc\n", True, None, False, None), ("numbered", None, None, "   1\ta\n     2\tb\n     3\tc\n", True, None, False, None), ("numbered", None, None, "1\ta\n2\tb\n3\tc\n     4", True, None, True, (None, 1, 3, "a\nb\nc", None)),
    ("read_tool", None, None, "     1\ta\n     2\tb\n     3\t", True, (1, 3, 3), False, ("a\nb\n", None, None, None, None)), ("read_tool", None, None, "2\ta\n3\tb\n4\tc\n5\t", True, (2, 4, 5), True, (None, 2, 4, "a\nb\nc", None)),
    ("read_tool", None, None, "2\ta\n3\tb\n4\tc", True, (2, 3, 9), True, (None, 2, 4, "a\nb\nc", None)), ("read_tool", None, None, "2\ta\n3\tb", True, (2, 3, 9), False, None), ("read_tool", None, None, "2\ta\n3\tb", True, None, False, None),
    ("read_tool", None, None, "1\t" + "x" * 2001 + "\n2\tb\n3\tc", True, (1, 3, 3), False, None), (None, None, None, "a\n", True, None, False, None),
]


def test_fingerprints(spark):
    ddl = "k int, read struct<path: string, format: string, first: long, last: long>, text string, intact boolean, window struct<start: long, lines: long, total: long>, trimmed boolean"
    data = [(k, ("/w/f", f, a, z) if f else None, t, i, w, c) for k, (f, a, z, t, i, w, c, _) in enumerate(READS)]
    got = spark.createDataFrame(data, ddl).select("k", fingerprints.fingerprint(F.col("read"), F.col("text"), F.col("intact"), F.col("window"), F.col("trimmed")).alias("f")).collect()
    for r in got:
        want = READS[r.k][-1]
        if want is None:
            assert r.f is None, READS[r.k]
        else:
            whole, first, last, said, n = want
            assert tuple(r.f) == (whole and sha(whole), first, last, said and sha(said), said and len(said.encode()), n), READS[r.k]


def test_snapshots_are_bounded(spark, tmp_path):
    for name, data in (("a", b"x\n"), ("edge", b"y" * (1 << 20)), ("big", b"z" * ((1 << 20) + 1)), ("d/e", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.observed_hash) for r in fingerprints.snapshot_files(spark, str(tmp_path)).collect()}
    assert got == {"a": ("hashed", sha("x\n")), "edge": ("hashed", sha("y" * (1 << 20))), "big": ("too_large", None)}


def test_observed_references(spark):
    ddl = "seq long, path string, lines struct<first: long, last: long>, commit string, observed_hash string, observed_at string, cited_hash string, cited_bytes long, dirty boolean"
    refs = spark.createDataFrame(
        [(1, "a", (2, 3), *[None] * 6), (2, "a", (1, 1), *[None] * 6), (3, "a", None, "pin", *[None] * 5), (4, "gone", None, *[None] * 6), (5, ".env", None, *[None] * 6), (6, "big", (1, 1), *[None] * 6), (7, "a", (4, 9), *[None] * 6), (8, "a", (4, 4), *[None] * 6)], ddl
    )
    files = spark.createDataFrame([("a", "hashed", "H", b"dup\r\nb\r\nc\r\ndup\n"), (".env", "hashed", "E", b"x"), ("big", "too_large", None, None)], "path string, kind string, observed_hash string, content binary")
    state = spark.createDataFrame([("head", ["a"])], "head string, dirty array<string>")
    got = {r.seq: r for r in fingerprints.observed(refs, files, state, F.coalesce(F.col("path") == ".env", F.lit(False)), F.lit("now")).collect()}
    assert (got[1].observed_hash, got[1].observed_at, got[1].cited_hash, got[1].cited_bytes, got[1].commit, got[1].dirty) == ("H", "now", sha("b\nc"), 3, "head", True)
    # A line that the file has twice names no place; neither do lines beyond its end.
    assert got[2].cited_hash is got[7].cited_hash is got[8].cited_hash is None and got[2].observed_hash == "H"
    assert (got[3].commit, got[3].observed_hash, got[4].observed_at, got[5].observed_hash) == ("pin", None, None, None)
    assert (got[6].observed_hash, got[6].commit, got[6].dirty) == (None, "head", False)
    bare = {r.seq: r for r in fingerprints.observed(refs, files, state.limit(0), F.lit(False), F.lit("now")).collect()}
    assert (bare[1].observed_hash, bare[1].commit, bare[6].observed_at) == ("H", None, None)


def slice_rows(transcript, name, events, expected=None, epoch=0, expected_epoch=0, end=100, stop=None, candidates=1):
    return [("h", transcript, name, epoch, expected, expected_epoch, end, stop, candidates, at, "main", event, kind, digest, call, "Bash" if kind == "tool_call" else None, "other" if kind == "tool_call" else None, scope) for at, event, kind, digest, call, scope in events]


def test_stateful_ingest(spark, tmp_path):
    m = lambda at, event, digest="d", scope=True: (at, event, "message", digest, None, scope)
    first = [
        *slice_rows("t", "1", [m(0, "a"), (5, "call", "tool_call", "d", "k", True)], end=10), *slice_rows("t", "1", [m(0, "a")][:0]), *slice_rows("held", "1", [m(0, "a")], candidates=2),
        *slice_rows("stop", "1", [m(0, "a"), m(5, "b")], stop=5), *slice_rows("bad", "1", [m(0, "a"), m(5, "b", scope=False), m(7, "c")]), *slice_rows("t", "early", [m(10, "x")], expected=7),
    ]
    second = [
        *slice_rows("t", "1", [m(0, "a")], end=10), *slice_rows("t", "2", [(10, "res", "tool_result", "d", "k", True), m(12, "a2")], expected=10, end=20),
        *slice_rows("stop", "2", [m(5, "b")], expected=5, end=9), *slice_rows("bad", "2", [m(9, "d")], expected=5), *slice_rows("held", "1", [m(0, "a")], candidates=1, end=3),
    ]
    third = [*slice_rows("t", "3", [m(0, "a"), m(4, "a2", "new")], expected=20, epoch=1, end=30)]
    for n, landing in enumerate((first, second, third)):
        spark.createDataFrame(landing, stateful.SLICE).coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
        for _ in range(2 if n == 1 else 1):  # a run without anything new does nothing
            stateful.ingest(spark, str(tmp_path / "landed"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.schema(stateful.APPLIED).parquet(str(tmp_path / "out"))
    events = rows(got.where("event_id is not null").select("transcript", "slice", "event_id", "disposition", "version", "call_tool"))
    assert events == sorted(
        [
            ("t", "1", "a", "record", False, None), ("t", "1", "call", "tool_call", False, None), ("t", "2", "res", "record", False, "Bash"), ("t", "2", "a2", "record", False, None), ("t", "3", "a", "replay", False, None),
            ("t", "3", "a2", "record", True, None), ("stop", "1", "a", "record", False, None), ("stop", "2", "b", "record", False, None), ("bad", "1", "a", "record", False, None), ("held", "1", "a", "record", False, None),
        ],
        key=repr,
    )
    moves = rows(got.where("event_id is null").select("transcript", "slice", "disposition", "state", "byte_offset", "epoch"))
    assert moves == sorted(
        [
            ("t", "1", "cursor", "active", 10, 0), ("t", "early", "refused", "active", 10, 0), ("t", "1", "refused", "active", 10, 0), ("t", "2", "cursor", "active", 20, 0), ("t", "3", "cursor", "active", 30, 1), ("held", "1", "held", "held", None, 0),
            ("held", "1", "cursor", "active", 3, 0), ("stop", "1", "cursor", "stopped", 5, 0), ("stop", "2", "cursor", "active", 9, 0), ("bad", "1", "cursor", "quarantined", 5, 0), ("bad", "2", "refused", "quarantined", 5, 0),
        ],
        key=repr,
    )


def test_odd_stems_do_not_reach_the_index(spark):
    assert stemming.stems(spark.createDataFrame([], "term string")).count() == 0


@pytest.mark.parametrize("empty", ["", None])
def test_no_passage_of_nothing(spark, empty):
    passage, omitted = text.bounded_passage(F.col("t"), 10)
    assert spark.createDataFrame([(empty,)], "t string").select(passage.alias("p")).first().p == empty


def test_an_event_asks_the_state_once(spark):
    """A transcript's first slice asks only for its cursor; a later one once for each place and call."""

    class Store(dict):
        def __init__(self):
            super().__init__()
            self.asked = 0

        def containsKey(self, key):
            self.asked += 1
            return key in self

        getValue, updateValue = dict.get, dict.__setitem__

    class Cursor:
        at, asked = None, 0

        def exists(self):
            self.asked += 1
            return self.at is not None

        def get(self):
            return self.at

        def update(self, at):
            self.at = at

    ingest = stateful.Ingest()
    ingest.cursor, ingest.calls, ingest.seen = Cursor(), Store(), Store()
    named = Row(*(c.split()[0] for c in stateful.SLICE.split(", ")))
    m = lambda at, event, digest="d": (at, event, "message", digest, None, True)
    first = slice_rows("t", "1", [m(n, f"e{n}") for n in range(50)], end=50)
    again = slice_rows("t", "1 again", [m(0, "e0")], end=50)
    out = list(ingest.handleInputRows(("h", "t"), iter([named(*r) for r in [*first, *again]]), None))
    assert [o.disposition for o in out].count("record") == 50 and out[-1].disposition == "refused"
    assert (ingest.cursor.asked, ingest.seen.asked, ingest.calls.asked) == (1, 0, 0)
    later = slice_rows("t", "2", [m(50, "e1", "new"), m(51, "e1", "d"), m(52, "e1", "new"), (53, "r", "tool_result", "x", "k", True)], expected=50, end=60)
    out = list(ingest.handleInputRows(("h", "t"), iter([named(*r) for r in later]), None))
    assert [(o.disposition, o.version) for o in out] == [("record", True), ("replay", False), ("replay", False), ("record", False), ("cursor", False)]
    assert (ingest.cursor.asked, ingest.seen.asked, ingest.calls.asked) == (2, 2, 1)
