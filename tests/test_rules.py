"""Small rules and sinks on hand-made rows."""

import hashlib
import json

from pyspark.sql import functions as F

from memoria.functions import rules
from memoria.sources import sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lasting_preferences(spark):
    yes = ["From now on use tabs", "so, going forward", "In future, ask", "ok. in the future test", "I'd prefer x", "I prefer y", "please remember to push", "Never commit to main", "please always run it", "fix it\n  always lint", "you must never do"]
    no = ["the build always fails", "did you remember to push", "never mind", "Never  mind that", "```\nfrom now on\n``` ok", "``` I prefer", "in future mid-sentence: no, see in future", "always", "", None]
    no.remove("in future mid-sentence: no, see in future")
    got = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", rules.states_lasting_preference(F.col("t")).alias("y")).collect()
    assert {r.t: r.y for r in got} == {**dict.fromkeys(yes, True), **dict.fromkeys(no, False)}


def test_read_only_calls(spark):
    cases = [("memory_bootstrap", "{}", True), ("memory_bootstrap", '{"importChoice":null}', False), ("memory_recall", None, True), ("memory_manage", '{"action":"inspect"}', True), ("memory_manage", "torn", False), ("memory_record", "{}", False), ("odd", None, False)]
    got = spark.createDataFrame([c[:2] for c in cases], "o string, a string").select(rules.read_only(F.col("o"), F.col("a"))).collect()
    assert [r[0] for r in got] == [c[2] for c in cases]


def test_checkpoints_come_back(spark):
    body = "Goal: g\n\nStatus: s\n\nNext steps: no list\n\nDecisions:\n- d1\n- d2\n\nNext steps:\n- first\nmore\n- second\n\nPreferences:\n- p"
    cases = [body, "Goal: g\n\nStatus: " + "x" * 400, "Goal: g\n\nStatus: s\n\nPreferences:\n- p\n\nNext steps:\n- late", "Status: only", "Goal: no status", "", None, "Goal: \n\nStatus: \n\nNext steps:\n- n\n\nPreferences:\n- p"]
    got = [tuple(r) for r in spark.createDataFrame([(c,) for c in cases], "b string").select(*rules.summarise_checkpoint(F.col("b"))).collect()]
    assert got == [("g", "s\n\nNext steps: no list", "first\nmore"), ("g", "x" * 299 + "…", None), ("g", "s\n\nPreferences:\n- p", "late"), *[(None, None, None)] * 4, ("", "", "n")]
    made = spark.createDataFrame([("g", "s", ["d1", "d2"], [])], "g string, s string, d array<string>, n array<string>").select(rules.render_checkpoint(F.col("g"), F.col("s"), decisions=F.col("d"), nextSteps=F.col("n"))).first()[0]
    assert made == "Goal: g\n\nStatus: s\n\nDecisions:\n- d1\n- d2"


def test_a_checkpoints_summary_is_a_small_expression(spark):
    df = spark.createDataFrame([("Goal: g\n\nStatus: s\n\nNext steps:\n- n",)], "b string").select(*rules.summarise_checkpoint(F.col("b")))
    assert tuple(df.first()) == ("g", "s", "n")
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_what_outputs_name(spark):
    a, b, s = "wst_" + "a" * 32, "wst_" + "b" * 32, "ses_" + "c" * 32
    cases = [(json.dumps({"scope": {"workstreamId": a}, "x": {"workstreamId": b}}), [a], []), (f'cut "workstreamId":"{a}" "workstreamId":"{b}" "workstreamId":"{a}"', [a, b], []), ('{"scope":{"workstreamId":"odd"}}', [], []), (f'"headRevision":3,"sessionId":"{s}","sessionId":"ses_{"d" * 32}"', [], [s]), ("[]", [], [])]
    got = spark.createDataFrame([(c[0],) for c in cases], "t string").select(rules.bound_workstreams(F.col("t")).alias("w"), rules.named_sessions(F.col("t")).alias("s")).collect()
    assert [([w for w in r.w if w], r.s) for r in got] == [(c[1], c[2]) for c in cases]


def test_workstreams_without_a_worktree(spark):
    make = spark.createDataFrame
    streams = make([("a", "main", "l", "active", None), ("b", "main", "l", "active", "t"), ("c", None, "main", "active", None), ("d", "detached", "l", "active", None), ("e", "detached@1", "l", "active", None), ("f", "main", "l", "closed", None), ("g", "main", "l", "active", None)], "workstream string, branch string, label string, lifecycle string, task_key string")
    bindings = make([("a", "/gone"), ("g", "/gone"), ("g", "/here"), ("x", "/here")], "workstream string, worktree string")
    live = make([("/here",), ("/here",)], "worktree string")
    assert rows(rules.orphans_on_branch(streams, bindings, live)) == [("main", "a"), ("main", "b"), ("main", "c")]
    assert rows(rules.orphans_on_branch(streams, bindings, live, F.lit("task"))) == [("main", "a"), ("main", "c")]
    assert rows(rules.bound_to(bindings, streams)) == [("/gone", "a"), ("/gone", "g"), ("/here", "g")]
    wanted = make([("h", "t"), ("h", "t")], "host string, transcript string")
    assert rows(rules.of_transcripts(make([("h", "t", 1), ("i", "t", 2), ("h", "u", 3)], "host string, transcript string, k int"), wanted)) == [("h", "t", 1)]


def test_record_fields(spark):
    df = spark.createDataFrame([('{"testRun":{"command":"c","outcome":"ok"},"os":"linux"}', '[{"kind":"file","path":"p"}]', None), ("torn", "torn", "w")], "applicability string, external_refs string, workstream_id string")
    one, two = rules.record_fields(df).collect()
    assert (one.test_run.command, one.references[0].path, json.loads(one.applies), one.workspace_level) == ("c", "p", {"os": "linux"}, True)
    assert (two.test_run and two.test_run.command, two.workspace_level) == (None, False)


def test_appends_show_whole_and_once(spark, tmp_path):
    path = str(tmp_path)
    a, b = spark.createDataFrame([(1,)], "k long"), spark.createDataFrame([("x",)], "v string")
    assert sinks.read(spark, path, "a", "k long").count() == 0
    a.write.parquet(f"{path}/a/commit=lost")  # an append that was lost before its mark
    assert sinks.append(spark, path, "one", {"a": a, "b": b}) and not sinks.append(spark, path, "one", {"a": a.union(a)})
    assert rows(sinks.read(spark, path, "a", "k long")) == [(1,)] and rows(sinks.read(spark, path, "b", "v string")) == [("x",)]
    assert sinks.append(spark, path, "lost", {"a": a}) and sinks.read(spark, path, "a", "k long").count() == 2


def test_records_with_what_belongs_to_them(spark, tmp_path):
    make = spark.createDataFrame
    new = make([("n1", 1, "note", "T", 'b "q"', "w", [("l", "p")], "{}"), ("n2", 2, "note", None, None, None, None, None)], "id string, seq long, kind string, title string, body string, workstream_id string, refs array<struct<locator: string, path: string>>, applicability string")
    links = make([("n1", "r1", "derived_from"), ("n1", "r1", "derived_from"), ("n1", "other", "supported_by"), ("n2", "other", "supported_by"), ("n1", "gone", "references"), ("n2", "r2", "supported_by")], "from_id string, to_id string, relation string")
    records = make([("r1", "w", "superseded"), ("other", "v", "active"), ("r2", None, "superseded")], "id string, workstream_id string, lifecycle string")
    taints = make([("other", "c", "invalidated"), ("r1", "c", "quarantined")], "record string, cause string, taint string")
    assert sinks.append_records(spark, str(tmp_path), "c1", new, links, records, taints, inherit=True)
    assert rows(sinks.read(spark, str(tmp_path), "links", "from_id string, to_id string")) == [("n1", "r1"), ("n2", "other"), ("n2", "r2")]
    assert rows(sinks.read(spark, str(tmp_path), "taints", "record string, cause string, taint string")) == [("n1", "c", "quarantined"), ("n1", "r1", "invalidated"), ("n2", "c", "quarantined")]
    assert rows(sinks.read(spark, str(tmp_path), "chunks", "record long, field string")) == [(1, "body"), (1, "refs"), (1, "title")]
    hashes = {r.id: r.content_hash for r in sinks.read(spark, str(tmp_path), "records", "id string, content_hash string").collect()}
    said = json.dumps(["note", "T", 'b "q"', '[{"locator":"l","path":"p"}]', "{}"], separators=(",", ":"))
    assert hashes["n1"] == "sha256:" + hashlib.sha256(said.encode()).hexdigest()
    assert hashes["n2"] == "sha256:" + hashlib.sha256(b'["note",null,null,"[]",null]').hexdigest()


def test_calls_keep_named_arguments_only(spark):
    calls = spark.createDataFrame(
        [
            (1, "memory_recall", '{"query":"q","kinds":["note"],"secret":"s","continuation":"c"}', '{"empty":true}', ["a"], 5, False), (2, "memory_record", '{"kind":"note","body":"héllo"}', '{"recordId":"r"}', None, 4, None),
            (3, "memory_read", '{"recordId":"r"}', '{"nextOffset":null}', ["r"], 0, False), (4, "memory_recall", '{"query":"q"}', "{}", ["a"], 9, True), (5, "stop", "torn", None, None, 1, False), (6, "memory_bootstrap", "{}", '{"context":{"empty":false,"continuation":"x"}}', [], 8, False),
        ],
        "id long, name string, args string, result string, returned array<string>, bytes long, private boolean",
    )
    got = {r.id: r for r in sinks.described_calls(calls).collect()}
    assert (got[1].query, got[1].params, got[1].empty, got[1].continued, got[1].tokens) == ("q", {"kinds": '["note"]'}, True, True, 2)
    assert (got[2].params, got[2].returned) == ({"kind": '"note"', "textBytes": "6"}, ["r"]) and (got[3].continues, got[6].continues, got[6].empty) == (False, True, False)
    assert (got[4].query, got[4].params, got[4].returned, got[4].erased) == (None, {}, [], "private") and got[5].params == {}


def test_ledger_lines(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert sinks.read_ledger(spark, path).count() == 0
    spark.createDataFrame([(1, "l1", None, "retract", "r1"), (1, "l2", "private_session", None, None)], "v int, id string, kind string, action string, recordId string").withColumn("sessionId", F.when(F.col("kind").isNotNull(), "s")).coalesce(1).write.json(path)
    with open(f"{path}/more.json", "w") as f:
        f.write('{"v":1,"id":"l3","recordId":"r2"}\n\n{"v":2,"id":"l4","recordId":"r"}\n{"v":1,"id":5}\n{"v":1,"id":"l6"}\n{"v":1,"id":"l7","kind":"other","recordId":"r"}\n{"v":1,"id":"to')
    assert {r.id for r in sinks.read_ledger(spark, path).collect()} == {"l1", "l2", "l3"}
    sinks.append_ledger(spark.createDataFrame([(1, "l8", "r")], "v int, id string, recordId string"), path)
    assert sinks.read_ledger(spark, path).count() == 4
