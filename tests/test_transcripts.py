"""Lines with offsets, shell reads and the transcripts of both hosts on hand-written files."""

import json
import random

import pytest

from memoria.functions import shell
from memoria.operators import transcripts
from memoria.sources import jsonl


def by_loop(data, since=0, longest=jsonl.LINE_BYTES):
    out, at = [], since
    while (stop := data.find(b"\n", at)) >= 0:
        out.append((at, stop + 1, None if stop - at > longest else data[at:stop].decode("utf-8", "replace")))
        at = stop + 1
    return out


@pytest.mark.parametrize("data", [b"", b"\n", b"torn", b"a\r\nb\r\n", "é😀\nñ\n\n\ntail".encode(), b"x" * 70 + b"\nshort\n" + b"y" * 200 + b"\n", b"\xff\xfe\nok\n"])
def test_lines_equal_a_byte_loop(spark, tmp_path, data):
    path = str(tmp_path / "t.jsonl")
    open(path, "wb").write(data)
    for split in (7, 1 << 20):
        got = jsonl.read_lines(spark, [path], split=split, longest=100).orderBy("start").collect()
        assert [(r.start, r.end, r.text) for r in got] == by_loop(data, longest=100)
    starts = [s for s, _, _ in by_loop(data)]
    for since in starts[1:2]:
        got = jsonl.read_lines(spark, [path], {path: since}, split=5, longest=100).orderBy("start").collect()
        assert [(r.start, r.end, r.text) for r in got] == by_loop(data, since, longest=100)


def test_lines_of_random_cuts():
    rng = random.Random(0)
    for _ in range(300):
        data = bytes(rng.choice(b"ab\n") for _ in range(rng.randint(0, 40)))
        split, piece = rng.randint(1, 12), rng.randint(1, 9)
        got = []
        for start in range(0, len(data), split):
            at = start if start == 0 else start - 1
            chunks = (data[k : k + piece] for k in range(at, len(data), piece))
            got += [(s, e, t.decode()) for s, e, t in jsonl.lines(chunks, at, min(start + split, len(data)), start == 0)]
        assert got == by_loop(data)


def test_lines_before_a_cursor_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t.jsonl")
    open(path, "wb").write(b"one\ntwo\nthree\n")
    reader = jsonl._Reader({"paths": json.dumps([path, path + ".gone"]), "since": json.dumps({path: 8}), "splitbytes": "3"})
    assert [(p.start, p.end) for p in reader.partitions()] == [(8, 11), (11, 14)]
    assert jsonl.read_lines(spark, []).count() == 0


READS = [
    ("cat a.txt", ["/w/a.txt"], ("/w/a.txt", "plain", None, None)), ("cat -n a", ["/w/a"], ("/w/a", "numbered", None, None)), ("nl -b a a", ["/w/a"], ("/w/a", "numbered", None, None)),
    ("sed -n '1,20p' d/x.py", ["/w/d/x.py"], ("/w/d/x.py", "plain", 1, 20)), ("sed -n 5p a", ["/w/a"], ("/w/a", "plain", 5, 5)), ("head -n5 a", ["/w/a"], ("/w/a", "plain", 1, 5)),
    ("nl -ba a | sed -n '5,9p'", ["/w/a"], ("/w/a", "numbered", 5, 9)), ("cd d && cat a", ["/w/d/a"], ("/w/d/a", "plain", None, None)), ("bash -lc 'cat \"a b\"'", ["/w/a b"], ("/w/a b", "plain", None, None)),
    ("cat a 2>&1 | head -n 3", ["/w/a"], ("/w/a", "plain", 1, 3)), ("cat a\\ b 2>/dev/null", ["/w/a b"], ("/w/a b", "plain", None, None)), ("cat a#b~", ["/w/a#b~"], ("/w/a#b~", "plain", None, None)),
    ("cat a b", ["/w/a", "/w/b"], None), ("cat *.py", [], None), ("tail -f a", ["/w/a"], None), ("echo hi; cat a", ["/w/a"], None), ("sed -n '/x/,/y/p' f", ["/w/f"], None), ("sed -n -e '1p;3p' a", ["/w/a"], None),
    ("bat --paging=never --style plain a", ["/w/a"], None), ("less -n40 -F a", None, None), ("head -c 1K a", ["/w/a"], None), ("more -20 a", ["/w/a"], None), ("sed -n 1,5p a | sed -n 2p", ["/w/a"], None),
]
NO_READS = [
    "cat ../x", "cat /etc/passwd", "cat a > b", "cat $X", "cat `x`", "cat a || cat b", "cat a &", "ls", "cat", "cat -", "grep x a | cat", "cat a | grep x", "# x", "cat 'a", 'cat "a', "cat a |", "cat a | ; x", "more +5 a",
    "head -n x a", "less -So log a", "less -o log a", "bat --paging=always a", "bat --pager x a", "sed -i s/a/b/ a", "sed -n 's/a/b/p' a", "sed 1p a", "bash -c 'cat a' x", "bash script", "(cat a)", "cat {a,b}", "cat ~/a",
    "cd a b; cat c", "cd *; cat c", "cat a | echo", "", "   ", "cat --unknown a", "cat --number=3 a", "head --lines a", "*at a", "bash -c \"bash -c \\\"bash -c 'cat a'\\\"\"",
]


def test_shell_reads():
    for command, paths, read in READS:
        if paths is None:
            continue
        assert shell.file_reads(command, "/w") == (paths, "artifact_access", read), command
    for command in NO_READS:
        assert shell.file_reads(command, "/w") == ([], "other", None), command
    assert shell.file_reads(["cat", "a b"], "/w") == (["/w/a b"], "artifact_access", ("/w/a b", "plain", None, None))
    assert shell.file_reads("cat x", "/w/d", "/w")[0] == ["/w/d/x"] and shell.file_reads("cat ../../x", "/w/d", "/w")[1] == "other"


def test_every_option_of_the_tables():
    for name, known in shell.READERS.items():
        for letter in known["flags"]:
            assert shell.file_reads(f"{name} -{letter} a", "/w")[1] == "artifact_access", (name, letter)
        for letter in known["n"] + known["t"]:
            quoted = f"'{letter}'"
            assert shell.file_reads(f"{name} -{quoted} 3 a", "/w")[0] == ["/w/a"] and shell.file_reads(f"{name} -{quoted}", "/w")[1] == "other", (name, letter)
        for option in known["long"].split():
            option, kind = option.split(":")
            value = {"-": "", "n": "=3", "t": "=x"}.get(kind, f"={kind.split(',')[0]}")
            assert shell.file_reads(f"{name} --{option}{value} a", "/w")[0] == ["/w/a"], (name, option)
            assert kind in "-t" or shell.file_reads(f"{name} --{option}=?no a", "/w")[1] == "other"


def test_a_command_is_parsed_once(spark):
    calls = spark.createDataFrame([(i, "cat a" if i % 2 else None, "/w") for i in range(50)] + [(99, "cat a", None)], "id long, command string, cwd string")
    got = {r.id: (list(r.paths), r.tool_kind) for r in shell.shell_reads(calls).collect()}
    assert got[1] == (["/w/a"], "artifact_access") and got[0] == got[99] == ([], "other") and len(got) == 51


def line_table(spark, files):
    rows = []
    for name, entries in files.items():
        at = 0
        for e in entries:
            text = e if isinstance(e, str) or e is None else json.dumps(e)
            n = len((text or "").encode()) + 1
            rows.append((name, at, at + n, text))
            at += n
    return spark.createDataFrame(rows, "transcript string, start long, end long, text string")


def entry(kind, content=None, **more):
    e = {"type": kind, "uuid": more.pop("uuid", "u"), "timestamp": "2026-01-01T00:00:00Z", "cwd": "/w", "version": "2.1.200", "gitBranch": "main"}
    if content is not None:
        e["message"] = {"content": content}
    return e | more


def test_host_a(spark):
    use = lambda i, name, **given: {"type": "tool_use", "id": f"c{i}", "name": name, "input": given}
    s = [
        entry("user", " hello <system-reminder>x</system-reminder>\n", uuid="u1"),
        entry("assistant", [{"type": "thinking", "thinking": "h"}, {"type": "text", "text": " said "}, {"type": "text", "text": "  "}, use(1, "Bash", command="cat a.py"), {"type": "other"}], uuid="u2"),
        entry("user", [{"type": "tool_result", "tool_use_id": "c1", "content": [{"type": "text", "text": "l1"}, {"type": "image"}, {"type": "tool_reference"}]}], uuid="u3", toolUseResult={"stdout": "l1", "stderr": ""}),
        entry("assistant", [use(2, "Read", file_path="sub/../b.py", offset=3, limit=2), use(3, "Grep", pattern='a"b', path="/w"), use(4, "WebFetch", url="https://x.y/z"), use(5, "mcp__m__memory_recall", q=1), use(6, "Odd", z=1), use(7, "Task", description="d")], uuid="u4"),
        entry("user", [{"type": "tool_result", "tool_use_id": "c2", "content": "3\tx", "is_error": True}], uuid="u5", toolUseResult={"type": "text", "file": {"startLine": 3, "numLines": 2, "totalLines": 9}}),
        entry("user", [{"type": "text", "text": "one"}, {"type": "document"}, {"type": "text", "text": "two"}], uuid="u6"),
        entry("user", "skill", uuid="u7", isMeta=True), entry("user", "note", uuid="u8", origin={"kind": "task"}), entry("user", "mine", uuid="u9", origin={"kind": "human"}),
        entry("user", [{"type": "text", "text": "sum"}], uuid="u10", isCompactSummary=True), entry("system", uuid="u11", subtype="away_summary") | {"content": " recap "}, entry("system", uuid="u12", subtype="other") | {"content": "x"},
        {"type": "summary"}, {"type": "brand-new"}, entry("attachment"), "not json", "[1]", None, {"no": "type"}, entry("user", 5, uuid="u13"), entry("user", "x", uuid=7),
        entry("user", [{"type": "tool_result", "tool_use_id": "c7", "content": "report"}], uuid="u14", toolUseResult={"agentId": "k1"}),
        entry("user", [{"type": "tool_result", "tool_use_id": "c8", "content": "kept"}], uuid="u15", toolUseResult={"agentId": "gone"}),
    ]
    sub = [entry("user", "do it", uuid="s1", isSidechain=True, agentId="k1"), entry("assistant", [{"type": "text", "text": "done"}], uuid="s2", isSidechain=True), entry("user", "late", uuid="s3", version="3.0.0"), entry("user", "never", uuid="s4")]
    agents = spark.createDataFrame([("s/agent-k1", "helper")], "transcript string, agent_type string")
    events, excluded, stops = transcripts.a_events(line_table(spark, {"s": s, "s/agent-k1": sub}), agents)
    found = {r.event_id: r for r in events.collect()}
    assert set(found) == {"u1", "u2#1", "u2#3", "u3", "u4", "u4#1", "u4#2", "u4#3", "u4#4", "u4#5", "u5", "u6", "u9", "u10", "u11", "u15", "s1", "s2"}
    e = found.get
    assert (e("u1").text, e("u1").role, e("u1").type, e("u1").git_branch, e("u1").line_start) == ("hello", "user", "message", "main", 0)
    assert (e("u2#1").text, e("u2#1").role) == ("said", "assistant")
    call = e("u2#3")
    assert (call.summary, call.paths, call.tool_kind, tuple(call.read)) == ("$ cat a.py", ["/w/a.py"], "artifact_access", ("/w/a.py", "plain", None, None))
    assert (e("u3").text, e("u3").intact, e("u3").call_id, e("u3").is_error) == ("l1", True, "c1", False)
    assert (e("u4").summary, e("u4").paths, tuple(e("u4").read)) == ("Read sub/../b.py (lines 3-4)", ["sub/../b.py"], ("/w/b.py", "read_tool", None, None))
    assert [e(f"u4#{k}").summary for k in (1, 2, 3, 4, 5)] == ['Grep "a\\"b" in /w', "WebFetch https://x.y/z", 'memory_recall {"q":1}', "Odd [arguments omitted]", "Task: d"]
    assert (e("u4#2").urls, e("u4#3").tool_kind, e("u4#4").input_digest[:7]) == (["https://x.y/z"], "own", "sha256:")
    assert (e("u5").is_error, e("u5").intact, tuple(e("u5").window)) == (True, True, (3, 2, 9))
    assert (e("u6").text, e("u9").text, e("u10").type, e("u10").text, e("u11").text, e("u15").text) == ("one\ntwo", "mine", "host_summary", "sum", "recap", "kept")
    assert (e("s1").role, e("s1").branch, e("s1").agent_type, e("s2").branch) == ("parent_agent", "k1", "helper", "sidechain")
    left = {(r.transcript, r.reason): r.n for r in excluded.collect()}
    assert left == {
        ("s", "injected_context"): 3, ("s", "hidden_reasoning"): 1, ("s", "unsupported_entry"): 2, ("s", "binary"): 2, ("s", "host_metadata"): 4, ("s", "malformed"): 5, ("s", "oversized_entry"): 1, ("s", "subagent_report"): 1,
    }
    assert [tuple(r) for r in stops.collect()] == [("s/agent-k1", sum(len(json.dumps(x)) + 1 for x in sub[:2]), "3.0.0")]
    heads = {r.transcript: tuple(r)[1:] for r in transcripts.a_heads(line_table(spark, {"s": ["junk", {"type": "summary"}, *s], "t": [entry("user", "x", version="9.0.0")]})).collect()}
    assert heads == {"s": ("/w", "2.1.200", True), "t": ("/w", "9.0.0", False)}
    empty = transcripts.a_events(line_table(spark, {"s": s}).limit(0))
    assert [t.count() for t in empty] == [0, 0, 0]


def test_files_of_host_a(spark):
    paths = ["/r/p/s.jsonl", "/r/p/s/subagents/agent-x1.jsonl", "/r/p/s/subagents/agent-x 1.jsonl", "/r/p/s/other.jsonl", "/r/s.jsonl", "/q/p/s.jsonl", "/r/p/s.json"]
    got = transcripts.a_files(spark.createDataFrame([(p,) for p in paths], "path string"), "/r").collect()
    assert sorted(tuple(r) for r in got) == [("/r/p/s.jsonl", "s", None), ("/r/p/s/subagents/agent-x1.jsonl", "s/agent-x1", "s")]


def b(kind, payload, time="t", **more):
    return {"timestamp": time, "type": kind, "payload": payload} | more


def test_host_b(spark):
    meta = lambda i, **more: b("session_meta", {"id": i, "cwd": "/w", "cli_version": "0.130.0", "git": {"branch": "main"}} | more)
    item = lambda **p: b("response_item", p)
    framed = "Wall time: 1 s\nProcess exited with code {}\nOutput:\nbody"
    one = [
        meta("T1"), b("event_msg", {"type": "user_message", "message": " ask ", "images": ["a", "b"]}), b("turn_context", {"cwd": "/w/d"}), b("event_msg", {"type": "agent_message", "message": "answer"}),
        item(type="function_call", name="exec_command", call_id="c1", arguments=json.dumps({"cmd": "cat x", "workdir": "e"})), item(type="function_call_output", call_id="c1", output=framed.format(0)),
        meta("T1", git={}), item(type="function_call", name="shell", call_id="c2", arguments=json.dumps({"command": ["bash", "-lc", "cat y"]})), item(type="function_call_output", call_id="c2", output=framed.format(2)),
        item(type="custom_tool_call", name="apply_patch", call_id="c3", input="*** Update File: a.py\n*** Move to: /w/b.py\n"), item(type="custom_tool_call_output", call_id="c3", output=[{"type": "input_text", "text": "p"}, {"type": "input_image"}, {"type": "z"}]),
        item(type="function_call", name="__memory_recall", namespace="mcp__m", call_id="c4", arguments='{"q":1}'), item(type="function_call", name="odd", call_id="c5", arguments="{no json"),
        item(type="web_search_call", action={"type": "search", "query": "q"}), item(type="local_shell_call", action={"command": ["ls", "-l"]}, call_id="c6"), item(type="function_call", name="write_stdin", call_id="c7", arguments='{"session_id":5,"chars":"pw"}'),
        b("compacted", {"message": "Another language model started to solve this problem x\n short "}), b("compacted", {"message": ""}), item(type="message", role="developer"), item(type="message", role="user", content=[{"text": " <Skill> x"}]),
        item(type="message", role="assistant"), item(type="reasoning"), b("event_msg", {"type": "agent_reasoning_delta"}), b("event_msg", {"type": "token_count"}), b("event_msg", {"type": "new"}), b("world_state", {}), b("new", {}), "torn",
        item(type="image_generation_call"), item(type="compaction"), item(type="function_call", name="x"), None, b("event_msg", {"type": "user_message", "message": "last"}, time="t9"),
    ]
    fork = [meta("T2", forked_from_id="T1"), *[{**e, "timestamp": "f"} for e in one[:4]], b("event_msg", {"type": "user_message", "message": "own"}), {**one[5]}]
    old, paged, bare = [meta("T3", cli_version="0.1.0"), b("event_msg", {"type": "user_message", "message": "x"})], [meta("T4"), b("event_msg", {"type": "user_message", "message": "x"}), b("event_msg", {"type": "user_message", "message": "y"}, ordinal=4)], [b("event_msg", {})]
    lines = line_table(spark, {"T1": one, "T2": fork, "T3": old, "T4": paged, "T5": bare})
    at = {(r.transcript, r.start): r.end for r in lines.collect()}
    offsets = {t: sorted(s for u, s in at if u == t) for t in ("T1", "T2", "T4")}
    events, excluded, stops = transcripts.b_events(lines)
    found = {(r.transcript, r.line_start): r for r in events.collect()}
    e = lambda k: found["T1", offsets["T1"][k]]
    assert (e(1).text, e(1).role, e(1).cwd, e(1).git_branch, e(1).event_id) == ("ask", "user", "/w", "main", f"T1@{offsets['T1'][1]}")
    assert (e(3).text, e(3).role, e(3).cwd) == ("answer", "assistant", "/w/d")
    assert (e(4).summary, e(4).paths, e(4).tool_kind) == ("$ cat x", ["/w/d/e/x"], "artifact_access")
    assert (e(5).text, e(5).is_error, e(5).intact, e(5).git_branch) == ("body", False, True, "main")
    assert (e(7).summary, e(7).paths, e(7).git_branch, e(8).is_error) == ("$ bash -lc cat y", ["/w/d/y"], None, True)
    assert (e(9).summary, e(9).paths, e(10).text, e(10).intact) == ("apply_patch a.py, /w/b.py", ["/w/d/a.py", "/w/b.py"], "p", None)
    assert (e(11).tool, e(11).summary, e(11).tool_kind, e(12).summary, e(12).input_digest[:7]) == ("mcp__m__memory_recall", 'memory_recall {"q":1}', "own", "odd [arguments omitted]", "sha256:")
    assert [e(k).summary for k in (13, 14, 15)] == ['web_search "q"', "$ ls -l", "write_stdin → session 5"] and e(13).call_id == f"T1@{offsets['T1'][13]}"
    assert (e(16).type, e(16).text, e(32).observed_at) == ("host_summary", "short", "t9")
    assert {k for t, k in found if t == "T1"} == {offsets["T1"][k] for k in (1, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 32)}
    left = {r.reason: r.n for r in excluded.where("transcript = 'T1'").collect()}
    assert left == {"binary": 4, "host_metadata": 8, "unsupported_entry": 3, "injected_context": 2, "hidden_reasoning": 2, "malformed": 2, "oversized_entry": 1}
    # The fork's first lines (its parent's meta and three more) keep the parent's identity and time.
    copies = [found["T2", offsets["T2"][k]] for k in (2, 4)]
    assert [(c.event_id, c.observed_at) for c in copies] == [(f"T1@{offsets['T1'][k]}", "t") for k in (1, 3)]
    assert [found["T2", offsets["T2"][k]].event_id for k in (5, 6)] == [f"T2@{offsets['T2'][k]}" for k in (5, 6)]
    assert sorted(tuple(r) for r in stops.collect()) == [("T3", 0, "0.1.0"), ("T4", offsets["T4"][2], "0.130.0+paginated"), ("T5", 0, "missing")]
    assert {r.text for r in events.where("transcript = 'T4'").collect()} == {"x"}


def test_versions(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(v,) for v in ("0.125.0-alpha.2", "0.125.0-alpha.3", "0.125.0", "0.142.5", "0.143.0", "0.148.0-alpha.21", "0.148.0-alpha.22", "0.148.0", "x", "", None)], "v string")
    assert [r[0] for r in rows.select(transcripts.supported(F.col("v"), transcripts.B_VERSIONS)).collect()] == [False, True, True, True, False, True, False, False, False, False, False]
