"""Chunks, kept tables, vector fills, top-k scans, freshness and trust reasons on hand-made rows, and the upkeep operators."""

import datetime
import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from memoria.functions import text
from memoria.operators import fill, freshness, lineage, ranking, upkeep
from memoria.sources import views


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_chunks_are_titles_pieces_and_references(spark):
    long = "word " * 450
    records = spark.createDataFrame(
        [(1, "a rankSequence", long, [("loc", "src/a.py"), ("url", None), ("", "p")]), (2, None, None, None), (3, "", "", []), (4, "t", long, None)], "seq long, title string, body string, refs array<struct<locator: string, path: string>>"
    )
    got = {(r.record, r.ordinal): (r.field, r.text, r.terms, r.text_hash) for r in upkeep.chunks(records).collect()}
    assert got[1, 0] == ("title", "a rankSequence", "rank Sequence", sha("a rankSequence"))
    body = [got[1, k][1] for k in (1, 2, 3)]
    assert "".join(body) == long and max(map(len, body)) <= 1000 and {got[1, k][0] for k in (1, 2, 3)} == {"body"}
    assert got[1, 4][:2] == ("refs", "loc src/a.py\nurl\np") and (1, 5) not in got
    assert {k for k in got if k[0] != 1} == {(4, 0), (4, 1), (4, 2), (4, 3)}
    assert upkeep.chunks(records.drop("refs").limit(0)).count() == 0


def test_kept_tables_follow_their_folder(spark, tmp_path):
    folder = str(tmp_path / "sf")
    write = lambda n: spark.range(n).coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    read = lambda: views.kept(spark, folder, "t", lambda: spark.read.parquet(f"{folder}/documents.parquet")).count()
    write(3)
    first = (read(), views._kept[spark.sparkContext.applicationId, folder, "t"])
    assert read() == 3 and views._kept[spark.sparkContext.applicationId, folder, "t"] == first[1]
    write(5)
    assert (first[0], read()) == (3, 5)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(first[1][1]).count()


def test_fill_goes_by_regions_and_resumes(spark, tmp_path):
    chunks = spark.createDataFrame(
        [(i, s, o, t, sha(t) if t else None) for i, s, o, t in ((1, 1, 0, "old a"), (2, 2, 0, "own b"), (3, 3, 0, "other c"), (4, 4, 0, "none d"), (5, 5, 0, "new e"), (6, 6, 0, "own b"), (7, 7, 0, "gone"), (8, 2, 1, "own b2"), (9, 3, 1, None))],
        "id long, seq long, ordinal int, text string, text_hash string",
    )
    able = spark.createDataFrame([(1, "w"), (2, "w"), (3, "x"), (4, None), (5, "x"), (6, "x")], "seq long, workstream_id string")
    calls = str(tmp_path / "calls")

    def embed(texts):
        with open(calls, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return pd.DataFrame({"values": [[1, 2]] * len(texts), "scale": 0.5})

    go = lambda **how: fill.fill(chunks, able, str(tmp_path / "v"), "m", embed, "w", top=4, since=1, **how)
    assert go(limit=2, steps=1) == 1
    steps = lambda: rows(fill.stored(spark, str(tmp_path / "v")).join(chunks.select("text_hash", "text").distinct(), "text_hash").select("step", "text"))
    # The newest chunks come first, whatever their workstream; a shared text comes where it is first.
    assert steps() == [(0, "new e"), (0, "own b")]
    assert go(limit=2) == 2 and go(limit=2) == 0
    assert steps() == [(0, "new e"), (0, "own b"), (1, "none d"), (1, "own b2"), (2, "other c")] or steps() == [(0, "new e"), (0, "own b"), (1, "none d"), (1, "other c"), (2, "own b2")]
    asked = open(calls).read().split("\n")[:-1]
    assert sorted(asked) == ["new e", "none d", "other c", "own b", "own b2"]
    # Another model has none yet; what an earlier pass went through is not looked at.
    assert fill.missing(chunks, able, fill.stored(spark, str(tmp_path / "v")), "n", "w", 4, 1, 99).count() == 5


def test_top_of_a_scan_equals_sorting_all(spark):
    rng = random.Random(2)
    vector = lambda: [rng.randint(-3, 3) for _ in range(4)]
    queries = [(q, [float(x) for x in vector()]) for q in range(7)]
    stored = [(rng.randint(0, 9), vector(), rng.choice([0.5, 0.25, None])) for _ in range(60)]
    best = {}
    for q, x in queries:
        for record, y, scale in stored:
            if scale is not None:
                best[q, record] = max(best.get((q, record), -99), round(sum(a * b for a, b in zip(x, y, strict=True)) * scale, 6))
    want = sorted((q, r, s, k + 1) for q, _ in queries for k, (s, r) in enumerate(sorted(((s, r) for (p, r), s in best.items() if p == q), reverse=True)[:3]))
    df, st = spark.createDataFrame(queries, "query_id long, q array<double>"), spark.createDataFrame(stored, "record long, values array<int>, scale double")
    for sizes in ((1000, 20_000), (3, 7)):
        assert sorted(map(tuple, ranking.vector_top(df, st, 3, *sizes).select("query_id", "record", "score", "rank").collect())) == want
    assert ranking.vector_top(df, st.limit(0), 3).count() == 0


def test_trust_reasons_equal_pairs(spark):
    rng = random.Random(3)
    data = [(q, r, r // 6, rng.randint(0, 2), rng.randint(0, 1)) for q in range(3) for r in range(18)]
    df = spark.createDataFrame(data, "query_id long, rank long, band long, a int, b int")
    got = {(r.query_id, r.rank): (r.lifted_a, r.lifted_b) for r in ranking.trust_reasons(df, {"a": F.col("a"), "b": F.col("b")}).collect()}
    for q, r, band, a, b in data:
        before = [(x, y) for p, s, c, x, y in data if p == q and c == band and s < r]
        assert got[q, r] == (any(x > a for x, _ in before), any(x == a and y > b for x, y in before))
    words = spark.createDataFrame([("unknown", "none", None, 25), (None, None, "user_direction", 3), ("current", "captured", "agent_inference", None), (None, None, None, None)], "f string, e string, a string, r int")
    said = [r[0] for r in words.select(ranking.describe_trust(F.col("f"), F.col("e"), F.col("a"), F.col("r"))).collect()]
    assert said == ["trusted: not stale, no asserted run, 20+ roots", "trusted: user-given, 3 roots", "trusted: current, captured, inferred", None]


def test_copies_of_an_event_are_one_source(spark):
    found = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 2, 1), (4, 4, 0)], "seq long, root long, hops long")
    events = spark.createDataFrame([(1, "h", "e"), (2, "h", "e"), (2, "h", "f"), (4, None, "g")], "record long, host string, event_id string")
    assert {r.seq: r.source for r in lineage.source_roots(found, events).collect()} == {1: "e@h", 2: "e@h", 3: "e@h", 4: "record 4"}


BODY = "a\nb\nc\nd"


def test_every_freshness_reason(spark):
    h = lambda s: "sha256:" + sha(s)
    base = dict(check=1, record=1, local=True, remote=False, path="same", sensitive=False, imported=False, commit=None, dirty=None, observed_hash=None, first=None, last=None, cited_hash=None, cited_bytes=None, cited_lines=None)
    cite = dict(observed_hash=h("before"), first=2, last=3, cited_hash=h("b\nc"), cited_bytes=3)
    cases = [
        (dict(observed_hash=h(BODY)), "current", "unchanged"), (dict(local=False, remote=True), "unknown", "remote_unverified"), (dict(local=False), "unknown", "not_checkable"), (dict(path=None), "unknown", "outside_worktree"),
        (dict(sensitive=True, observed_hash=h(BODY)), "unknown", "not_observed"), (dict(path="gone", observed_hash=h("x")), "stale", "missing"), (dict(path="gone", imported=True), "unknown", "transcript_reference"), (dict(path="gone", commit="lost"), "unknown", "unknown_commit"),
        (dict(commit="head"), "unknown", "not_observed"), (dict(commit="head", dirty=False, path="big"), "current", "unchanged"), (dict(commit="old", dirty=False, path="big"), "unknown", "too_large"), (dict(commit="head", dirty=False, path="dirty"), "unknown", "not_observed"),
        (dict(path="locked", observed_hash=h("x")), "unknown", "unreadable"), (dict(path="big", observed_hash=h("x")), "unknown", "too_large"), (dict(observed_hash=h("x")), "stale", "changed"), (cite, "current", "changed_elsewhere"),
        (dict(cite, path="moved"), "current", "lines_moved"), (dict(cite, path="dirty"), "stale", "lines_changed"), (dict(cite, path="twice"), "stale", "changed"), (dict(cite, path="twice", imported=True, observed_hash=None), "unknown", "transcript_reference"),
        (dict(cite, last=4, cited_lines=2, first=1), "current", "lines_moved"), (dict(cite, path="blank", first=1, last=4, cited_lines=2), "current", "changed_elsewhere"), (dict(cite, path="crlf"), "current", "changed_elsewhere"), (dict(cite, first=3, last=2), "stale", "changed"),
        (dict(observed_hash="no hash"), "unknown", "not_observed"),
    ]
    ddl = "check long, place long, record long, local boolean, remote boolean, path string, sensitive boolean, imported boolean, commit string, dirty boolean, observed_hash string, first long, last long, cited_hash string, cited_bytes long, cited_lines long"
    names = [c.split()[0] for c in ddl.split(", ")]
    refs = spark.createDataFrame([tuple({**base, **c, "place": k}[n] for n in names) for k, (c, _, _) in enumerate(cases)], ddl)
    contents = {"same": BODY, "dirty": "zz", "moved": "new\n" + BODY, "twice": BODY + "\n" + BODY, "blank": "\nb\nc\nx", "crlf": BODY.replace("\n", "\r\n")}
    files = [(p, "hashed", len(t), h(t), t.encode()) for p, t in contents.items()] + [("big", "too_large", 1 << 21, None, None), ("locked", "unreadable", 3, None, None)]
    files = spark.createDataFrame(files, "path string, kind string, size long, hash string, content binary")
    state, commits = spark.createDataFrame([("head", ["dirty"])], "head string, dirty array<string>"), spark.createDataFrame([("head",), ("old",), ("head",)], "commit string")
    got = {r.place: (r.verdict, r.reason, r.found_first) for r in freshness.checked(refs, files, state, commits).collect()}
    for k, (case, verdict, reason) in enumerate(cases):
        assert got[k][:2] == (verdict, reason), case
    assert got[16][2] == 3 and got[15][2] is None
    # Only so many references, and so many bytes: later files that fit are still read, each once.
    few = {r.place: r.reason for r in freshness.checked(refs, files, state, commits, per_check=3).collect()}
    assert [few[k] for k in (0, 1, 3, 4, 5)] == ["unchanged", "remote_unverified", "outside_worktree", "not_observed", "check_limit"]
    tight = {r.place: r.reason for r in freshness.checked(refs, files, state, commits, total_bytes=len(BODY) + 3).collect()}
    assert (tight[0], tight[14], tight[16], tight[17]) == ("unchanged", "changed", "check_limit", "lines_changed")
    assert freshness.checked(refs.limit(0), files, state, commits).count() == 0


def test_test_runs(spark):
    df = spark.createDataFrame([("c", "w", "c", "w"), ("c", "w", "d", "w"), (None, "w", "c", "w"), ("c", "w", "c", None)], "a string, b string, c string, d string")
    verdict, reason = freshness.test_run(*map(F.col, "abcd"))
    assert [tuple(r) for r in df.select(verdict, reason).collect()] == [("current", "same_state"), ("stale", "other_state"), ("unknown", "not_fingerprinted"), ("unknown", "not_fingerprinted")]


def test_upkeep_on_ties_nulls_and_repeats(spark):
    make = spark.createDataFrame
    chunks = make([(1, 0, "title", "t", "h1"), (1, 1, "body", "b", "h2"), (2, 0, "body", "b", "h2"), (2, 1, "body", None, None)], "record long, ordinal long, field string, text string, text_hash string")
    vectors = make([("h1",), ("h1",), ("gone",), (None,)], "text_hash string")
    assert rows(upkeep.missing_chunks(chunks.where("text_hash is not null"), vectors, 5)) == [(2, 0, "h2")]
    assert rows(upkeep.orphan_vectors(vectors, chunks)) == [("gone",), (None,)]
    assert rows(upkeep.storable_vectors(make([("h2",), ("h2",), ("new",), ("h1",)], "text_hash string"), vectors, chunks)) == [("h2",)]
    assert rows(upkeep.best_chunk(chunks, F.lit(0))) == [(1, "b"), (2, "b")]
    sessions = make([("a", "h", "x", True), ("b", "h", "x", False), ("c", "h", None, False), ("d", "i", "x", False), ("e", "h", None, True)], "session string, host string, host_session string, private boolean")
    private = upkeep.private_sessions(sessions)
    assert {r.session for r in private.collect()} == {"a", "b", "e"}
    calls = make([(1, "a", "q"), (2, "c", "q"), (3, None, "q")], "id long, session_id string, query string")
    assert rows(upkeep.blanked(calls, private, ["query"]).select("id", "query")) == [(1, None), (2, "q"), (3, "q")]
    events = make([(1, "h", "e"), (2, "h", "e"), (2, "h", "e"), (3, "i", "e"), (4, None, "e"), (5, "h", None)], "record long, host string, event_id string")
    assert rows(upkeep.same_observation(events, events.where("record in (1, 4, 5)"))) == [(1, 2)]
    records = make([(1, "s", "p"), (2, None, "p"), (3, None, None), (1, "s", "p")], "seq long, session_id string, source_id string")
    assert rows(upkeep.left_to_forget(records, make([("s",), (None,)], "session_id string"), make([("p",)], "source_id string"))) == [(1,), (2,)]
    returned = make([(1, "[1,2]"), (2, "[3]"), (3, "no"), (4, None), (5, "[2,2]")], "id long, returned string")
    assert rows(upkeep.calls_returning(returned, make([(2,)], "seq long"))) == [(1,), (5,)]
    summaries = make([(10, "p", 5), (11, "p", 3), (1, "p", 4), (12, None, 9)], "seq long, source_id string, created_at long")
    assert rows(upkeep.late_summaries(summaries, make([(1, "p", 4), (2, "p", 6), (3, None, 1)], "seq long, source_id string, created_at long"))) == [(10, 1)]
    counters = make([("a", 1, "n", 2), ("a", 2, "n", 3), ("a", 1, "missing", 9), ("a", 2, "missing", 1)], "k string, pass int, name string, n long")
    assert rows(upkeep.merge_counters(counters, ["k"], ["missing"])) == [("a", "missing", 1), ("a", "n", 5)]
    changes = make([("w", s, f"r{s}") for s in range(1, 9)] + [(None, 9, "r9")], "workstream_id string, seq long, record string")
    assert rows(upkeep.changes_since(changes, 2, 2)) == sorted([("w", 3, "r3", 4), ("w", 4, "r4", 4), (None, 9, "r9", 0)], key=repr)
    sized = make([("h", 1, 5), ("h", 2, 5), ("h", 3, 1), ("i", 1, 99)], "host string, k int, n int")
    assert rows(upkeep.within_bytes(sized, "host", F.col("n"), [F.col("k")], 10).select("host", "k")) == [("h", 1), ("h", 2)]
    assert upkeep.sample(sized, "host", F.col("k"), "s", 2).count() == 3
    lines = make([("m", 1, "a"), ("m", 2, "a"), ("m", 3, None), ("m", 4, "b")], "branch string, line long, record string")
    assert [r.shown for r in upkeep.shown_before(lines).orderBy("line").collect()] == [1, 1, 1, 2]
    taints = make([(1, 2, 1), (3, 2, 0)], "record long, cause long, label int")
    assert rows(upkeep.upsert_taints(taints, make([(1, 2, 0), (4, 5, 1), (4, 5, 1)], "record long, cause long, label int"))) == [(1, 2, 0), (3, 2, 0), (4, 5, 1)]
    assert upkeep.restored_taints(taints, make([(2,)], "record long")).count() == 0
    links = make([(1, 2, "supported_by"), (1, 2, "supported_by"), (3, 1, "derived_from"), (1, 4, "references")], "from_seq long, to_seq long, relation string")
    related = upkeep.related(links, make([(1, 9), (1, None)], "record long, replacement long"))
    assert rows(related) == sorted([(1, "evidence", 2), (1, "derived", 3), (1, "reference", 4), (1, "replacement", 9)], key=repr)
    bodies = make([(1, "said  this", "agent_inference"), (2, "it said\nthis here", "direct_observation"), (3, None, "direct_observation")], "seq long, body string, attribution string")
    claims = make([(1, 2, "supported_by"), (1, 3, "supported_by"), (2, 1, "supported_by"), (1, 2, "references")], "from_seq long, to_seq long, relation string")
    assert rows(upkeep.captured(claims, bodies, F.col("body"))) == [(1, 2)]
    versions = make([("2.1.183",), ("2.1.9",), ("2.2.0-beta",), ("x",), (None,)], "v string")
    assert [r[0] for r in versions.select(upkeep.within_versions(F.col("v"), "2.1.183", "2.2.0")).collect()][:3] == [True, False, True]
    paths = make([("/w", "/w/a/b"), ("/w", "/w"), ("/w", "/wx"), ("/w", None)], "r string, p string")
    assert [r[0] for r in paths.select(upkeep.relative_path(F.col("r"), F.col("p"))).collect()] == ["a/b", ".", None, None]
    titles = make([("read (error): a: b",), ("run: ok\nmore",), ("none",), (None,)], "t string").select(*upkeep.result_title(F.col("t")))
    assert [tuple(r) for r in titles.collect()] == [("read", True, "a: b"), ("run", False, "ok\nmore"), (None, None, None), (None, None, None)]
    assert text.redact(F.lit(""))[0] is not None


def test_leading_and_totals_equal_plain_ranking(spark):
    """Scores by blocks of queries and parts of records, none of which sees the whole."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    # Ids that repeat, records without words, chunks of one record.
    texts = [(rng.randrange(60), rng.randrange(3), " ".join(rng.choice(words[: rng.randint(1, 30)]) for _ in range(rng.choice([0, 3, 40])))) for _ in range(150)]
    asked = [(q, w) for q in range(9) for w in rng.sample([*words, "nowhere"], 6)]
    chunks = spark.createDataFrame(texts, "seq long, ordinal int, body string")
    terms = spark.createDataFrame(asked, "query_id long, term string")
    able = spark.createDataFrame([(i, datetime.datetime(2024, 1, 1 + i % 5)) for i in range(60) if i % 4], "seq long, created_at timestamp")
    index = ranking.postings(chunks.withColumn("id", F.struct("seq", "ordinal")), "id")
    plain = ranking.bm25(index, terms).groupBy("query_id", F.col("id.seq").alias("seq")).agg(F.min("score").alias("score")).join(able, "seq").localCheckpoint()
    postings = ranking.asked_postings(chunks, views.words(terms)).localCheckpoint()
    weighed = ranking.weighed(postings, terms)
    rows = lambda df: sorted(map(tuple, df.collect()))
    columns = ("query_id", "seq", "score", "rank")
    assert rows(ranking.top(ranking.leading(postings, weighed, able, 7, block=2, part=9), 7).select(*columns)) == rows(ranking.top(plain, 7).select(*columns))
    assert rows(ranking.totals(postings, weighed, able, block=2, part=9)) == rows(plain.groupBy("query_id").agg(F.count("*"), F.min("score")))
    assert not ranking.leading(postings, weighed.where("false"), able, 7).count() and not ranking.totals(postings.where("false"), weighed, able).count()


def test_chunks_are_cut_where_they_lie_and_in_small_batches(spark):
    views.table(spark, "/root/testdata/sf0.001", "documents")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    records = spark.createDataFrame([(1, "a", "b c"), (1, "a", "b c"), (2, "t", "b c"), (3, "", None), (4, None, "")], "seq long, title string, body string")
    made = upkeep.chunks(records)
    assert rows(made.select("record", "ordinal", "field", "text")) == [(1, 0, "title", "a")] * 2 + [(1, 1, "body", "b c")] * 2 + [(2, 0, "title", "t"), (2, 1, "body", "b c")]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
