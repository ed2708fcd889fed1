"""Restatement by substring against nested loops."""

import random

from pyspark.sql import functions as F

from memoria.functions import text
from memoria.operators import restatement


def normal(t):
    return " ".join(t.lower().split())


def test_selected_grams_of_a_piece_are_its_texts(spark):
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("ab é😀") for _ in range(rng.randint(0, 200)))
        cut = rng.randint(0, len(t))
        piece = t[cut : cut + rng.randint(0, 120)]
        have = set(restatement.selected_grams(t, 16, 25).tolist())
        want = set(restatement.selected_grams(piece, 16, 25).tolist())
        assert want <= have and bool(want) == (len(piece) >= 40)


def test_pieces_are_bodies_lines_and_sentences(spark):
    body = "A first sentence that is long enough to be known.  Short one. And  another LONG sentence that is known as well!\nA line without an end that is long enough\n\ntiny"
    got = spark.createDataFrame([(body,)], "b string").select(text.restatable(F.col("b"))).first()[0]
    assert got == [
        normal(body), "a first sentence that is long enough to be known.", "and another long sentence that is known as well!", "a line without an end that is long enough",
    ]
    assert spark.createDataFrame([("x " * 5,), (None,)], "b string").select(text.restatable(F.col("b")).alias("p")).where("size(p) > 0").count() == 0


def test_containing_equals_nested_loops(spark, monkeypatch):
    monkeypatch.setattr(restatement, "BLOCK", 3)  # every gram is hot: blocks must lose nothing
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta is", "the"]
    texts = [(i, rng.choice([None, 1, 2]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    pieces = []
    for i in range(80):
        source = texts[rng.randrange(60)][2]
        at = rng.randint(0, max(len(source) - 40, 0))
        piece = source[at : at + rng.randint(40, 60)] if rng.random() < 0.8 else "nothing has this piece of text anywhere at all"
        pieces.append((i, rng.choice([None, 1, 2]), piece))
    pieces += [(80, None, ""), (81, 1, None), (82, None, "x" * 39)]
    t = spark.createDataFrame([*texts, (99, 1, None)], "text_id long, scope long, normal string")
    p = spark.createDataFrame(pieces, "piece_id long, scope long, piece string")
    got = sorted(map(tuple, restatement.containing(t, p).select("text_id", "piece_id").collect()))
    want = sorted((i, j) for i, s, x in texts for j, r, y in pieces if y and len(y) >= 40 and y in x and (r is None or r == s))
    assert got == want and len(want) > 50
    assert restatement.containing(t.limit(0), p).count() == restatement.containing(t, p.limit(0)).count() == 0


LONG = "the cache must be emptied before the tables are read again"


def test_echoes_come_after_what_was_shown(spark):
    shown = spark.createDataFrame([("m", 3, "r1", LONG), ("m", 9, "r1", LONG), ("m", 4, "r2", "too short"), ("s", 1, "r3", LONG), ("m", 5, "r4", None)], "branch string, line long, record string, body string")
    said = spark.createDataFrame([("m", 2, LONG), ("m", 5, "so, THE  cache must\nbe emptied before the tables are read again!"), ("m", 6, None), ("m", 7, "other"), ("s", 1, LONG), ("s", 2, LONG), ("s", 2, LONG)], "branch string, line long, text string")
    assert sorted(map(tuple, restatement.restated_echoes(shown, said).collect())) == [("m", 5, "r1"), ("s", 2, "r3")]


def test_checkpoints_in_the_roots_workstream(spark):
    roots = spark.createDataFrame([(1, "a", LONG), (2, None, LONG + " and more."), (3, "a", LONG), (4, "b", None)], "seq long, workstream_id string, body string")
    points = spark.createDataFrame([(10, "a", "x " + LONG), (11, "b", LONG), (12, "b", LONG + " and more. y"), (13, None, LONG + " and more."), (14, "a", None), (10, "a", "x " + LONG)], "seq long, workstream_id string, body string")
    assert sorted(map(tuple, restatement.restating_checkpoints(roots, points).collect())) == [(10, 1), (12, 2), (13, 2)]


def test_no_nested_loop(spark):
    from memoria import plans

    plan = plans.QUERIES["restating_checkpoints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_few_grams_of_a_piece_find_it_and_scopes_come_along(spark):
    rng = random.Random(6)
    body = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    pieces = spark.createDataFrame([(1, 7, body[100:2900]), (2, 8, body[5:50]), (3, None, body[5:50])], "piece_id long, scope long, piece string")
    texts = spark.createDataFrame([(10, 7, body), (11, 8, body), (12, 7, body[200:])], "text_id long, scope long, normal string")
    assert restatement.grams(pieces, "piece_id", "piece", most=8, with_col="scope").where("id = 1 and scope = 7").count() == 8
    found = lambda **how: sorted(map(tuple, restatement.containing(texts, pieces, **how).select("text_id", "piece_id").collect()))
    assert found() == [(10, 1), (10, 3), (11, 2), (11, 3)]
    assert found(everywhere=False) == [(10, 1), (11, 2)]
