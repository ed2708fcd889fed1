"""Exact dedup, n-gram Jaccard join, embedding near-dedup and repeated passages against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memoria.llm import exact_dedup, ngram_join, nn_descent, passages
from memoria.llm.common import Forest, components, join_by_key

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def corpus(seed=1):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(voc, k=rng.choice((1, 2, 3, 9, 10, 11, 20, 60, 300)))) for _ in range(60)]
    for t in list(texts[:30]):
        w = t.split()
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                v[rng.randrange(len(v))] = "edit"
            texts.append(" ".join(v))
    base = rng.choices(voc, k=200)
    for i in range(40):  # a large group of near copies
        v = list(base)
        v[i * 5] = "x"
        texts.append(" ".join(v))
    texts += [None, "", " \n\t", "ONE two", "one  TWO", "É é", "é é", "a" * 50_000]
    return list(enumerate(texts))


def brute_groups(rows, k, num, den):
    sets = {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if (w := words(t)) else set() for i, t in rows}
    up = Forest()
    ids = list(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                up.join(a, b)
    return {i: (len(sets[i]), up.find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_ngram_join_equals_brute_force(spark, k, num, den):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs, k=k, num=num, den=den, tile_rows=16, block=8).collect()}
    assert found == brute_groups(rows, k, num, den)


def test_segments_always_meet():
    rng = np.random.default_rng(0)
    for num, den in ((9, 10), (4, 5)):
        m = ngram_join.Measure(num, den)
        for _ in range(400):
            n = int(rng.integers(1, 150))
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            gone, more = int(rng.integers(0, n // 6 + 1)), int(rng.integers(0, n // 6 + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**64, more, dtype=np.uint64)]))
            if len(b) and m.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                assert set(ngram_join._segment_keys(a, m).tolist()) & set(ngram_join._segment_keys(b, m).tolist())


def test_ngram_join_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.similar_groups(docs, k=3).collect()), key=repr) == [(4, 2, 4), (4, 2, 4), (None, 0, None), (None, 2, 4)]
    assert ngram_join.similar_groups(docs.limit(0)).count() == 0
    assert ngram_join.one_of_each(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")).count() == 2


def test_one_of_each_drops_rows_not_ids(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near, "a"), (4, near + " more", "b"), (4, "another text under the same id " * 3, "c"), (None, near + " end", "d"), (None, "alone with a null id and more words", "e")]
    rows += [(7, "the same row twice and some words", "f")] * 2 + [(8, "", "g"), (8, "", "g"), (9, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r.node for r in out.collect()) == ["a", "c", "e", "f", "g", "g", "h"]


def test_common_keys_meet_a_broadcast(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = join_by_key(rows, table, "k", "n", often=100)
    assert out.count() == 5000 and out.where("k = 7 and n = 4000").count() == 4000


def test_exact_groups(spark):
    rows = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (None, "a"), (7, "é"), (7, "é"), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sha", F.lit(1)).repartition(4)
    found = sorted([tuple(r)[:4] for r in exact_dedup.exact_groups(docs).collect()], key=repr)
    want = [(1, 2, 3, False), (2, 2, 3, True), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (7, 7, 2, True), (7, 7, 2, True), (None, 2, 3, False), (None, None, 1, False)]
    assert found == want
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [2, 3, 5, 7, None] and kept.columns == docs.columns
    assert sorted(r.keep_id for r in exact_dedup.exact_groups(docs.where("text = 'a'"), keep="min").collect()) == [1, 1, 1]


def test_a_large_group_spans_partitions(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_dedup.exact_groups(docs).where("text_sha256 = sha2('same', 256)").agg(F.count("*"), F.min("group_size"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(found) == (1334, 1334, 3999, 1)
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == [i for i in range(4000) if i % 3 or i == 3999]


def test_neighbours_decide_whatever_the_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, i, i // 2]), rng.choice(["a", "b", "c" * 40, "c" * 40 + "d", None, "", "e"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        for keep, best in (("max", max), ("min", min)):
            want = {t: (best([i for i in g if i is not None]), len(g)) for t, g in groups.items()}
            found = exact_dedup.exact_groups(docs, keep=keep).collect()
            assert len(found) == 300 and sorted({(r.text_sha256, r.keep_id, r.group_size) for r in found}) == sorted((hashlib.sha256(t.encode()).hexdigest(), *w) for t, w in want.items())
            assert sorted((r.text or "", r.doc_id) for r in exact_dedup.drop_copies(docs, keep=keep).collect()) == sorted((t, w[0]) for t, w in want.items())
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (None, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(5), one_task=one_task).groupBy("component").count().collect()
    assert sorted(map(tuple, found)) == [(1, 200), (1000, 100)]


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1, 2):
        x = rng.normal(size=(150, 16))
        x = np.concatenate([x, x[:40] + rng.normal(size=(40, 16)) * 0.05, np.repeat(x[:1], 60, 0) + rng.normal(size=(60, 16)) * 0.02, x[5:8]])
        rows += [(len(rows) + i, v.astype(np.float32).tolist(), label) for i, v in enumerate(x)]
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, rows[0][1], None), (n + 5, [1.0, 2.0], 1), (n + 6, [2.0, 4.0], 1), (n + 7, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: tuple(r)[1:] for r in nn_descent.similar_vectors(df, cell=64, block=128).collect()}
    up, links = Forest(), defaultdict(int)
    for i, v, a in rows:
        for j, w, b in rows:
            if i < j and a == b:
                x, y = np.array(v, np.float64), np.array(w, np.float64)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                    up.join(i, j)
                    links[i] += 1
                    links[j] += 1
    right = sum(found[i] == (links[i], up.find(i), up.find(i) == i) for i, *_ in rows)
    assert right >= 0.99 * n
    assert [found[n + i] for i in range(5)] == [(0, n + i, True) for i in range(5)] and found[n + 7] == (0, n + 7, True)
    assert found[n + 5] == (1, n + 5, True) and found[n + 6] == (1, n + 5, False)
    assert nn_descent.similar_vectors(df.limit(0)).count() == 0


def test_compact_windows_are_the_wide_nodes_of_the_tree():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, t = int(rng.integers(1, 60)), int(rng.integers(2, 8))
        h = rng.permutation(n).astype(np.uint64) + np.uint64(1)
        if n > 20:
            h[int(rng.integers(0, n))] = 0
        want = set()
        for c in np.flatnonzero(h):
            lo = hi = int(c)
            while lo and h[lo - 1] > h[c]:
                lo -= 1
            while hi < n - 1 and h[hi + 1] > h[c]:
                hi += 1
            if hi - lo + 1 >= t:
                want.add((lo, int(c), hi))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(h, t)), strict=True)) == want


def test_passages_are_found_and_others_left_alone(spark):
    rng = random.Random(3)
    voc = [f"w{i}" for i in range(3000)]
    make = lambda n: " ".join(rng.choices(voc, k=n))
    p = [make(n) for n in (55, 60, 120, 30)]
    near = p[2].split()
    near[40] = "edit"
    rows = [(i, f"{make(rng.randint(5, 90))} {p[0]} {make(20)}") for i in range(30)]
    rows += [(100, f"{make(9)} {p[1]}"), (101, f"{p[1]} {make(70)}"), (102, f"{make(50)} {p[2]}"), (103, " ".join(near) + " " + make(40))]
    rows += [(104, f"{make(60)} {p[3]}"), (105, f"{p[3]} {make(60)}"), (106, None), (107, ""), (108, make(80)), (109, make(200))]
    rows += [(110, rows[-1][1]), (111, "short one"), (112, "short one")]
    out = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in out} == {*range(30), 100, 101, 102, 103, 109, 110}
    text = dict(rows)
    for r in out:
        got = " ".join(words(text[r.doc_id])[r.start_word : r.start_word + r.n_words])
        assert r.n_words >= 50 and r.other_id != r.doc_id
        if r.doc_id < 30:
            assert got == p[0]
    assert {(r.doc_id, r.other_id) for r in out if r.doc_id in (100, 101, 109, 110)} == {(100, 101), (101, 100), (109, 110), (110, 109)}
    assert passages.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_recall_against_brute_force(spark):
    rng = random.Random(11)
    voc = [f"w{i}" for i in range(4000)]
    make = lambda n: rng.choices(voc, k=n)
    line = make(25)
    rows = []
    for k in range(120):  # pairs of documents with a passage of which one copy has edits, some behind a common line
        p = make(rng.randint(55, 120))
        q = list(p)
        for _ in range(len(p) // 50):
            at = rng.randrange(len(q))
            q[at : at + rng.randint(0, 2)] = ["new"] * rng.randint(0, 2)
        rows += [(2 * k, " ".join(make(40) + (line if k % 3 else []) + p + make(9))), (2 * k + 1, " ".join(make(20) + (line if k % 3 else []) + q + make(50)))]
    tokens = {i: passages._tokens(t) for i, t in rows}
    want = {i for a in range(0, 240, 2) for i in (a, a + 1) if passages.matching_passages(tokens[a], tokens[a + 1], 46, 4, 5)}
    found = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block=64, group=16).collect()}
    assert len(want) > 150 and found <= want and len(found) >= 0.99 * len(want)


def test_passages_with_an_insertion_or_a_substitution_are_found(spark):
    rng = random.Random(8)
    voc = [f"w{i}" for i in range(5000)]
    make = lambda n: rng.choices(voc, k=n)
    rows = []
    for k in range(20):
        p = make(50)
        q = [*p[:25], "new", *p[25:]] if k % 2 else [*p[:24], "new", *p[25:]]
        rows += [(2 * k, " ".join(make(30) + p + make(30))), (2 * k + 1, " ".join(make(40) + q + make(20)))]
    out = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {2 * k + o for k in range(20) for o in (0, 1) if k % 2}
    assert {r.doc_id for r in out} >= want
    # A substitution in a passage of 51 words leaves 42 of 52 shingles.
    p = make(51)
    near = [*p[:25], "new", *p[26:]]
    docs = spark.createDataFrame([(1, " ".join(make(9) + p)), (2, " ".join(near + make(9)))], "doc_id long, text string")
    assert {r.doc_id for r in passages.repeated_passages(docs).collect()} == {1, 2}


def test_passages_behind_a_common_line_are_found(spark):
    rng = random.Random(9)
    voc = [f"w{i}" for i in range(5000)]
    make = lambda n: rng.choices(voc, k=n)
    line = make(30)
    rows = [(i, " ".join(make(40) + line + make(40))) for i in range(60)]
    for k in range(10):  # each pair shares the line and no more than 15 words on either side of it
        a, b = make(15), make(15)
        rows += [(100 + 2 * k + o, " ".join(make(20) + a + line + b + make(20))) for o in (0, 1)]
    out = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in out} == {(100 + i, 100 + (i ^ 1)) for i in range(20)}
    assert all(r.n_words == 60 and r.start_word == 20 for r in out)


def test_passages_align_on_every_place_of_a_token():
    rng = np.random.default_rng(4)
    new = lambda n: rng.integers(1, 2**63, n, dtype=np.uint64)
    p = new(60)
    a, b = np.concatenate([new(5), p, new(7)]), np.concatenate([p[:40], new(9), p, new(3), p[20:]])
    assert (5, 65, 49, 109) in passages.matching_passages(a, b, 46, 4, 5)
    same = np.full(300, 7, np.uint64)
    assert (0, 300, 0, 300) in passages.matching_passages(same, same, 46, 4, 5)


def test_passages_of_repetitive_texts_look_a_run_up_once(monkeypatch):
    def noisy(seed):
        rng = np.random.default_rng(seed)
        x = np.tile(np.arange(1, 41, dtype=np.uint64), 20)
        at = np.flatnonzero(rng.random(len(x)) < 0.06)
        x[at] = rng.integers(10**6, 10**9, len(at)).astype(np.uint64)
        return x

    calls, real = [], passages._alike
    monkeypatch.setattr(passages, "_alike", lambda a, b: calls.append(1) or real(a, b))
    assert len(passages.matching_passages(noisy(1), noisy(2), 46, 4, 5)) == 37
    assert len(calls) < 800  # 1,718 when each run was grown anew


def test_surroundings_and_bit_counts_equal_brute_force():
    rng = np.random.default_rng(9)
    tokens = rng.integers(1, 60, 3000).astype(np.uint64)
    start = rng.integers(0, 2900, 2500)
    end = start + rng.integers(1, 100, 2500)
    n, bits = passages._near(tokens, start, end)
    for s, e, k, row in zip(start, end, n, bits, strict=True):
        held = np.unique(tokens[s:e])
        assert k == len(held) and np.flatnonzero(np.unpackbits(row, bitorder="little")).tolist() == held.tolist()
    key, node, open_, side = np.sort(rng.integers(0, 300, 2500)), rng.integers(0, 900, 2500), rng.random(2500) < 0.3, rng.integers(1, 4, 2500)
    batch = pa.RecordBatch.from_arrays([*map(pa.array, (key, node, n, side, open_)), pa.array([r.tobytes() for r in bits], pa.binary())], names=["key", "node", "n", "side", "open", "bits"])
    got = sorted(p for b in passages._alike_pairs(30)(iter([batch])) for p in zip(*b.to_pydict().values(), strict=True))
    sets = [set(tokens[s:e].tolist()) for s, e in zip(start, end, strict=True)]
    want = {(min(node[i], node[j]), max(node[i], node[j])) for i in np.flatnonzero(open_) for j in np.flatnonzero(key == key[i]) if node[i] != node[j] and (side[i] | side[j]) == 3 and len(sets[i] & sets[j]) >= 30}
    assert sorted(set(got)) == sorted(want) and len(want) > 20


def test_texts_of_common_lines_are_not_aligned_pair_by_pair(spark, monkeypatch):
    # The lines stand in every text in another order: all pairs share over 41 shingles near a common line, few a passage.
    rng = random.Random(12)
    lines = [[f"l{i}w{j}" for j in range(20)] for i in range(10)]
    rows = []
    for i in range(60):
        picked = rng.sample(lines, 8)
        rows.append((i, " ".join(w for x in picked for w in [*x, f"n{rng.random()}"])))
    pairs, real = [], passages.stash
    monkeypatch.setattr(passages, "stash", lambda df, *a: (out := real(df, *a), df.columns == ["lead", "node"] and pairs.append(out.count()))[0])
    found = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), block=32).collect()}
    tokens = [passages._tokens(t) for _, t in rows]
    both = [(i, j) for i in range(60) for j in range(i) if passages.matching_passages(tokens[i], tokens[j], 46, 4, 5)]
    assert found == {i for p in both for i in p} and sum(pairs) < 500  # 1,770 pairs in all


def test_every_open_window_with_a_partner_gets_one():
    rng = np.random.default_rng(3)
    half, least = 12, 6
    base = rng.integers(1, 1 << 32, (5, 2 * half + 1), dtype=np.uint64).astype(np.uint32)
    seq = base[rng.integers(0, 5, 150)]
    seq[rng.random(seq.shape) < 0.12] = 0
    seq[seq == 0] = rng.integers(1, 1 << 32, int((seq == 0).sum()), dtype=np.uint64).astype(np.uint32)
    key, node, open_ = np.sort(rng.integers(0, 12, 150)), rng.integers(0, 90, 150), rng.random(150) < 0.5
    columns = [key, node, np.arange(150), np.full(150, 3), open_, np.full(150, half)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([r.tobytes() for r in seq], pa.binary())], names=["key", "node", "set", "side", "any", "least", "tokens"])
    likely = list(passages._likely(6, half, least, 4, 5)(iter([batch])))
    got = {r["set"] for b in passages._partners(6, least, 4, 5)(iter(likely)) for r in b.to_pylist()}

    def fits(i, j):
        a, b = np.isin(seq[i], seq[j]), np.isin(seq[j], seq[i])
        best = lambda f: max(sum(1 if x else -8 for x in f[s:e]) for s in range(half + 1) for e in range(half + 1, 2 * half + 2) if e - s >= least)
        return a.sum() >= 6 and best(a) + best(b) >= 0

    want = {i for i in np.flatnonzero(open_) if any(fits(i, j) for j in np.flatnonzero((key == key[i]) & (node != node[i])))}
    assert got == want and len(want) > 15


def test_tight_clusters_that_link_are_one_component(spark):
    # Within a cluster the cosines are above 0.999, which fills every list; across they are about 0.983.
    rng = np.random.default_rng(6)
    across = np.arccos(0.983)
    centres = [[1.0, 0.0], [np.cos(across), np.sin(across)]]
    x = np.concatenate([np.concatenate([np.tile(c, (60, 1)), np.zeros((60, 14))], 1) + rng.normal(size=(60, 16)) * 0.002 for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    assert near.all()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = nn_descent.similar_vectors(df, sample=1).collect()
    assert {tuple(r)[1:3] for r in found} == {(119, 0)} and sum(r.kept for r in found) == 1
