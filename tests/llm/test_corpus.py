"""Periodic runs, tokenizer alignment and language-model scoring against brute force on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from memoria.llm import alignment, context_mixing, periodic_runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def runs_by_words(words, least=6, times=4):
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def described_by_words(doc, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = runs_by_words(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *longest, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            letters = "abcdefg"[: rng.choice([1, 2, 3, 5])]
            words = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.5:
                words = words[: rng.randint(0, 8)] + words[:5] * rng.randint(3, 9) + words[:3]
            texts.append(words)
        ids = np.array([ord(c) for w in texts for c in w], np.int32)
        got = periodic_runs.find_runs(ids, np.cumsum([len(w) for w in texts]))
        for k, words in enumerate(texts):
            assert runs_by_words(words) == [tuple(r) for r in got[got[:, 0] == k][:, 1:].tolist()]


def test_runs_that_hashes_would_lengthen_are_mended(monkeypatch):
    """Even if all hashes were alike, the word-by-word comparison brings the runs back."""
    monkeypatch.setattr(periodic_runs, "mix", lambda x: x * 0)
    words = list("xyabababababz") + list("qrst")
    got = periodic_runs.find_runs(np.array([ord(c) for c in words], np.int32), np.array([len(words)]))
    assert (2, 10, 2) in [tuple(r) for r in got[:, 1:].tolist()]


def test_periodic_runs(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "b", "A", "é　x", "\x85"]) for _ in range(rng.randint(0, 90))) for _ in range(120)]
    texts += [None, "", " \t\n", "one", "a " * 40_000, "a b c " * 9 + "\n" + "a b " * 9, "x" * 3_000_000 + " y" * 7]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a a a a a a", ""), (7, texts[7], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shown string")
    got = sorted(map(tuple, periodic_runs.periodic_runs(docs, turn_bytes=2000).collect()), key=repr)
    short = [r for r in rows if len(r[1] or "") < 10_000]
    assert sorted((described_by_words(*r[:2]) for r in short), key=repr) == [r for r in got if r[0] not in (124, 126)]
    long = {r[0]: r for r in got}
    assert long[126][1:6] == (1, 1, 7, 1, 7000)
    assert (long[124][1], long[124][4]) == (1, 1) or zlib.crc32(b"124") % 10 == 0
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def alignment_by_loops(rows):
    """The contract word by word: every pair of tokens of a text is compared."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    level = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in level} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in level)}
    held, made = {}, []
    for doc, text in rows:
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        a_bytes = [bytes(byte_of[c] for c in a_tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("\u2581", " ").encode() for p in map(b_tok.id_to_piece, b)]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            made.append((doc, 0, 0, [], [], ""))
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            at = np.cumsum([len(p) for p in parts]).tolist()
            spans.append(list(zip([0, *at[:-1]], at, strict=True)))
        links = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (t, f) in zip(b, spans[1], strict=True) if s < f and t < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, where, strict=True) if low <= s and e <= high) for ids, where in ((a, spans[0]), (b, spans[1]))))
        for pair in set(links):
            held[pair] = held.get(pair, 0) + 1
        made.append((doc, len(a), len(b), groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    return [(doc, na, nb, len(g), len(ls), sum(held[p] == most[p[0]] for p in ls), sum(held[p] for p in ls), sha) for doc, na, nb, g, ls, sha in made]


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment(spark):
    texts = [None, "", "a", " ", "Hello <|endoftext|> world <s> x", "\u2581 is no space", "é　b 😀 ñandú", "x\x00y", " " * 1500 + "end", "tab\tand\r\nlines  two", "abc " * 300]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y"), (None, "no id", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, turn string")
    for turn in (40, 4_000_000):
        got = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"), turn_bytes=turn)
        assert sorted(map(tuple, got.select("doc_id", *ALIGNED).collect()), key=repr) == sorted(alignment_by_loops([r[:2] for r in rows]), key=repr)
    assert got.where("n_a = 0").count() >= 3
    empty = alignment.align(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    assert empty.count() == 0


def test_alignment_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 2500")
    got = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"), turn_bytes=20_000)
    assert sorted(map(tuple, got.select("doc_id", *ALIGNED).collect()), key=repr) == sorted(alignment_by_loops([tuple(r) for r in docs.select("doc_id", "text").collect()]), key=repr)


def lower(text):
    return (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def counted_by_loops(raws, depth):
    """Counts by context and symbol, one place at a time."""
    found = {}
    for raw in raws:
        padded = b"\xff" * depth + raw + b"\xff"
        for i in range(depth, len(padded)):
            for k in range(depth + 1):
                context = sum(padded[i - 1 - j] << (8 * j) for j in range(k))
                key = int(context_key(k, context, depth))
                found.setdefault(key, {}).setdefault(padded[i], 0)
                found[key][padded[i]] += 1
    return found


def context_key(order, context, depth):
    return context_mixing.context_key(order, np.array([context], np.int64), depth)[0]


def counts_of(found):
    keys = np.array(list(found), np.int64)
    after = [sorted(v.items()) for v in found.values()]
    return context_mixing.Counts(keys, np.array([len(a) for a in after], np.int64), np.array([s for a in after for s, _ in a], np.int64), np.array([n for a in after for _, n in a], np.int64))


def test_bit_counts_equal_loops():
    raws = [b"banana band", b"", b"bandana"]
    found = counted_by_loops(raws, 2)
    counts = counts_of(found)
    keys = [*found, 12345]
    symbols = [97, 98, 110, 255, 32]
    pairs = [(k, s) for k in keys for s in symbols]
    for bit, (zeros, ones) in enumerate(counts.bits(np.array([k for k, _ in pairs]), np.array([s for _, s in pairs]))):
        for (k, s), n0, n1 in zip(pairs, zeros.tolist(), ones.tolist(), strict=True):
            under = [(t, n) for t, n in found.get(k, {}).items() if bit == 0 or t >> (8 - bit) == s >> (8 - bit)]
            want = [sum(n for t, n in under if t >> (7 - bit) & 1 == v) for v in (0, 1)]
            assert [n0, n1] == want


def test_probabilities_of_all_symbols_sum_to_one():
    raws = [b"banana band " * 20, b"bandana"]
    depth = 2
    counts = counts_of(counted_by_loops(raws, depth))
    mixer = context_mixing.fit(raws, counts, depth)
    for context in (b"an", b"zz", b"\xff\xff"):
        windows = np.array([(context[0] << 16) | (context[1] << 8) | s for s in range(256)], np.int64)
        assert abs((10 ** context_mixing.log10_probability(windows, counts, mixer, depth)).sum() - 1) < 1e-9


def test_fit_beats_equal_weights():
    docs = [lower(r) for r in open(__file__, encoding="utf-8").read().split("\n\n\n")]
    train, rest = docs[::2], docs[1::2]
    counts = counts_of(counted_by_loops(train, 4))
    windows, codes, _ = context_mixing.windows_of(rest, 4)
    cost = [-context_mixing.log10_probability(windows, counts, m, 4)[codes].sum() / np.log10(2) / len(codes) for m in (context_mixing.fit(train, counts, 4), context_mixing.Mixer.new(4))]
    assert cost[0] < cost[1] < 6


def test_context_mixing(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "The", "cat", "sat", "é　x", "onthe"]) for _ in range(rng.randint(0, 40))) for _ in range(90)] + [None, "", " \t", "\xff", "x" * 50_000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "the end", 2), (5, texts[5], 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    found = []
    for turn in (1_000, 16_000_000):
        got = context_mixing.score(docs, depth=3, turn_bytes=turn).orderBy("doc_id", "n_tokens", "score").collect()
        found.append(got)
    for a, b in zip(*found, strict=True):
        assert a[:5] == b[:5] and abs(a.base_score - b.base_score) < 1e-9 and abs(a.score - b.score) < 1e-6 * (1 + abs(b.score))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = {}
    for i, t, _ in rows:
        if not held(i):
            for w in [*lower(t).split(), None]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = []
    for i, t, _ in rows:
        tokens = [*lower(t).split(), None]
        want.append((i, held(i), len(tokens), sum(w in count for w in tokens), n, round(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in tokens), 6)))
    assert sorted(want, key=repr) == sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found[0]), key=repr)
    # Model scores as a direct computation over all places gives them.
    counts = counts_of(counted_by_loops([lower(t) for i, t, _ in rows if not held(i)], 3))
    few = sorted((r for r in found[1] if r.doc_id is not None and r.n_bytes < 1000), key=lambda r: r.doc_id)
    assert all(r.score < 0 for r in few) and counts.sum[-1] == 4 * sum(len(lower(t)) + 1 for i, t, _ in rows if not held(i))
    by_id = {r.doc_id: r for r in few}
    assert by_id[90].score == by_id[91].score and by_id[90].n_tokens == 1
    assert sum(r.bits_per_byte for r in few if r.n_bytes > 60) / sum(r.n_bytes > 60 for r in few) < 2
    assert context_mixing.score(docs.limit(0)).count() == 0
    only_held = docs.where(F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    assert {r.train_tokens for r in context_mixing.score(only_held, depth=3).collect()} == {0}


def test_mixer_comes_from_all_training_texts(spark):
    rng = random.Random(12)
    # Every text is long: none of them may be left out of the fit.
    texts = [" ".join(rng.choice(["the", "cat", "sat", "é x", "on the", "mat" * rng.randint(1, 3)]) for _ in range(4_000)) for _ in range(6)]
    raws = [lower(t) for t in texts]
    found = counted_by_loops(raws, 3)
    rows = [(int(k), sorted(v), [v[s] for s in sorted(v)]) for k, v in found.items()]
    followed = spark.createDataFrame(rows, "key long, symbols array<long>, counts array<long>")
    want = context_mixing.fit(raws, counts_of(found), 3)
    for part in (7, 1_000_000):
        got = context_mixing.fit_all(followed, 3, part)
        assert np.allclose(got.weights, want.weights, atol=1e-6) and np.allclose(got.refined, want.refined, atol=1e-6)
    assert not np.allclose(want.weights, context_mixing.Mixer.new(3).weights, atol=1e-2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    train = [r for r, h in zip(raws, held, strict=True) if not h]
    counts = counts_of(counted_by_loops(train, 3))
    mixer = context_mixing.fit(train, counts, 3)
    for r in context_mixing.score(docs, depth=3).collect():
        windows, codes, _ = context_mixing.windows_of([raws[r.doc_id]], 3)
        assert abs(r.score - context_mixing.log10_probability(windows, counts, mixer, 3)[codes].sum()) < 1e-6 * abs(r.score)


def test_contexts_come_back_from_their_keys():
    context = np.array([0, 1, 255, 0xFFFFFFFF, 0x80000001], np.int64)
    for order in range(5):
        got = context_mixing.context_of(context_mixing.context_key(order, context, 4), 4)
        assert (got[0] == order).all() and (got[1] == context).all()
