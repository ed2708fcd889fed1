"""BM25, tiers, relevance bands, trust order, vector scan and fusion. All windows are by query, so one plan ranks many."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import stemming, text

K1, B = 1.2, 0.75
RELEVANT, CLOSE, BAND = 0.5, 0.9, 0.9
RRF, MEANING_ONLY = 60, 10


def postings(chunks: DataFrame, id_col: str = "seq", body: str = "body") -> DataFrame:
    """(id, term, tf)."""
    return chunks.select(F.col(id_col).alias("id"), F.explode(text.tokens(F.col(body))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def stem_postings(index: DataFrame, stems: DataFrame) -> DataFrame:
    """The postings by stem, counts of terms with one stem added up within each id. Lengths stay as they are."""
    return stemming.stemmed(index, stems).groupBy("id", "term").agg(F.sum("tf").alias("tf"))


def lengths(index: DataFrame) -> DataFrame:
    return index.groupBy("id").agg(F.sum("tf").alias("dl"))


def bm25(index: DataFrame, query_terms: DataFrame, eligible: DataFrame | None = None, length: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): lower is better. Statistics are of all chunks in the index, eligible or not; eligible, if
    given, are the ids that may be found, and is asked before anything is summed.

    The index's rows are joined with the asked terms first, so only postings of those are weighed; lengths and document
    frequencies are aggregates over the index that share its shuffle by term or id.
    """
    length = lengths(index) if length is None else length
    whole = length.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    terms = query_terms.select("term").distinct()
    df = index.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = df.crossJoin(F.broadcast(whole)).select("term", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"), "avgdl")
    found = index.join(terms, "term", "left_semi")
    if eligible is not None:
        found = found.join(eligible.select("id"), "id", "left_semi")
    hits = found.join(length, "id").join(weighed, "term").join(query_terms, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "id").agg(F.round(-F.sum(part), 6).alias("score"))


def asked_postings(chunks: DataFrame, words: DataFrame, body: str = "body") -> DataFrame:
    """(seq, parts): of every record with a word its chunks, each with its length and how often it has each asked term.

    chunks: seq, ordinal and the text; words: word, term, the words that stand for an asked term (their own or their stem).
    Texts are shuffled once, by seq; other words are only counted, so nothing but asked terms is kept. Rows of one seq
    and ordinal are one chunk."""
    rows = chunks.repartition("seq").select("seq", "ordinal", F.explode(text.tokens(F.col(body))).alias("word"))
    counted = rows.join(words.select("word", "term"), "word", "left").groupBy("seq", "ordinal", "term").agg(F.count("*").alias("tf"))
    known = F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
    part = counted.groupBy("seq", "ordinal").agg(F.sum("tf").alias("dl"), F.collect_list(known).alias("found"))
    part = part.select("seq", F.struct("dl", F.col("found.term").alias("terms"), F.col("found.tf").alias("tfs")).alias("part"))
    return part.groupBy("seq").agg(F.collect_list("part").alias("parts"))


def weighed(postings: DataFrame, query_terms: DataFrame) -> DataFrame:
    """(query_id, term, idf, avgdl) of asked terms that some chunk has. Statistics are of all chunks."""
    whole = postings.select(F.explode("parts.dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = postings.select(F.explode(F.flatten("parts.terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = df.crossJoin(F.broadcast(whole)).select("term", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"), "avgdl")
    return query_terms.join(df, "term").select("query_id", "term", "idf", "avgdl")


def _scores(asked: pa.Table, held: pa.Table, cells: int = 2_000_000) -> tuple[pa.Array, np.ndarray]:
    """The queries, and of every held record (rows) its best chunk's weight for each of them: 0 where no term is in common."""
    queries, terms = (asked.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
    weight = np.zeros((len(terms.dictionary), len(queries.dictionary)))
    np.add.at(weight, (terms.indices.to_numpy(), queries.indices.to_numpy()), asked.column("idf").to_numpy())
    avgdl = asked.column("avgdl")[0].as_py()
    parts = pa.concat_arrays(held.column("parts").chunks)
    upto = parts.value_lengths().to_numpy().cumsum()
    parts = parts.flatten()
    dl, found, tf = (parts.field(c) for c in ("dl", "terms", "tfs"))
    of = np.repeat(np.arange(len(dl)), found.value_lengths().to_numpy())
    code = pc.fill_null(pc.index_in(found.flatten(), terms.dictionary), -1).to_numpy(zero_copy_only=False)
    dl, tf = dl.to_numpy(), tf.flatten().to_numpy()
    value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[of] / avgdl))
    of, code, value = (x[code >= 0] for x in (of, code, value))
    out = np.zeros((held.num_rows, len(queries.dictionary)))
    # Records in slices, so that chunks times terms stay within the cells (one record is never cut).
    low = 0
    while low < len(upto):
        start = upto[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(upto, start + max(1, cells // len(weight)), "right")))
        a, b = np.searchsorted(of, (start, upto[high - 1]))
        x = np.zeros((upto[high - 1] - start, len(weight)))
        x[of[a:b] - start, code[a:b]] = value[a:b]
        out[low:high] = np.maximum.reduceat(x @ weight, np.concatenate([[0], upto[low : high - 1] - start]), axis=0)
        low = high
    return queries.dictionary, out


def _meet(held: DataFrame, asked: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, sizes: tuple[int, int], block: int, part: int) -> DataFrame:
    """work over every pair of a block of queries and a part of the records; sizes: how many queries and records there are."""
    blocks, parts = (-(-max(n, 1) // size) for n, size in zip(sizes, (block, part), strict=True))
    deal = lambda df, by, own, other, n, m: df.withColumn(own, F.pmod(F.xxhash64(by), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    q, h = deal(asked, "query_id", "block_", "part_", blocks, parts), deal(held, "seq", "part_", "block_", parts, blocks)
    return q.groupBy("block_", "part_").cogroup(h.groupBy("block_", "part_")).applyInArrow(work, schema)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def totals(postings: DataFrame, asked: DataFrame, able: DataFrame, block: int = 500, part: int = 4000) -> DataFrame:
    """(query_id, matches, best): how many of the able records each query matches, and the best (lowest) score. A part of
    the records leaves one row a query; scores themselves are never shuffled."""
    kinds = [f"query_id {_kind(asked, 'query_id')}", "matches long", "best double"]

    def work(queries: pa.Table, held: pa.Table) -> pa.Table:
        if not (queries.num_rows and held.num_rows):
            return pa.table([pa.array([], queries.schema.field("query_id").type), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "matches", "best"])
        ids, weight = _scores(queries, held)
        n = (weight > 0).sum(axis=0)
        return pa.table([ids, n, np.round(-weight.max(axis=0), 6) + 0.0], names=["query_id", "matches", "best"]).filter(pa.array(n > 0))

    sizes = (asked.select("query_id").distinct().count(), postings.count())
    found = _meet(postings.join(able.select("seq"), "seq"), asked, work, ", ".join(kinds), sizes, block, part)
    return found.groupBy("query_id").agg(F.sum("matches").alias("matches"), F.min("best").alias("best"))


def matches(postings: DataFrame, asked: DataFrame, block: int = 500, part: int = 4000) -> DataFrame:
    """(query_id, seq): the records that each query matches, in any chunk and by any term, each pair once. postings have one
    row a seq, so pairs are whole where they are made and are not shuffled."""

    def work(queries: pa.Table, held: pa.Table) -> pa.Table:
        if not (queries.num_rows and held.num_rows):
            return pa.table([pa.array([], t.schema.field(c).type) for t, c in ((queries, "query_id"), (held, "seq"))], names=["query_id", "seq"])
        ids, weight = _scores(queries, held)
        rows, of = np.nonzero(weight > 0)
        return pa.table([ids.take(pa.array(of)), held.column("seq").take(pa.array(rows))], names=["query_id", "seq"])

    sizes = (asked.select("query_id").distinct().count(), postings.count())
    return _meet(postings, asked, work, f"query_id {_kind(asked, 'query_id')}, seq {_kind(postings, 'seq')}", sizes, block, part)


def by_score(score: np.ndarray, row: dict[str, np.ndarray], query: dict) -> list[np.ndarray]:
    """The order of top: score, newest, highest seq."""
    return [score, -row["created_at"], -row["seq"]]


def by_tier(score: np.ndarray, row: dict[str, np.ndarray], query: dict) -> list[np.ndarray]:
    """The order of tiers, of rows with verbatim and in_window and queries with best and now."""
    windowed = (score <= RELEVANT * query["best"]) & row["in_window"].astype(bool)
    newest = (score <= CLOSE * query["best"]) & query["now"]
    return [-row["verbatim"], ~windowed, ~newest, np.where(newest, -row["created_at"], np.iinfo(np.int64).max), *by_score(score, row, query)]


def leading(postings: DataFrame, asked: DataFrame, able: DataFrame, k: int, order: Callable = by_score, block: int = 500, part: int = 4000) -> DataFrame:
    """The able records (all their columns) with query_id and score that may be among the first k of a query: of each part of
    the records the first k by order. What k others of a part come before is behind them in the whole, so nothing is lost.

    order: from scores, number columns of able (times in microseconds) and the query's other columns (equal in its rows of
    asked) to keys, the first weighs most."""
    carried, extra = able.columns, [c for c in asked.columns if c not in ("query_id", "term", "idf", "avgdl")]
    kinds = [f"query_id {_kind(asked, 'query_id')}", "score double", *(f"`{c}` {_kind(asked, c)}" for c in extra), *(f"`{c}` {_kind(able, c)}" for c in carried)]
    numbers = [f.name for f in able.schema if f.dataType.typeName() in ("long", "integer", "double", "boolean", "timestamp")]

    def work(queries: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query_id", "score", *extra, *carried]
        ids, weight = _scores(queries, held) if queries.num_rows and held.num_rows else (queries.column("query_id").combine_chunks()[:0], np.zeros((0, 0)))
        score = np.round(-weight, 6) + 0.0
        times = {c: held.column(c).cast(pa.int64()) if pa.types.is_timestamp(held.column(c).type) else held.column(c) for c in numbers}
        row = {c: x.to_numpy() for c, x in times.items()}
        first = pc.index_in(ids, queries.column("query_id").combine_chunks()).to_pylist()
        said = [{c: queries.column(c)[i].as_py() for c in extra} for i in first]
        rows, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j in range(len(ids)):
            at = np.flatnonzero(weight[:, j] > 0)
            keys = order(score[at, j], {c: x[at] for c, x in row.items()}, said[j])
            rows.append(at[np.lexsort(keys[::-1])[:k]])
            of.append(np.full(len(rows[-1]), j))
        rows, of = np.concatenate(rows), np.concatenate(of)
        columns = [ids.take(pa.array(of)), pa.array(score[rows, of] if len(rows) else np.zeros(0))]
        columns += [queries.column(c).take(pa.array([first[j] for j in of], pa.int64())) for c in extra]
        return pa.table([*columns, *(held.column(c).take(pa.array(rows)) for c in carried)], names=names)

    sizes = (asked.select("query_id").distinct().count(), postings.count())
    return _meet(postings.join(able, "seq"), asked, work, ", ".join(kinds), sizes, block, part)


def per_query(*order: Column) -> Window:
    return Window.partitionBy("query_id").orderBy(*order)


def top(scored: DataFrame, n: int) -> DataFrame:
    """The best n of each query: score, newest, highest seq."""
    ranked = scored.withColumn("rank", F.row_number().over(per_query(F.col("score"), F.desc("created_at"), F.desc("seq"))).cast("long"))
    return ranked.where(F.col("rank") <= n)


def relative(scored: DataFrame) -> DataFrame:
    """Adds relevant and close: at least half, or nine tenths, of the query's best score (its column best, where the rows
    are not all that it matches)."""
    best = F.col("best") if "best" in scored.columns else F.min("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("relevant", F.col("score") <= RELEVANT * best).withColumn("close", F.col("score") <= CLOSE * best)


def tiers(scored: DataFrame, phrases: Column, window: Column, now: Column) -> DataFrame:
    """Adds pos: more verbatim phrases first, then relevant records within the time window, then, where the query asks
    for what holds now, the newest of those close to the best; then plain order. phrases: count; window, now: booleans."""
    rows = relative(scored).withColumn("verbatim", phrases.cast("long")).withColumn("windowed", F.col("relevant") & window).withColumn("newest", F.col("close") & now)
    order = (F.desc("verbatim"), F.desc("windowed"), F.desc("newest"), F.desc(F.when(F.col("newest"), F.col("created_at"))), F.col("score"), F.desc("created_at"), F.desc("seq"))
    return rows.withColumn("pos", F.row_number().over(per_query(*order)).cast("long"))


def bands(ranked: DataFrame, pos: str = "rank", most: int = 500) -> DataFrame:
    """Adds band: a run of about equally relevant rows. A row opens a new band when its score is over nine tenths of the
    band's first, which is state that no window frame has; the fold runs over at most `most` places of a query."""
    step = lambda acc, x: F.struct(
        F.when(acc["lead"].isNull() | (x["score"] > BAND * acc["lead"]), x["score"]).otherwise(acc["lead"]).alias("lead"),
        (acc["band"] + F.when(acc["lead"].isNull() | (x["score"] > BAND * acc["lead"]), 1).otherwise(0)).alias("band"),
        F.concat(acc["out"], F.array(F.struct(x[pos].alias("p"), (acc["band"] + F.when(acc["lead"].isNull() | (x["score"] > BAND * acc["lead"]), 1).otherwise(0)).alias("band")))).alias("out"),
    )
    start = F.struct(F.lit(None).cast("double").alias("lead"), F.lit(-1).alias("band"), F.expr("cast(array() as array<struct<p:bigint,band:int>>)").alias("out"))
    rows = ranked.where(F.col(pos) <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(pos), "score"))).alias("rows"))
    found = rows.select(F.col("query_id").alias("q"), F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("b"))
    return ranked.join(found, (F.col("query_id") == F.col("q")) & (F.col(pos) == F.col("b.p"))).withColumn("band", F.col("b.band").cast("long")).drop("q", "b")


def trust_order(banded: DataFrame, freshness: Column, evidence: Column, inferred: Column, roots: Column, pos: str = "rank") -> DataFrame:
    """Adds trust_pos: within a band fresher first, then better evidence, then what is not an inference, then more
    independent roots, then as before. Bands keep their order."""
    order = (F.col("band"), freshness, evidence, inferred, roots.desc(), F.col(pos))
    return banded.withColumn("trust_pos", F.row_number().over(per_query(*order)).cast("long"))


def best_passage(hits: DataFrame) -> DataFrame:
    """Of each record's chunks the best scored, earliest of ties."""
    w = Window.partitionBy("query_id", "record").orderBy("score", "ordinal")
    return hits.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def vector_scan(queries: DataFrame, stored: DataFrame, block: int = 1000, part: int = 20_000) -> DataFrame:
    """(query_id, record, score, chunks, embedded): the best cosine over a record's chunks, of those that have a vector.

    queries: query_id, q (unit vector); stored: record, values (whole numbers), scale (null where not embedded). Blocks of
    queries meet parts of the store, each pair of them one matrix product in a task; only the best of each record in a
    part leaves it."""
    blocks, parts = (-(-max(df.count(), 1) // size) for df, size in ((queries, block), (stored, part)))
    spread = lambda df, own, other, n, m: df.withColumn(own, F.pmod(F.xxhash64(df.columns[0], F.monotonically_increasing_id()), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    q = spread(queries.select("query_id", F.col("q").cast("array<double>")), "block_", "part_", blocks, parts)
    s = spread(stored.select("record", F.col("values").cast("array<double>"), F.col("scale").cast("double")), "part_", "block_", parts, blocks)
    q, s = (df.withColumns({"block_": F.col("block_").cast("int"), "part_": F.col("part_").cast("int")}) for df in (q, s))

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("query_id", "record", "score", "chunks", "embedded")}
        if asked.num_rows and held.num_rows:
            x = np.stack(asked.column("q").to_numpy(zero_copy_only=False))
            record, at = np.unique(held.column("record").to_numpy(), return_inverse=True)
            scale = held.column("scale").to_numpy(zero_copy_only=False).astype(np.float64)
            has = ~np.isnan(scale)
            cos = np.full((len(x), len(record)), -np.inf)
            if has.any():
                y = np.stack([v for v, h in zip(held.column("values").to_numpy(zero_copy_only=False), has, strict=True) if h])
                np.maximum.at(cos.T, at[has], ((x @ y.T) * scale[has]).T)
            chunks, embedded = np.bincount(at, minlength=len(record)), np.bincount(at[has], minlength=len(record))
            ids = asked.column("query_id").to_numpy()
            out = {"query_id": np.repeat(ids, len(record)), "record": np.tile(record, len(ids)), "score": np.where(np.isinf(cos), np.nan, cos).ravel(), "chunks": np.tile(chunks, len(ids)), "embedded": np.tile(embedded, len(ids))}
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        return pa.table([pa.array(out[c], t, from_pandas=True) for c, t in zip(out, kinds, strict=True)], names=list(out))

    rows = q.groupBy("block_", "part_").cogroup(s.groupBy("block_", "part_")).applyInArrow(best, "query_id long, record long, score double, chunks long, embedded long")
    return rows.groupBy("query_id", "record").agg(F.round(F.max("score"), 6).alias("score"), F.sum("chunks").alias("chunks"), F.sum("embedded").alias("embedded"))


def vector_top(queries: DataFrame, stored: DataFrame, k: int, block: int = 1000, part: int = 4000) -> DataFrame:
    """(query_id, record, score, rank): of each query the k records with the best cosine of any of their chunks, ties by
    the higher record. Input as for vector_scan; chunks without a vector are not compared.

    Blocks of queries meet parts of the store, and each pair of them keeps only k records a query, so what is shuffled is
    queries times parts times k. That loses nothing however a record's chunks are dealt out: a record that k others beat
    in a part is beaten by them in the whole."""
    blocks, parts = (-(-max(df.count(), 1) // size) for df, size in ((queries, block), (stored, part)))
    spread = lambda df, own, other, n, m: df.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    q = spread(queries.select("query_id", F.col("q").cast("array<double>")), "block_", "part_", blocks, parts)
    s = spread(stored.where("scale is not null").select("record", F.col("values").cast("array<double>"), F.col("scale").cast("double")), "part_", "block_", parts, blocks)

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if asked.num_rows and held.num_rows:
            x = np.stack(asked.column("q").to_numpy(zero_copy_only=False))
            record, at = np.unique(held.column("record").to_numpy(), return_inverse=True)
            y = np.stack(held.column("values").to_numpy(zero_copy_only=False)) * held.column("scale").to_numpy()[:, None]
            # Chunks in the order of their records, queries a hundred at a time.
            y = y[np.argsort(at, kind="stable")]
            starts = np.concatenate([[0], np.cumsum(np.bincount(at))[:-1]])
            ids = asked.column("query_id").to_numpy()
            for low in range(0, len(x), 100):
                cos = np.maximum.reduceat(np.round(y @ x[low : low + 100].T, 6), starts, axis=0)
                for i, query in enumerate(ids[low : low + 100]):
                    first = np.lexsort((-record, -cos[:, i]))[:k]
                    found.append((np.full(len(first), query), record[first], cos[first, i]))
        columns = zip(*found, strict=True) if found else ([np.zeros(0)],) * 3
        return pa.table([pa.array(np.concatenate(c)).cast(t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "record", "score"])

    rows = q.groupBy("block_", "part_").cogroup(s.groupBy("block_", "part_")).applyInArrow(best, "query_id long, record long, score double")
    rows = rows.groupBy("query_id", "record").agg(F.max("score").alias("score"))
    return rows.withColumn("rank", F.row_number().over(per_query(F.desc("score"), F.desc("record"))).cast("long")).where(F.col("rank") <= k)


def trust_reasons(ordered: DataFrame, levels: dict[str, Column], pos: str = "rank") -> DataFrame:
    """Adds a column lifted_<level> for each level (an integer, lower is better), in their order: whether it put the row
    above one that came before it by relevance. A level decides between rows of a band that all earlier levels leave
    alike; the row was lifted there if a worse one of them had an earlier place."""
    same = ["query_id", "band"]
    for name, value in levels.items():
        ordered = ordered.withColumn(f"level_{name}", value.cast("int"))
        worse = Window.partitionBy(*same).orderBy(f"level_{name}").rangeBetween(1, Window.unboundedFollowing)
        ordered = ordered.withColumn(f"lifted_{name}", F.coalesce(F.min(pos).over(worse) < F.col(pos), F.lit(False)))
        same = [*same, f"level_{name}"]
    return ordered.drop(*(f"level_{name}" for name in levels))


def describe_trust(freshness: Column, evidence: Column, attribution: Column, roots: Column, most: int = 20) -> Column:
    """`trusted: current, captured` of what lifted a row (each null where that level did not); null where none did."""
    words = F.filter(
        F.array(
            F.when(freshness == "unknown", "not stale").otherwise(freshness), F.when(evidence == "none", "no asserted run").otherwise(evidence),
            F.when(attribution == "user_direction", "user-given").when(attribution == "direct_observation", "observed").when(attribution.isNotNull(), "inferred"),
            F.when(roots >= most, f"{most}+ roots").when(roots.isNotNull(), F.concat(roots.cast("string"), F.lit(" roots"))),
        ),
        lambda w: w.isNotNull(),
    )
    return F.when(F.size(words) > 0, F.concat(F.lit("trusted: "), F.array_join(words, ", ")))


def fuse(keyword: DataFrame, vector: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, k) and (query_id, id, v), ranks from 0. A record that only vectors found
    must be among their first ten; a keyword match without a vector has its keyword rank in both lists. Records of head
    (query_id, id, place) keep their places before all others and take no rank in either list.

    Adds rrf, pos, meaning_only (no word in common) and meaning: a record with a vector that is not a keyword match or is
    placed above its keyword rank."""
    if head is not None:
        again = lambda rows, c: rows.join(head, ["query_id", "id"], "left_anti").withColumn(c, (F.row_number().over(per_query(F.col(c))) - 1).cast("long"))
        keyword, vector = again(keyword, "k"), again(vector, "v")
    both = keyword.join(vector, ["query_id", "id"], "full").where(F.col("k").isNotNull() | (F.col("v") < MEANING_ONLY))
    share = lambda r: 1 / (F.lit(RRF) + r + 1)
    rrf = F.coalesce(share(F.col("k")), F.lit(0.0)) + share(F.coalesce("v", "k"))
    rows = both.withColumn("rrf", F.round(rrf, 9))
    order = per_query(F.desc("rrf"), F.asc_nulls_last("k"), F.asc_nulls_last("v"), F.col("id"))
    rows = rows.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    rows = rows.withColumn("meaning_only", F.col("k").isNull()).withColumn("meaning", F.col("v").isNotNull() & (F.col("k").isNull() | (F.col("k") > F.col("pos"))))
    if head is None:
        return rows
    lifted = head.groupBy("query_id").agg(F.count("*").alias("lifted"))
    rows = rows.join(lifted, "query_id", "left").withColumn("pos", F.col("pos") + F.coalesce("lifted", F.lit(0))).drop("lifted")
    none = {c: F.lit(None).cast(t) for c, t in (("k", "long"), ("v", "long"), ("rrf", "double"))}
    first = head.select("query_id", "id", F.col("place").cast("long").alias("pos"), F.lit(False).alias("meaning_only"), F.lit(False).alias("meaning")).withColumns(none)
    return rows.unionByName(first.select(*rows.columns))


def claim_groups(records: DataFrame, root: Column) -> DataFrame:
    """(claim, records, roots, first_seq): statements alike but for white space, with how many independent roots state
    them. Records are counted first within each root, so a claim that very many repeat is small when it meets."""
    rows = records.select(text.claim_hash(F.col("body")).alias("claim"), root.alias("root"), "seq")
    per_root = rows.groupBy("claim", "root").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return per_root.groupBy("claim").agg(F.sum("n").alias("records"), F.count("*").alias("roots"), F.min("first").alias("first_seq"))


def claim_copies(records: DataFrame, root: Column) -> DataFrame:
    """(claim, root, representative, copy): of the records of one root that state one claim the earliest stands for the
    others, which are its copies."""
    rows = records.select(text.claim_hash(F.col("body")).alias("claim"), root.alias("root"), "seq", "created_at")
    first = rows.groupBy("claim", "root").agg(F.min_by("seq", F.struct("created_at", "seq")).alias("representative"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, ["claim", "root"]).where("seq <> representative").select("claim", "root", "representative", F.col("seq").alias("copy"))
