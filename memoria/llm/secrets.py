"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, join_by_key, stash

# The patterns of the three kinds, and the lengths below which a match is dropped.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Kinds in the order in which spans with one start are listed; the last two are the method's own.
KINDS = ("assign", "access", "hex", "live", "copied")
#: Words that stand for a secret in examples.
PLACEHOLDER = "example|changeme|placeholder|your[_-]?|xxxx|dummy|sample"

_SPANS = "array<struct<start:bigint,end:bigint,kind:int>>"


def _matches(text: Column, kind: int, pattern: str) -> Column:
    """A pattern's leftmost non-overlapping matches, and the length of what stands before each of them since the last
    one: a struct kind, found (array of gap, match). Texts without a match skip both passes."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})" if kind else pattern.replace("(?i)", "(?i)(", 1) + ")"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("match"))
    empty = F.expr("cast(array() as array<struct<gap:int,match:string>>)")
    return F.struct(F.lit(kind).alias("kind"), F.when(text.rlike(pattern), found).otherwise(empty).alias("found"))


def _candidates(text: Column) -> Column:
    return F.array(_matches(text, 0, ASSIGN), _matches(text, 1, ACCESS), _matches(text, 2, HEX))


def _has_candidates(text: Column) -> Column:
    return F.coalesce(text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX), F.lit(False))


def _located(texts: DataFrame) -> DataFrame:
    """(text_sha, kind, start, end, value) of the base spans of rows (text_sha, found): a match's end is the running sum
    of gaps and matches up to it. Assignments keep their value alone, where that is long enough."""
    rows = texts.select("text_sha", F.explode("found").alias("k")).select("text_sha", F.col("k.kind").alias("kind"), F.posexplode("k.found").alias("at", "m"))
    size = F.length("m.match").cast("long")
    end = F.sum(F.col("m.gap") + size).over(Window.partitionBy("text_sha", "kind").orderBy("at"))
    rows = rows.select("text_sha", "kind", (end - size).alias("start"), end.alias("end"), F.col("m.match").alias("match"))
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN, 1)).otherwise(F.col("match"))
    return rows.withColumn("value", value).where((F.col("kind") != 0) | (F.length("value") >= ASSIGN_LEAST)).drop("match")


def _shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(found: DataFrame, wide: int, many: int) -> DataFrame:
    """(digest, repositories, owners, live) of every candidate, from rows (digest, repository, owner, placeholder).

    A value that `wide` owners hold is copied. So is one of several owners that `many` repositories hold, or that reads
    like a placeholder. Any other is live, a value of a single owner always. Distinct repositories and owners are
    counted over rows already distinct per task, so a credential that a third of all documents holds shrinks to one row
    per repository before the shuffle.
    """
    pairs = found.groupBy("digest", "repository", "owner").agg(F.max("placeholder").alias("placeholder"))
    counts = pairs.groupBy("digest").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"), F.max("placeholder").alias("placeholder"))
    copied = (F.col("owners") >= wide) | ((F.col("owners") > 1) & ((F.col("repositories") >= many) | F.col("placeholder")))
    return counts.withColumn("live", ~copied)


def _scanned(docs: DataFrame, repository: Column, owner: Column, text_col: str, wide: int, many: int) -> tuple[DataFrame, str, str]:
    """The documents with two more columns, and those columns' names; see scan."""
    key, base, spans, copies = fresh(docs, "key", "base", "spans", "copies")
    text = F.col(text_col).cast("string")
    sha = lambda v: F.sha2(F.coalesce(v, F.lit("")).cast("binary"), 256)
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    # The one pass that looks for matches; what it keeps is the few documents with candidates, without their text.
    hits = docs.where(_has_candidates(text)).select(sha(text).alias("text_sha"), name(repository).alias("repository"), name(owner).alias("owner"), _candidates(text).alias("found"))
    hits = stash(hits)
    texts = stash(hits.groupBy("text_sha").agg(F.first("found").alias("found"), F.count("*").alias("copies")))
    places = hits.select("text_sha", "repository", "owner").distinct()
    rows = stash(_located(texts).withColumn("digest", sha(F.col("value"))))
    held = rows.select("text_sha", "digest", F.lower("value").rlike(PLACEHOLDER).alias("placeholder")).join(places, "text_sha")
    known = ownership(held, wide, many).select("digest", "live")
    uses = rows.groupBy("digest").agg(F.count("*").alias("uses"))
    rows = join_by_key(rows, known.join(uses, "digest"), "digest", "uses")
    start = F.when(F.col("kind") == 0, F.col("end") - F.length("value")).otherwise(F.col("start"))
    own = F.struct("start", "end", "kind")
    extra = F.struct(start.alias("start"), F.col("end"), F.when(F.col("live"), 3).otherwise(4).alias("kind"))
    order = lambda spans: F.array_sort(spans, lambda a, b: F.when(_place(a) < _place(b), -1).when(_place(a) > _place(b), 1).otherwise(0))
    found = rows.groupBy("text_sha").agg(F.collect_set(own).alias("own"), F.collect_set(extra).alias("extra"))
    found = found.join(texts.select("text_sha", "copies"), "text_sha")
    found = found.select(F.col("text_sha").alias(key), order(F.col("own").cast(_SPANS)).alias(base), order(F.concat("own", "extra").cast(_SPANS)).alias(spans), F.col("copies").alias(copies))
    # Documents without candidates, null and empty ones among them, meet no join.
    none = F.expr(f"cast(array() as {_SPANS})")
    with_, without = docs.where(_has_candidates(text)).withColumn(key, sha(text)), docs.where(~_has_candidates(text))
    # A match may be too short to be a span, so a text with candidates need not have spans.
    empty = texts.join(found.select(F.col(key).alias("text_sha")), "text_sha", "left_anti").select(F.col("text_sha").alias(key), none.alias(base), none.alias(spans), F.col("copies").alias(copies))
    with_ = join_by_key(with_, stash(found.unionByName(empty)), key, copies).select(*docs.columns, base, spans)
    return with_.unionByName(without.select(*docs.columns, none.alias(base), none.alias(spans))), base, spans


def _place(s: Column) -> Column:
    return F.struct(s["start"], s["kind"], s["end"])


def scan(docs: DataFrame, repository: Column, owner: Column, text_col: str = "text", wide: int = 4, many: int = 8) -> DataFrame:
    """The documents with two more columns: base and spans, arrays of structs (start, end, kind), without the values.

    spans holds every base span and, for its value, one of the kinds live and copied; see ownership. Spans that give the
    same start, end and kind are one. Null text has no spans; a null repository or owner counts as one unnamed
    repository or owner. Repeated rows are scanned each; extra columns pass; an empty table stays empty. Columns of the
    table that are named base or spans stay as they are; the new ones then begin with underscores and are the last two.
    """
    return _scanned(docs, repository, owner, text_col, wide, many)[0]


def secret_spans(docs: DataFrame, repository: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text", wide: int = 4, many: int = 8) -> DataFrame:
    """One row per document: id, counts of the base kinds, digest of the base spans and all spans as text; see scan."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text_in"), repository.alias("repository_in"), owner.alias("owner_in"))
    found, base, spans = _scanned(rows, F.col("repository_in"), F.col("owner_in"), "text_in", wide, many)
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_shown(F.col(base)).cast("binary"), 256).alias("base_sha256"), _shown(F.col(spans)).alias("spans"),
    )


def redact_live(docs: DataFrame, repository: Column, owner: Column, text_col: str = "text", length_col: str | None = "n_chars", wide: int = 4, many: int = 8) -> DataFrame:
    """The documents with every live credential's value replaced by [SECRET]; copied examples and all other text stay,
    as do all columns and rows; see scan for odd input. length_col, where the table has it, takes the new length of a
    changed text. Live spans that overlap are cut as one."""
    found, _, spans = _scanned(docs, repository, owner, text_col, wide, many)
    live = F.filter(spans, lambda s: s["kind"] == 3)
    # From the first span to the last: what stands between the cut ones, as an array of parts.
    text = F.col(text_col)
    # A span that begins inside or at the end of an earlier one is joined to it.
    heads = F.array_distinct(F.transform(F.filter(live, lambda s: ~F.exists(live, lambda o: (o["start"] < s["start"]) & (o["end"] >= s["start"]))), lambda s: s["start"]))
    tails = F.array_distinct(F.transform(F.filter(live, lambda s: ~F.exists(live, lambda o: (o["start"] <= s["end"]) & (o["end"] > s["end"]))), lambda s: s["end"]))
    cuts = F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), tails).alias("from"), F.concat(heads, F.array(F.length(text).cast("long"))).alias("to"))
    parts = F.transform(cuts, lambda c: F.substring(text, (c["from"] + 1).cast("int"), (c["to"] - c["from"]).cast("int")))
    changed = F.size(live) > 0
    out = found.withColumn(text_col, F.when(changed, F.array_join(parts, "[SECRET]")).otherwise(text))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(changed, F.length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
