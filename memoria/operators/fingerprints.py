"""Fingerprints of what a read showed, recovered from its output, and bounded snapshots of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The fewest non-blank lines that name a place, the longest line of a read tool, the largest file hashed.
MIN_RANGE_LINES, LONG_LINE, FILE_BYTES = 3, 2000, 1 << 20
_BLANK = r"^[\t\x0b\f\r ]*\z"
_NUMBERED = r"^( *)(\d+)\t"
FINGERPRINT = "struct<observed_hash: string, first: long, last: long, cited_hash: string, cited_bytes: long, cited_lines: long>"


def _sha(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _made(**values: Column) -> Column:
    names = [f.split(":")[0].strip() for f in FINGERPRINT[7:-1].split(",")]
    return F.struct(*(values.get(n, F.lit(None)).cast("string" if n.endswith("hash") else "long").alias(n) for n in names))


def _whole(text: Column) -> Column:
    return _made(observed_hash=_sha(text))


def cited(lines: Column) -> Column:
    """The text that names lines: joined by newlines, without carriage returns at their ends."""
    return F.array_join(F.transform(lines, lambda t: F.regexp_replace(t, r"\r\z", "")), "\n")


def _range(first: Column, lines: Column, within: tuple[Column, Column] | None = None) -> Column:
    """Lines from `first` on; with `within`, lines of that range that lost blank edges. Null where too few are not blank."""
    text = cited(lines)
    n = F.size(lines).cast("long")
    enough = F.size(F.filter(lines, lambda t: ~t.rlike(_BLANK))) >= MIN_RANGE_LINES
    low, high = within or (first, first + n - 1)
    return F.when(enough, _made(first=low, last=high, cited_hash=_sha(text), cited_bytes=F.octet_length(text), cited_lines=n if within else F.lit(None)))


def unnumbered(lines: Column, first: Column) -> Column:
    """The lines without `N` and tab before each; null unless every number is the one that is due, aligned to six columns
    or not at all."""

    def fine(t: Column, i: Column) -> Column:
        digits, pad = F.regexp_extract(t, _NUMBERED, 2), F.length(F.regexp_extract(t, _NUMBERED, 1))
        due = F.coalesce(digits.try_cast("decimal(38,0)") == (first + i).cast("decimal(38,0)"), F.lit(False))
        return t.rlike(_NUMBERED) & due & ((pad == 0) | (pad == F.greatest(F.lit(0), 6 - F.length(digits))))

    return F.when(F.forall(F.transform(lines, fine), lambda ok: ok), F.transform(lines, lambda t: F.regexp_replace(t, _NUMBERED, "")))


def _without_last(lines: Column, when: Column) -> Column:
    return F.when(when, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def fingerprint(read: Column, text: Column, intact: Column, window: Column, trimmed: Column) -> Column:
    """The fingerprint of the lines that a read showed, null where they cannot be rebuilt exactly.

    read: path, format (read_tool, plain, numbered), first, last; text: the output; intact: whether it came whole; window:
    start, lines, total of a read tool; trimmed: whether the host trims a shell's output. A whole file is its SHA-256; a
    range the hash and bytes of its lines, from three non-blank ones on. All null inputs give null."""
    shown = F.split(text, "\n")
    start, n, total = window["start"], window["lines"], window["total"]
    # A read tool: numbered lines of a window.
    tool = unnumbered(shown, start)
    sound = (n >= 1) & (start >= 1) & (F.size(tool) == n) & F.forall(tool, lambda t: F.length(t) <= LONG_LINE)
    at_end = (start + n - 1 == total) & (F.element_at(tool, -1) == "")
    by_tool = F.when(sound, F.when((start == 1) & (n == total), _whole(F.array_join(tool, "\n"))).otherwise(_range(start, _without_last(tool, at_end))))
    # A shell's output, byte for byte: every line ends with a newline but a file's last.
    first = F.coalesce(read["first"], F.lit(1).cast("long"))
    span = read["last"] - read["first"] + 1
    printed = _without_last(shown, F.endswith(text, F.lit("\n")))
    lines = F.when(read["format"] == "numbered", unnumbered(printed, first)).otherwise(printed)
    fits = read["first"].isNull() | (F.size(lines) <= span)
    exact = F.when(lines.isNotNull() & fits, F.when((read["format"] == "plain") & read["first"].isNull(), _whole(text)).otherwise(_range(first, lines)))
    # A trimmed one: blank lines before it and white space after it are gone.
    numbered = unnumbered(_without_last(shown, F.element_at(shown, -1).rlike(r"^ *\d+\z")), first)
    cut = F.when(
        read["format"] == "numbered", F.when(numbered.isNotNull() & (read["first"].isNull() | (F.size(numbered) <= span)), _range(first, numbered))
    ).otherwise(F.when(read["first"].isNotNull() & (F.size(shown) <= span), F.when(F.size(shown) == span, _range(first, shown)).otherwise(_range(first, shown, (read["first"], read["last"])))))
    found = F.when(read["format"] == "read_tool", F.when(window.isNotNull(), by_tool)).when(text == "", F.lit(None)).when(F.coalesce(trimmed, F.lit(False)), cut).otherwise(exact)
    return F.when(F.coalesce(intact, F.lit(False)) & read.isNotNull(), found)


def snapshots(files: DataFrame, most: int = FILE_BYTES) -> DataFrame:
    """(path, length, kind, observed_hash): the files of Spark's binaryFile source, or rows like its (path, length,
    content). Files over `most` bytes are too_large and their content is not looked at; read with snapshot_files, it is not
    read either. Null content is unreadable."""
    small = F.col("length") <= most
    kind = F.when(~small, "too_large").when(F.col("content").isNull(), "unreadable").otherwise("hashed")
    return files.select("path", "length", kind.alias("kind"), F.when(small, F.concat(F.lit("sha256:"), F.sha2("content", 256))).alias("observed_hash"))


def snapshot_files(spark, path: str, most: int = FILE_BYTES) -> DataFrame:
    """Snapshots of the files below a folder. The source skips the content of files that the filter on length leaves out,
    and gives no rows for empty ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = files.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return snapshots(files.where(F.col("length") <= most).select("path", "length", "content").union(large), most)


def observed(refs: DataFrame, files: DataFrame, state: DataFrame, sensitive: Column, now: Column) -> DataFrame:
    """References (seq, path, lines: first, last; commit, observed_hash, observed_at, cited_hash, cited_bytes, dirty) with
    what could be seen of their files when they were written.

    files: path, kind, observed_hash, content (null where it was not hashed); state: one row with head and dirty (an array
    of paths), or none outside a worktree. A reference that already names a commit or a hash stays; so do sensitive,
    missing and unreadable files. Lines are cited only where their text is in the file once and not blank."""
    rows = refs.join(files.select(F.col("path").alias("p_"), F.col("kind").alias("k_"), F.col("observed_hash").alias("h_"), F.col("content").alias("c_")), F.col("path") == F.col("p_"), "left")
    one = state.select(F.col("head").alias("head_"), F.col("dirty").alias("dirty_")).limit(1)
    rows = rows.join(F.broadcast(one), F.lit(True), "left")
    pinned = F.col("commit").isNotNull() | F.col("observed_hash").isNotNull()
    hashed = F.col("k_") == "hashed"
    open_ = ~pinned & F.coalesce(F.col("k_").isin("hashed", "too_large"), F.lit(False)) & ~sensitive & (hashed | F.col("head_").isNotNull())
    text = F.regexp_replace(F.decode("c_", "UTF-8"), "\r\n", "\n")
    every = F.split(F.regexp_replace(text, "\n\\z", ""), "\n")
    low, high = F.col("lines.first"), F.col("lines.last")
    window = F.when((low >= 1) & (high >= low) & (high <= F.size(every)), F.slice(every, low.cast("int"), (high - low + 1).cast("int")))
    said = cited(window)
    # Once: the text, as whole lines, is nowhere else in the file.
    framed = lambda c: F.concat(F.lit("\n"), c, F.lit("\n"))
    whole, part = framed(F.array_join(every, "\n")), framed(said)
    at = F.position(part, whole)
    once = (at > 0) & (F.position(part, whole, at + 1) == 0)
    named = open_ & hashed & F.coalesce(once & F.exists(window, lambda t: ~t.rlike(_BLANK)), F.lit(False))
    return rows.withColumns({
        "observed_hash": F.when(open_ & hashed, F.col("h_")).otherwise(F.col("observed_hash")), "observed_at": F.when(open_, F.coalesce("observed_at", now)).otherwise(F.col("observed_at")),
        "cited_hash": F.when(named, _sha(said)).otherwise(F.col("cited_hash")), "cited_bytes": F.when(named, F.octet_length(said).cast("long")).otherwise(F.col("cited_bytes")),
        "commit": F.when(open_ & F.col("head_").isNotNull(), F.col("head_")).otherwise(F.col("commit")), "dirty": F.when(open_ & F.col("head_").isNotNull(), F.array_contains("dirty_", F.col("path"))).otherwise(F.col("dirty")),
    }).select(*refs.columns)
