"""Whether what a record cites still stands, against a snapshot of the files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Verdicts from worst to best.
VERDICTS = ("stale", "unknown", "current")


def verdicts(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Adds verdict and reason to refs (record, path, observed_hash, local, outside) by files (path, hash, size)."""
    rows = refs.join(files.select("path", F.col("hash").alias("now")), "path", "left")
    cases = (
        (~F.col("local"), "unknown", "not_checkable"), (F.col("outside"), "unknown", "outside_worktree"),
        (F.col("now").isNull() & F.col("observed_hash").isNotNull(), "stale", "missing"), (F.col("observed_hash").isNull(), "unknown", "not_observed"),
        (F.col("observed_hash") == F.col("now"), "current", "unchanged"),
    )
    pick = lambda i, last: F.coalesce(*(F.when(c[0], c[i]) for c in cases), F.lit(last))
    return rows.withColumn("verdict", pick(1, "stale")).withColumn("reason", pick(2, "changed")).drop("now")


def worst(checked: DataFrame) -> DataFrame:
    """Each record's worst verdict."""
    place = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    return checked.groupBy("record").agg(F.min(place).alias("v")).select("record", F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("v").cast("int")).alias("freshness"))


def line_windows(rows: DataFrame) -> DataFrame:
    """Adds found to rows (content, cited_hash, cited_lines, and cited_bytes where that is known): the first lines, from 1,
    at which so many lines of content have the cited digest; in place, moved, gone and ambiguous follow from it. Where
    the size is known, only stretches of as many bytes are hashed."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            sizes = pdf["cited_bytes"] if "cited_bytes" in pdf else [None] * len(pdf)
            for content, digest, n, size in zip(pdf["content"], pdf["cited_hash"], pdf["cited_lines"], sizes, strict=True):
                raw = (content or "").encode()
                starts = [0, *(m.end() for m in re.finditer(b"\n", raw)), len(raw) + 1]
                ends = [starts[i + int(n)] - 1 for i in range(max(len(starts) - int(n), 0))]
                out.append([i + 1 for i, end in enumerate(ends) if (size is None or end - starts[i] == size) and hashlib.sha256(raw[starts[i] : end]).hexdigest() == digest])
            yield pdf.assign(found=out)

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    return rows.mapInPandas(run, StructType([*rows.schema.fields]).add("found", ArrayType(IntegerType())))


def moved(found: Column, start: Column) -> Column:
    return F.when(F.size(found) == 0, "lines_changed").when(F.size(found) > 1, "ambiguous").when(found[0] == start, "changed_elsewhere").otherwise("lines_moved")


def checked(refs: DataFrame, files: DataFrame, state: DataFrame, commits: DataFrame, per_check: int = 64, file_bytes: int = 1 << 20, total_bytes: int = 8 << 20) -> DataFrame:
    """Adds verdict, reason and found_first (where moved lines are now) to references, by what their files hold now.

    refs: check, place (rank within the check), record, local, remote (an issue, a page: historical until verified), path
    (null outside the worktree), sensitive, imported, commit, dirty (null where nothing was captured), observed_hash, first,
    last, cited_hash, cited_bytes, cited_lines; hashes as `sha256:` and hex. files: path, kind (hashed, too_large,
    unreadable), size, hash, content; a path without a row is missing. state: one row with head and dirty (array of paths),
    or none. commits: commit. A check looks at its first per_check local references and reads total_bytes of files at most,
    each file once, files over file_bytes not at all; what it has no room for is `check_limit`, and later files that fit are
    still read. (check, place) must be unique.
    """
    order = Window.partitionBy("check", "local").orderBy("place")
    now = files.select(F.col("path").alias("p_"), F.col("kind").alias("k_"), F.col("size").alias("s_"), F.col("hash").alias("h_"))
    rows = refs.withColumn("n_", F.row_number().over(order)).join(now, F.col("path") == F.col("p_"), "left")
    rows = rows.join(F.broadcast(state.select(F.col("head").alias("head_"), F.col("dirty").alias("dirty_")).limit(1)), F.lit(True), "left")
    rows = rows.join(commits.select(F.col("commit").alias("c_")).distinct(), F.col("commit") == F.col("c_"), "left")
    valid = lambda c: F.coalesce(F.col(c).rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))
    captured, hashed = F.col("dirty").isNotNull(), valid("observed_hash")
    cited_only = F.col("imported") & ~hashed & F.col("cited_hash").isNotNull()
    seen = captured | hashed | cited_only
    missing = F.col("k_").isNull()
    clean = F.coalesce(captured & ~F.col("dirty") & (F.col("head_") == F.col("commit")) & ~F.array_contains("dirty_", F.col("path")), F.lit(False))
    asks = F.col("local") & (F.col("n_") <= per_check) & F.col("path").isNotNull() & ~F.col("sensitive") & ~missing & ~clean & (hashed | cited_only) & (F.col("k_") == "hashed") & (F.col("s_") <= file_bytes)
    rows = rows.withColumn("asks_", F.coalesce(asks, F.lit(False)))

    # A check has few references, so what it may still read is folded over them in order.
    start = F.struct(F.lit(total_bytes).cast("long").alias("left"), F.array().cast("array<string>").alias("read"), F.array().cast("array<long>").alias("denied"))

    def step(acc: Column, x: Column) -> Column:
        known, fits = F.array_contains(acc["read"], x["path"]), x["s_"] <= acc["left"]
        return F.struct(
            F.when(~known & fits, acc["left"] - x["s_"]).otherwise(acc["left"]).alias("left"), F.when(~known & fits, F.array_append(acc["read"], x["path"])).otherwise(acc["read"]).alias("read"),
            F.when(~known & ~fits, F.array_append(acc["denied"], x["place"])).otherwise(acc["denied"]).alias("denied"),
        )

    asked = rows.where("asks_").groupBy("check").agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "path", F.col("s_").cast("long").alias("s_")))).alias("todo"))
    denied = asked.select(F.col("check").alias("check_"), F.explode(F.aggregate("todo", start, step)["denied"]).alias("place_"))
    rows = rows.join(denied, (F.col("check") == F.col("check_")) & (F.col("place") == F.col("place_")), "left").withColumn("denied_", F.col("place_").isNotNull()).drop("check_", "place_")

    # Lines are looked for once for each file and fingerprint, where the file's bytes differ.
    n = F.coalesce("cited_lines", F.col("last") - F.col("first") + 1)
    cites = valid("cited_hash") & F.col("cited_bytes").isNotNull() & (F.col("last") >= F.col("first")) & (n >= 1) & (n <= F.col("last") - F.col("first") + 1)
    rows = rows.withColumn("cites_", F.coalesce(cites, F.lit(False))).withColumn("lines_", n.cast("long"))
    look = rows.where(F.col("asks_") & ~F.col("denied_") & F.col("cites_") & ~F.coalesce(F.col("h_") == F.col("observed_hash"), F.lit(False)))
    look = look.select("path", "cited_hash", "cited_bytes", "lines_").distinct().join(files.select("path", F.regexp_replace(F.decode("content", "UTF-8"), "\r\n", "\n").alias("content")), "path")
    found = line_windows(look.select("path", F.expr("substring(cited_hash, 8)").alias("cited_hash"), "cited_bytes", F.col("lines_").alias("cited_lines"), "content"))
    found = found.select(F.col("path").alias("fp_"), F.concat(F.lit("sha256:"), "cited_hash").alias("fh_"), F.col("cited_lines").alias("fl_"), F.col("found").alias("found_"), F.split("content", "\n").alias("text_"))
    rows = rows.join(found, (F.col("path") == F.col("fp_")) & (F.col("cited_hash") == F.col("fh_")) & (F.col("lines_") == F.col("fl_")), "left")
    at = F.element_at("found_", F.when(F.size("found_") == 1, 1)).cast("long")
    before = F.slice("text_", F.col("first").cast("int"), F.greatest(at - F.col("first"), F.lit(0)).cast("int"))
    in_place = (at >= F.col("first")) & (at + F.col("lines_") - 1 <= F.col("last")) & F.forall(before, lambda t: t.rlike(r"^[\t\x0b\f\r ]*\z"))
    look_for = F.col("cites_") & F.col("found_").isNotNull()
    unseen = F.when(F.col("imported"), "transcript_reference").when(F.col("commit").isNotNull() & F.col("c_").isNull(), "unknown_commit").otherwise("not_observed")
    cases = (
        (~F.col("local"), "unknown", F.when(F.col("remote"), "remote_unverified").otherwise("not_checkable")), (F.col("n_") > per_check, "unknown", "check_limit"), (F.col("path").isNull(), "unknown", "outside_worktree"),
        (F.col("sensitive"), "unknown", "not_observed"), (missing & seen, "stale", "missing"), (missing | ~seen, "unknown", unseen), (clean, "current", "unchanged"),
        (~hashed & ~cited_only, "unknown", F.when((F.col("k_") == "too_large") & (F.col("s_") > file_bytes), "too_large").otherwise("not_observed")), (F.col("k_") == "unreadable", "unknown", "unreadable"),
        ((F.col("k_") == "too_large") | (F.col("s_") > file_bytes), "unknown", "too_large"), (F.col("denied_"), "unknown", "check_limit"), (hashed & (F.col("h_") == F.col("observed_hash")), "current", "unchanged"),
        (look_for & (F.size("found_") == 0), "stale", "lines_changed"), (look_for & (F.size("found_") == 1) & in_place, "current", "changed_elsewhere"), (look_for & (F.size("found_") == 1), "current", "lines_moved"),
        (hashed, "stale", "changed"),
    )
    text = lambda v: F.lit(v) if isinstance(v, str) else v
    pick = lambda i, last: F.coalesce(*(F.when(F.coalesce(c[0], F.lit(False)), text(c[i])) for c in cases), F.lit(last))
    rows = rows.withColumn("verdict", pick(1, "unknown")).withColumn("reason", pick(2, "transcript_reference"))
    return rows.select(*refs.columns, "verdict", "reason", F.when(F.col("reason") == "lines_moved", at).alias("found_first"))


def test_run(commit: Column, worktree: Column, commit_now: Column, worktree_now: Column) -> tuple[Column, Column]:
    """(verdict, reason) of a test run, by the state that it saw and the state now."""
    unknown = commit.isNull() | worktree.isNull() | commit_now.isNull() | worktree_now.isNull()
    same = (commit == commit_now) & (worktree == worktree_now)
    return F.when(unknown, "unknown").when(same, "current").otherwise("stale"), F.when(unknown, "not_fingerprinted").when(same, "same_state").otherwise("other_state")
