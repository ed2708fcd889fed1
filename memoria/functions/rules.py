"""Small rules over calls, prompts, checkpoints and outputs as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .text import strict_json

# The wordings of a lasting preference, the calls that change nothing, the parts of a checkpoint and the
# forms of ids in the memory's own output.
_CLAUSE = r"(?:^|[.!?;:]\s+|\n\s*)"
LASTING = (
    r"(?i)\bfrom now on\b", r"(?i)\bgoing forward\b", rf"(?i){_CLAUSE}in (?:the )?future\b", r"(?i)\bI(?: would|'d)? prefer\b", rf"(?i){_CLAUSE}(?:please\s+)?remember to\b",
    rf"(?i)(?:{_CLAUSE}|\b(?:please|you should|you must|we should|we must)\s+)(?:always|never)(?!\s+mind\b)\s+\w",
)
READ_ONLY = ("memory_recall", "memory_read", "memory_status")
SECTIONS = (("decisions", "Decisions"), ("failedAttempts", "Failed attempts"), ("openQuestions", "Open questions"), ("nextSteps", "Next steps"), ("preferences", "Preferences"))
_WORKSTREAM = "wst_[0-9a-f]{32}"
_SESSION = r'"headRevision":\d+,"sessionId":"(ses_[0-9a-f]{32})"'


def states_lasting_preference(prompt: Column) -> Column:
    """Whether a prompt's wording states a standing rule; code blocks are not the user's wording."""
    wording = F.regexp_replace(prompt, r"(?s)```.*?(?:```|\z)", " ")
    out = F.lit(False)
    for pattern in LASTING:
        out = out | wording.rlike(pattern)
    return F.coalesce(out, F.lit(False))


def read_only(operation: Column, arguments: Column) -> Column:
    """Whether a call (its arguments as JSON) changes nothing: reads, an inspection, a bootstrap without an answer about
    imports. Arguments that are no JSON count as none."""
    args = strict_json(arguments)
    asked = F.try_variant_get(args, "$.importChoice", "variant")
    return F.when(operation == "memory_bootstrap", asked.isNull()).when(operation.isin(*READ_ONLY), True).when(operation == "memory_manage", F.coalesce(F.try_variant_get(args, "$.action", "string") == "inspect", F.lit(False))).otherwise(False)


def _start(heading: str) -> str:
    return f"\n\n{heading}:\n- "


def render_checkpoint(goal: Column, status: Column, **sections: Column) -> Column:
    """A checkpoint's text: goal, status and one bullet for each entry, sections in their order, empty ones left out."""
    parts = [F.concat(F.lit("Goal: "), goal, F.lit("\n\nStatus: "), status)]
    for field, heading in SECTIONS:
        entries = sections.get(field)
        if entries is not None:
            parts.append(F.when(F.size(entries) > 0, F.concat(F.lit(_start(heading)), F.array_join(entries, "\n- "))).otherwise(""))
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once and written into the plan once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def summarise_checkpoint(body: Column) -> tuple[Column, Column, Column]:
    """(goal, status, next step) of a checkpoint's text, each clipped; null where it is no such text.

    The marks of the parts are looked for in their order, each after the one before, so words in a part that only look like
    a heading stay words. The search is a fold over the headings; its expression does not grow with their number."""
    clip = lambda t, n: F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))
    mark = "\n\nStatus: "
    headings = F.array(*(F.struct(F.lit(_start(h)).alias("start"), F.lit(field == "nextSteps").alias("is_next")) for field, h in SECTIONS))

    def step(rest: Column, acc: Column, heading: Column) -> Column:
        after = lambda found: found + F.length(heading["start"])
        return _let(
            F.position(heading["start"], rest, acc["since"]),
            lambda found: F.struct(
                F.when(found > 0, after(found)).otherwise(acc["since"]).alias("since"), F.when(found > 0, F.least(acc["end"], found)).otherwise(acc["end"]).alias("end"),
                F.when(heading["is_next"], F.when(found > 0, after(found)).otherwise(0)).otherwise(acc["next_at"]).alias("next_at"),
            ),
        )

    def entry(rest: Column, next_at: Column) -> Column:
        def first(entries: Column) -> Column:
            stops = [F.position(F.lit(s), entries) for s in ("\n- ", _start("Preferences"))]
            return F.substring(entries, F.lit(1), F.least(*(F.when(s > 0, s).otherwise(F.length(entries) + 1) for s in stops)) - 1)

        return F.when(next_at > 0, _let(_let(F.substring(rest, next_at, F.length(rest)), first), lambda t: clip(t, 200)))

    def parted(x: Column) -> Column:
        start = F.struct(F.lit(1).alias("since"), (F.length(x["rest"]) + 1).alias("end"), F.lit(0).alias("next_at"))
        return _let(
            F.aggregate(headings, start, lambda acc, heading: step(x["rest"], acc, heading)),
            lambda at: F.struct(
                _let(x["goal"], lambda t: clip(t, 200)).alias("goal"), _let(F.substring(x["rest"], F.lit(1), at["end"] - 1), lambda t: clip(t, 300)).alias("status"), entry(x["rest"], at["next_at"]).alias("next"),
            ),
        )

    def whole(t: Column) -> Column:
        at = F.position(F.lit(mark), t)
        sides = F.struct(F.substring(t, F.lit(7), at - 7).alias("goal"), F.substring(t, at + len(mark), F.length(t)).alias("rest"))
        return F.when(F.startswith(t, F.lit("Goal: ")) & (at > 0), _let(sides, parted))

    found = _let(body, whole)
    return found["goal"], found["status"], found["next"]


def bound_workstreams(output: Column) -> Column:
    """The workstreams that a piece of the memory's output says it is bound to: its scope's, or, where the output is no
    whole JSON, every one that it names."""
    value = strict_json(output)
    scope = F.try_variant_get(value, "$.scope.workstreamId", "string")
    named = F.array_distinct(F.regexp_extract_all(output, F.lit(f'"workstreamId":"({_WORKSTREAM})"'), 1))
    return F.when(value.isNotNull(), F.filter(F.array(scope), lambda w: w.rlike(f"^{_WORKSTREAM}$"))).otherwise(named)


def named_sessions(output: Column) -> Column:
    """The sessions that results were returned to, by the one field that only a result's scope has."""
    return F.array_distinct(F.regexp_extract_all(output, F.lit(_SESSION), 1))


def record_fields(records: DataFrame) -> DataFrame:
    """Adds the parsed fields that every view of a record shows (from applicability and external_refs, JSON): references,
    test_run, applies (applicability without the run, as JSON) and workspace_level. Texts that are no JSON give nulls."""
    run = "struct<command: string, outcome: string, evidence: string, commit: string, worktree: string>"
    rest = F.map_filter(F.from_json("applicability", "map<string,string>"), lambda k, _: k != "testRun")
    return records.withColumns({
        "references": F.from_json("external_refs", "array<struct<kind: string, locator: string, path: string, commit: string>>"), "test_run": F.from_json("applicability", f"struct<testRun: {run}>")["testRun"],
        "applies": F.to_json(rest), "workspace_level": F.col("workstream_id").isNull(),
    })


def of_transcripts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose (host, transcript) is one of the wanted."""
    return rows.join(wanted.select("host", "transcript").distinct(), ["host", "transcript"], "left_semi")


def bound_to(bindings: DataFrame, workstreams: DataFrame) -> DataFrame:
    """(worktree, workstream): the workstream that each worktree is bound to, of those that are here."""
    return bindings.join(workstreams.select("workstream"), "workstream", "left_semi").select("worktree", "workstream")


def orphans_on_branch(workstreams: DataFrame, bindings: DataFrame, live: DataFrame, task: Column | None = None) -> DataFrame:
    """(branch, workstream): active workstreams last seen on a branch, all of whose worktrees are gone; with a task, those
    without one. A detached head is no branch. live: the worktrees that exist."""
    held = bindings.join(live.select("worktree").distinct(), "worktree", "left_semi").select("workstream")
    rows = workstreams.where("lifecycle = 'active'").join(held, "workstream", "left_anti").withColumn("branch", F.coalesce("branch", "label"))
    rows = rows.where((F.col("branch") != "detached") & ~F.startswith("branch", F.lit("detached@")))
    if task is not None:
        rows = rows.where(task.isNull() | F.col("task_key").isNull())
    return rows.select("branch", "workstream")
