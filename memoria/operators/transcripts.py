"""Transcripts of two hosts to one model of events, on VARIANT values of their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import shell
from ..functions.text import strict_json
from .upkeep import version_key

# What the two hosts write, and the versions whose entries are known.
A_VERSIONS = (("2.1.183", "2.2.0"),)
A_METADATA = (
    "mode", "permission-mode", "bridge-session", "file-history-snapshot", "file-history-delta", "ai-title", "custom-title", "last-prompt", "atis-latch", "queue-operation",
    "cost-state", "frame-link", "pr-link", "agent-name", "artifact-comment-monitor", "artifact-autoreact-ledger", "fork-context-ref", "summary",
)
A_FILE_TOOLS = ("Read", "Write", "Edit", "MultiEdit", "NotebookEdit", "NotebookRead")
A_INJECTED = r"(?s)<system-reminder>.*?</system-reminder>"
A_NOTE = r"^\((?:Bash completed with no output|No output)\)\z|(?:^|\n)Shell cwd was reset to "
A_HEAD_BYTES = 64 * 1024
OWN_TOOLS = ("memory_bootstrap", "memory_recall", "memory_read", "memory_record", "memory_checkpoint", "memory_manage", "memory_status")
B_VERSIONS = (("0.125.0-alpha.3", "0.143.0"), ("0.148.0-alpha.21", "0.148.0-alpha.22"))
B_METADATA_EVENTS = (
    "token_count", "task_started", "task_complete", "turn_aborted", "thread_rolled_back", "context_compacted", "error", "warning", "exec_command_end", "patch_apply_end", "mcp_tool_call_end",
    "web_search_end", "image_generation_end", "thread_name_updated", "thread_settings_applied", "item_completed", "entered_review_mode", "exited_review_mode", "sub_agent_activity",
)
B_METADATA_ITEMS = ("tool_search_call", "tool_search_output", "compaction", "context_compaction", "other", "agent_message")
B_METADATA_TYPES = ("world_state", "security_risk_score", "inter_agent_communication", "inter_agent_communication_metadata")
B_CONTEXTUAL = (
    "# agents.md instructions", "<environment_context>", "<external_", "<skill>", "<user_shell_command>", "<turn_aborted>", "<subagent_notification>", "<codex_internal_context",
    "<goal_context>", "<recommended_plugins>", "<hook_prompt", "<user_instructions>", "warning: ",
)
B_SHELLS = ("exec_command", "shell_command", "shell")
B_SUMMARY_PREFIX = "Another language model started to solve this problem"
B_HEADER = (
    r"^(?:Chunk ID: [^\n]*\n)?(?:Exit code: (-?\d+)\n)?Wall time: [^\n]*\n(?:Process exited with code (-?\d+)\n|(Process running with session ID [^\n]*\n))?(?:Original token count: [^\n]*\n)?Output:\n"
)
B_TRUNCATED = r"…\d+ tokens truncated…"
_SPACE = r"[\s\x0b   -     　﻿]"

EVENT = (
    "block: int, type: string, role: string, text: string, call_id: string, tool: string, summary: string, paths: array<string>, urls: array<string>, tool_kind: string, input_digest: string, command: string, "
    f"argv: array<string>, run_in: string, read: {shell.READ}, is_error: boolean, intact: boolean, window: struct<start: long, lines: long, total: long>"
)


def _part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _string(v: Column, path: str) -> Column:
    """A JSON string, null for any other value."""
    return F.when(F.schema_of_variant(_part(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def _whole(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(_part(v, path)) == "BIGINT", F.try_variant_get(v, path, "long"))


def _true(v: Column, path: str) -> Column:
    return F.coalesce((F.schema_of_variant(_part(v, path)) == "BOOLEAN") & F.try_variant_get(v, path, "boolean"), F.lit(False))


def _list(v: Column, path: str) -> Column:
    """A JSON array, null for any other value."""
    return F.when(F.startswith(F.schema_of_variant(_part(v, path)), F.lit("ARRAY")), F.try_variant_get(v, path, "array<variant>"))


def _object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+\z", "")


def _quoted(text: Column) -> Column:
    """A text as JSON writes it."""
    made = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("s")))
    return F.substring(made, F.lit(6), F.length(made) - 6)


def resolved(base: Column, path: Column) -> Column:
    """An absolute path, without . and .. parts."""
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat_ws("/", base, path))
    step = lambda kept, p: F.when(p == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(p.isin("", "."), kept).otherwise(F.concat(kept, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/"))


def supported(version: Column, rows: tuple[tuple[str, str], ...]) -> Column:
    """Whether a version lies in one of the ranges; a pre-release number counts, so alpha.3 comes before alpha.21."""
    key = F.concat(version_key(version), F.array(F.coalesce(F.regexp_extract(version, r"-[A-Za-z]+\.(\d+)$", 1).try_cast("int"), F.lit(0))))
    known = version.rlike(r"^\d+\.\d+\.\d+(-[0-9A-Za-z.-]+)?$")
    both = lambda v: F.concat(version_key(F.lit(v)), F.array(F.lit(int(v.rsplit(".", 1)[1]) if "-" in v else 0)))
    inside = [(key >= both(low)) & (key < both(below)) for low, below in rows]
    out = inside[0]
    for other in inside[1:]:
        out = out | other
    return F.coalesce(known & out, F.lit(False))


def _event(**values: Column) -> Column:
    """An event struct; what is not given is null."""
    fields = [f.strip().split(": ", 1) for f in _fields(EVENT)]
    return F.struct(*(F.lit(None).cast(t).alias(n) if n not in values else values[n].cast(t).alias(n) for n, t in fields))


def _fields(ddl: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out, now = [*out, now], ""
        else:
            now += c
    return [*out, now]


def _result_text(content: Column) -> tuple[Column, Column]:
    """The text of a tool result's content, and what of it is left out. content: the variant."""
    blocks = _list(content, "$")
    text = F.array_join(F.transform(F.filter(blocks, lambda b: (_string(b, "$.type") == "text") & _string(b, "$.text").isNotNull()), lambda b: _string(b, "$.text")), "\n")
    kind = lambda b: F.coalesce(_string(b, "$.type"), F.lit(""))
    left = lambda b: F.when((kind(b) == "text") & _string(b, "$.text").isNotNull(), F.lit(None)).when(kind(b).isin("image", "document"), "binary").when(kind(b) == "tool_reference", "host_metadata").otherwise("unsupported_entry")
    reasons = F.filter(F.transform(blocks, left), lambda r: r.isNotNull())
    return F.coalesce(_string(content, "$"), text, F.lit("")), F.coalesce(reasons, F.array().cast("array<string>"))


def _own_tool(tool: Column, suffix: str = "") -> Column:
    pattern = f"^mcp__.+__({'|'.join(OWN_TOOLS)}){suffix}$"
    return F.when(tool.rlike(pattern), F.regexp_extract(tool, pattern, 1))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _a_block(b: Column) -> Column:
    """What is read of a block of host A's messages, taken out of its VARIANT once."""
    given, (said, left) = _part(b, "$.input"), _result_text(_part(b, "$.content"))
    tool = _string(b, "$.name")
    arguments = {k: _string(given, f"$.{k}") for k in ("file_path", "notebook_path", "path", "pattern", "url", "query", "description", "command")}
    fields = {
        "kind": F.coalesce(_string(b, "$.type"), F.lit("")), "words": _string(b, "$.text"), "id": _string(b, "$.id"), "tool": tool, "own": _own_tool(tool), "result_of": _string(b, "$.tool_use_id"), "failed": _true(b, "$.is_error"),
        "said": said, "left": left, "json": F.coalesce(F.to_json(given), F.lit("{}")), "offset": _whole(given, "$.offset"), "limit": _whole(given, "$.limit"), **arguments,
    }
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _a_call(block: Column, b: Column, cwd: Column) -> Column:
    """A call of host A (a block of _a_block): one line that describes it, what it touches, what kind it is. Only known
    tools are described; of others a digest of the input stays."""
    tool, own, low, n = b["tool"], b["own"], b["offset"], b["limit"]
    path, place = F.coalesce(b["file_path"], b["notebook_path"]), b["path"]
    is_file = tool.isin(*A_FILE_TOOLS)
    lines = F.when(low.isNotNull() & n.isNotNull(), F.concat(F.lit(" (lines "), low, F.lit("-"), low + n - 1, F.lit(")"))).otherwise("")
    within = F.when(place.isNull(), "").otherwise(F.concat(F.lit(" in "), place))
    summary = (
        F.when(own.isNotNull(), F.concat(own, F.lit(" "), b["json"])).when(is_file, F.concat(tool, F.lit(" "), F.coalesce(path, F.lit("(no path)")), lines))
        .when(tool == "Bash", F.concat(F.lit("$ "), F.coalesce(b["command"], F.lit("")))).when(tool.isin("Grep", "Glob"), F.concat(tool, F.lit(" "), _quoted(b["pattern"]), within))
        .when(tool == "WebFetch", F.concat(F.lit("WebFetch "), F.coalesce(b["url"], F.lit("")))).when(tool == "WebSearch", F.concat(F.lit("WebSearch "), _quoted(b["query"])))
        .when(tool.isin("Agent", "Task"), F.concat(tool, F.lit(": "), F.coalesce(b["description"], F.lit("")))).otherwise(F.concat(tool, F.lit(" [arguments omitted]")))
    )
    plain = own.isNull()
    known = is_file | tool.isin("Bash", "Grep", "Glob", "WebFetch", "WebSearch", "Agent", "Task")
    none = F.array().cast("array<string>")
    only = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(none)
    return _event(
        block=block, type=F.lit("tool_call"), call_id=b["id"], tool=tool, summary=summary, paths=F.when(plain & is_file, only(path)).when(plain & tool.isin("Grep", "Glob"), only(place)).otherwise(none),
        urls=F.when(plain & (tool == "WebFetch"), only(b["url"])).otherwise(none), tool_kind=F.when(own.isNotNull(), "own").when(is_file, "artifact_access").otherwise("other"),
        input_digest=F.when(plain & ~known, _digest(b["json"])), command=F.when(plain & (tool == "Bash"), b["command"]), run_in=cwd,
        read=F.when(plain & (tool == "Read") & path.isNotNull(), F.struct(resolved(cwd, path).alias("path"), F.lit("read_tool").alias("format"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))),
    )


def a_files(files: DataFrame, root: str) -> DataFrame:
    """Adds transcript and parent to the files (path, ...) of host A that are transcripts: `<root>/<project>/<session>.jsonl`,
    and a sub-agent's `<root>/<project>/<session>/subagents/agent-<id>.jsonl`, whose parent is its session."""
    below = F.when(F.startswith("path", F.lit(root.rstrip("/") + "/")), F.substring("path", len(root.rstrip("/")) + 2, 1 << 20))
    session, sub = r"^[^/]+/([^/]+)\.jsonl$", r"^[^/]+/([^/]+)/subagents/agent-([A-Za-z0-9_-]{1,64})\.jsonl$"
    parent = F.when(below.rlike(sub), F.regexp_extract(below, sub, 1))
    name = F.when(below.rlike(session), F.regexp_extract(below, session, 1)).when(below.rlike(sub), F.concat(parent, F.lit("/agent-"), F.regexp_extract(below, sub, 2)))
    return files.withColumn("transcript", name).withColumn("parent", parent).where("transcript is not null")


def a_heads(lines: DataFrame) -> DataFrame:
    """(transcript, cwd, host_version, supported) from the first entry with a folder in each transcript's first 64 KB."""
    v = strict_json(F.col("text"))
    rows = lines.where(F.col("start") < A_HEAD_BYTES).select("transcript", "start", _string(v, "$.cwd").alias("cwd"), _string(v, "$.version").alias("host_version")).where("cwd is not null")
    first = rows.groupBy("transcript").agg(F.min_by(F.struct("cwd", "host_version"), "start").alias("h"))
    return first.select("transcript", "h.cwd", "h.host_version", supported(F.col("h.host_version"), A_VERSIONS).alias("supported"))


def _finish(rows: DataFrame, context: list[str]) -> DataFrame:
    """One row per event; a call's command is recognised as a read of files or not."""
    out = rows.select(*context, F.explode("events").alias("e")).select(*context, "e.*")
    # Words are told from a command line by what stands before them.
    runs = F.coalesce(F.concat(F.lit(shell.WORDS), F.to_json("argv")), F.col("command"))
    out = out.withColumn("runs_", runs).drop("command", "argv")
    asked = out.select(F.col("runs_").alias("key_"), F.col("run_in").alias("in_"), F.col("cwd").alias("below_")).where("key_ is not null").distinct()
    found = shell.shell_reads(asked, "key_", "in_", "below_").select("key_", "in_", "below_", F.col("paths").alias("paths_"), F.col("tool_kind").alias("kind_"), F.col("read").alias("read_"))
    out = out.join(found, (F.col("runs_") == F.col("key_")) & (F.col("run_in") == F.col("in_")) & (F.col("cwd") == F.col("below_")), "left")
    out = out.withColumns({"paths": F.coalesce("paths_", "paths"), "tool_kind": F.coalesce("kind_", "tool_kind"), "read": F.coalesce("read_", "read")})
    return out.drop("runs_", "run_in", "key_", "in_", "below_", "paths_", "kind_", "read_")


def _stopped(rows: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """The lines before a transcript's first bad one, and (transcript, stop, host_version) of that one."""
    at = F.min(F.when(bad, F.struct("start", F.coalesce("version", F.lit("missing")).alias("version")))).over(Window.partitionBy("transcript"))
    rows = rows.withColumn("stop", at)
    stops = rows.where(F.col("stop.start") == F.col("start")).select("transcript", F.col("stop.start").alias("offset"), F.col("stop.version").alias("host_version")).distinct()
    return rows.where(F.col("stop").isNull() | (F.col("start") < F.col("stop.start"))).drop("stop"), stops


def a_events(lines: DataFrame, agents: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, excluded, stops) of host A's lines (transcript, start, end, text; null text: too long a line).

    events: transcript, line_start, line_end, branch, agent_type, event_id, observed_at, cwd, git_branch, host_version
    and the fields of an event. excluded: (transcript, reason, n) of what is left out and why. stops: (transcript, offset,
    host_version) where a transcript's first entry of an unknown version ends the reading; entries after it are in
    neither table. agents: (transcript, agent_type) of the sub-agents' transcripts that exist; a result that hands a
    sub-agent's report back is left out where they hold it. Torn, foreign and null lines are counted as malformed or
    oversized; an empty table gives three empty ones.
    """
    v = F.col("v")
    rows = lines.select("transcript", "start", "end", "text", strict_json(F.col("text")).alias("v")).withColumn("object", _object(v))
    rows = rows.withColumn("kind", F.when(F.col("object"), _string(v, "$.type"))).withColumn("version", _string(v, "$.version"))
    versioned = F.coalesce(F.col("kind").isin("user", "assistant", "system", "attachment"), F.lit(False))
    rows, stops = _stopped(rows, versioned & ~supported(F.col("version"), A_VERSIONS))
    rows = rows.withColumns({"uuid": _string(v, "$.uuid"), "observed_at": _string(v, "$.timestamp"), "cwd": _string(v, "$.cwd"), "side": _true(v, "$.isSidechain"), "blocks": F.transform(_list(v, "$.message.content"), _a_block), "said": _string(v, "$.message.content")})
    agent = _string(v, "$.toolUseResult.agentId")
    session = F.split_part("transcript", F.lit("/agent-"), F.lit(1))
    rows = rows.withColumn("handed", F.concat(session, F.lit("/agent-"), agent))
    if agents is not None:
        known = agents.select(F.col("transcript").alias("handed"), F.lit(True).alias("there")).distinct()
        types = agents.select("transcript", F.col("agent_type").alias("known_type")).dropDuplicates(["transcript"])
        rows = rows.join(known, "handed", "left").join(types, "transcript", "left")
    else:
        rows = rows.withColumn("there", F.lit(None).cast("boolean")).withColumn("known_type", F.lit(None).cast("string"))
    reported = F.coalesce(agent.isNotNull() & ((_string(v, "$.toolUseResult.status") == "async_launched") | F.col("there")), F.lit(False))

    kind, blocks, said = F.col("kind"), F.col("blocks"), F.col("said")
    entry = (
        F.when(F.col("text").isNull(), "oversized_entry").when(~F.col("object") | kind.isNull(), "malformed").when(kind.isin(*A_METADATA), "host_metadata").when(~versioned, "unsupported_entry")
        .when(F.col("uuid").isNull() | F.col("observed_at").isNull() | F.col("cwd").isNull() | F.col("version").isNull(), "malformed").when(kind == "attachment", "host_metadata")
    )
    recap = (kind == "system") & F.coalesce((_string(v, "$.subtype") == "away_summary") & (_trimmed(_string(v, "$.content")) != ""), F.lit(False))
    # A message is anything that is an object or a list.
    message = F.coalesce(F.schema_of_variant(_part(v, "$.message")).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    compact = (kind == "user") & _true(v, "$.isCompactSummary")
    origin = _part(v, "$.origin.kind")
    injected = (kind == "user") & ~compact & (_true(v, "$.isMeta") | F.coalesce(origin.isNotNull() & ~F.coalesce(_string(v, "$.origin.kind") == "human", F.lit(False)), F.lit(False)))
    entry = (
        F.when(entry.isNotNull(), entry).when((kind == "system") & ~recap, "host_metadata").when((kind != "system") & ~message, "malformed").when(injected, "injected_context")
        .when((kind == "user") & ~compact & said.isNull() & blocks.isNull(), "malformed").when((kind == "assistant") & blocks.isNull(), "malformed")
    )
    rows = rows.withColumn("entry", entry)
    open_ = F.col("entry").isNull()

    index = lambda f: F.transform(blocks, f)
    type_of = lambda b: b["kind"]
    is_result = lambda b: (type_of(b) == "tool_result") & b["result_of"].isNotNull()
    is_text = lambda b: (type_of(b) == "text") & b["words"].isNotNull()
    # What the host recorded about an output holds for the only result of an entry.
    one = F.size(F.filter(blocks, lambda b: type_of(b) == "tool_result")) == 1
    facts = _part(v, "$.toolUseResult")
    file = [_whole(facts, f"$.file.{k}") for k in ("startLine", "numLines", "totalLines")]
    window = F.when((_string(facts, "$.type") == "text") & file[0].isNotNull() & file[1].isNotNull() & file[2].isNotNull(), F.struct(file[0].alias("start"), file[1].alias("lines"), file[2].alias("total")))
    shell_whole = F.when(
        F.coalesce(_string(facts, "$.type") != "text", F.lit(True)) & _string(facts, "$.stdout").isNotNull(),
        _part(facts, "$.persistedOutputPath").isNull() & ~_true(facts, "$.isImage") & ~_true(facts, "$.interrupted") & F.coalesce(_string(facts, "$.stderr") == "", F.lit(False)),
    )
    whole = F.when(one, F.coalesce(window.isNotNull() & F.lit(True), F.lit(False)) | F.coalesce(shell_whole, F.lit(False)))
    whole = F.when(one & (window.isNotNull() | shell_whole.isNotNull()), whole)
    summary_text, summary_left = _result_text(_part(v, "$.message.content"))
    summary = _trimmed(F.when(kind == "system", _string(v, "$.content")).when(compact, summary_text))
    rows = rows.withColumns({"whole": whole, "window": F.when(one, window), "summary": summary, "summary_left": F.when(compact, summary_left), "compact": compact, "recap": recap, "reported": reported})
    compact, recap, reported, summary = (F.col(c) for c in ("compact", "recap", "reported", "summary"))

    def result(b: Column, i: Column) -> Column:
        return _event(block=i, type=F.lit("tool_result"), call_id=b["result_of"], text=b["said"], is_error=b["failed"], intact=F.when(F.col("whole").isNotNull(), F.col("whole") & ~b["said"].rlike(A_NOTE)), window=F.col("window"))

    def typed(text: Column, block: Column) -> tuple[Column, Column]:
        """What a user typed, without what the host put in; and how often it did."""
        plain = _trimmed(F.regexp_replace(text, A_INJECTED, ""))
        role = F.when(F.col("side"), "parent_agent").otherwise("user")
        return F.when(plain != "", F.array(_event(block=block, type=F.lit("message"), role=role, text=plain))), F.array_repeat(F.lit("injected_context"), F.coalesce(F.regexp_count(text, F.lit(A_INJECTED)), F.lit(0)))

    texts = F.transform(F.filter(blocks, is_text), lambda b: b["words"])
    joined = F.when(F.size(texts) > 0, F.array_join(texts, "\n"))
    first_text = F.array_position(index(lambda b: is_text(b)), True).cast("int") - 1
    typed_text, put_in = typed(F.coalesce(said, joined), F.when(said.isNotNull(), 0).otherwise(first_text))
    results = F.filter(index(lambda b, i: F.when(is_result(b) & ~reported, result(b, i))), lambda e: e.isNotNull())
    user_left = index(lambda b: F.when(is_result(b), F.when(reported, "subagent_report")).when(is_text(b), F.lit(None)).when(type_of(b).isin("image", "document"), "binary").otherwise("unsupported_entry"))
    inner_left = F.flatten(F.transform(F.filter(blocks, lambda b: is_result(b) & ~reported), lambda b: b["left"]))

    def spoken(b: Column, i: Column) -> Column:
        text = _trimmed(b["words"])
        call = (type_of(b) == "tool_use") & b["id"].isNotNull() & b["tool"].isNotNull()
        return F.when(is_text(b) & (text != ""), _event(block=i, type=F.lit("message"), role=F.lit("assistant"), text=text)).when(call, _a_call(i, b, F.col("cwd")))

    spoken_left = index(
        lambda b: F.when(type_of(b).isin("thinking", "redacted_thinking"), "hidden_reasoning")
        .when(is_text(b) | ((type_of(b) == "tool_use") & b["id"].isNotNull() & b["tool"].isNotNull()), F.lit(None)).otherwise("unsupported_entry")
    )
    none = F.array().cast(f"array<struct<{EVENT}>>")
    events = (
        F.when(~open_, none).when(recap | compact, F.when(summary != "", F.array(_event(block=F.lit(0), type=F.lit("host_summary"), text=summary))))
        .when(kind == "user", F.concat(F.coalesce(results, none), F.coalesce(typed_text, none))).otherwise(F.filter(index(spoken), lambda e: e.isNotNull()))
    )
    nothing = F.array().cast("array<string>")
    left = (
        F.when(~open_, F.array("entry")).when(compact, F.when(said.isNull(), F.col("summary_left"))).when(recap, nothing)
        .when(kind == "user", F.concat(put_in, F.coalesce(F.filter(user_left, lambda r: r.isNotNull()), nothing), F.coalesce(inner_left, nothing))).otherwise(F.filter(spoken_left, lambda r: r.isNotNull()))
    )
    attributed = F.coalesce("known_type", _string(v, "$.attributionAgent"))
    branch = F.when(F.col("side"), F.coalesce(_string(v, "$.agentId"), F.lit("sidechain"))).otherwise("main")
    git = F.when(_string(v, "$.gitBranch") != "", _string(v, "$.gitBranch"))
    rows = rows.select(
        "transcript", F.col("start").alias("line_start"), F.col("end").alias("line_end"), branch.alias("branch"), F.when(F.col("side"), attributed).alias("agent_type"), "uuid", "observed_at", "cwd",
        git.alias("git_branch"), F.col("version").alias("host_version"), F.coalesce(events, none).alias("events"), F.coalesce(left, nothing).alias("left"),
    )
    excluded = rows.select("transcript", F.explode("left").alias("reason")).groupBy("transcript", "reason").agg(F.count("*").alias("n"))
    context = ["transcript", "line_start", "line_end", "branch", "agent_type", "uuid", "observed_at", "cwd", "git_branch", "host_version"]
    found = _finish(rows, context)
    event_id = F.when(F.col("block") == 0, F.col("uuid")).otherwise(F.concat_ws("#", "uuid", "block"))
    return found.withColumn("event_id", event_id).drop("uuid"), excluded, stops


def b_heads(lines: DataFrame) -> DataFrame:
    """What line 1 says about each rollout of host B: transcript, id, cwd, host_version, git_branch, paginated,
    forked_from, subagent, supported, head_end. Rollouts whose first line is no usable session_meta have none."""
    v = strict_json(F.col("text"))
    p = F.col("p")
    rows = lines.where("start = 0 and text is not null").select("transcript", F.col("end").alias("head_end"), v.alias("v")).withColumn("p", _part(F.col("v"), "$.payload"))
    rows = rows.where((_string(F.col("v"), "$.type") == "session_meta") & (F.col("head_end") <= 1 << 20))
    mode, branch = _part(p, "$.history_mode"), _string(p, "$.git.branch")
    paged = (mode.isNotNull() & ~F.coalesce(_string(p, "$.history_mode") == "legacy", F.lit(False))) | F.coalesce(F.schema_of_variant(_part(F.col("v"), "$.ordinal")).rlike("BIGINT|DECIMAL|DOUBLE"), F.lit(False))
    sub = F.coalesce(_string(p, "$.thread_source") == "subagent", F.lit(False)) | _part(p, "$.source.subagent").isNotNull()
    version = _string(p, "$.cli_version")
    rows = rows.select(
        "transcript", _string(p, "$.id").alias("id"), _string(p, "$.cwd").alias("cwd"), version.alias("host_version"), F.when(branch != "", branch).alias("git_branch"), paged.alias("paginated"),
        _string(p, "$.forked_from_id").alias("forked_from"), sub.alias("subagent"), (supported(version, B_VERSIONS) & ~paged).alias("supported"), "head_end",
    )
    return rows.where("id is not null and cwd is not null and host_version is not null").dropDuplicates(["transcript"])


def fork_copies(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """(transcript, start, parent_id, parent_start, parent_time): the first lines of a fork that equal its parent's, line by
    line, but for their time, up to the first that does not. Lines are counted, so each meets one line only, by a digest."""
    v = strict_json(F.col("text"))
    # A line without its time: the other fields of an entry, each in the order of names.
    rest = F.to_json(F.struct(*(F.coalesce(F.to_json(_part(v, f"$.{k}")), F.lit("-")).alias(k) for k in ("type", "payload", "ordinal"))))
    rows = lines.select("transcript", "start", F.when(_object(v), F.sha2(rest.cast("binary"), 256)).alias("digest"), _string(v, "$.timestamp").alias("time"))
    rows = rows.withColumn("line", F.row_number().over(Window.partitionBy("transcript").orderBy("start")))
    forks = heads.where("forked_from is not null").select("transcript", "forked_from")
    ids = heads.groupBy(F.col("id").alias("forked_from")).agg(F.min("transcript").alias("parent"))
    child = rows.join(forks.join(ids, "forked_from"), "transcript").where("line > 1").withColumn("line", F.col("line") - 1)
    parent = rows.join(ids.select(F.col("parent").alias("transcript")), "transcript", "left_semi").select(F.col("transcript").alias("parent"), "line", F.col("digest").alias("other"), F.col("start").alias("parent_start"), F.col("time").alias("parent_time"))
    both = child.join(parent, ["parent", "line"], "left").withColumn("same", F.coalesce((F.col("digest") == F.col("other")) & F.col("parent_time").isNotNull(), F.lit(False)))
    parted = F.min(F.when(~F.col("same"), F.col("line"))).over(Window.partitionBy("transcript"))
    both = both.withColumn("parted", parted).where(F.col("parted").isNull() | (F.col("line") < F.col("parted")))
    return both.select("transcript", "start", F.col("forked_from").alias("parent_id"), "parent_start", "parent_time")


def _b_call(p: Column, kind: Column, cwd: Column, fallback: Column) -> Column:
    """A call of host B."""
    space, name = _string(p, "$.namespace"), _string(p, "$.name")
    tool = F.when(space.isNull(), name).otherwise(F.concat(F.regexp_replace(space, "_+$", ""), F.lit("__"), F.regexp_replace(name, "^_+", "")))
    raw = F.when(kind == "custom_tool_call", _string(p, "$.input")).otherwise(_string(p, "$.arguments"))
    args = F.when(kind != "custom_tool_call", strict_json(raw))
    own = _own_tool(tool, "(?:_[0-9a-f]{12})?")
    custom = kind == "custom_tool_call"
    # Arguments that are no JSON describe nothing.
    given = F.coalesce(F.when(custom, raw.isNotNull()).otherwise(args.isNotNull()), F.lit(False)) & own.isNull()
    # A shell's arguments: the command as one string or as words, and the folder that it runs in.
    text = F.when(tool == "exec_command", _string(args, "$.cmd")).when(tool == "shell_command", _string(args, "$.command"))
    argv = F.when(tool == "shell", _list(args, "$.command"))
    is_word = lambda w: F.schema_of_variant(w) == "STRING"
    words = F.when(F.forall(argv, is_word), F.transform(argv, lambda w: w.cast("string")))
    where = F.when(_string(args, "$.workdir").isNotNull(), resolved(cwd, _string(args, "$.workdir"))).otherwise(cwd)
    shown = F.coalesce(text, F.array_join(F.transform(F.filter(argv, is_word), lambda w: w.cast("string")), " "), F.lit(""))
    patch = F.when(custom, raw).otherwise(_string(args, "$.input"))
    patched = F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(r"(?m)^\*\*\* (?:(?:Add|Update|Delete) File|Move to): (.+)$"), 1)
    patched = F.array_distinct(F.filter(F.transform(patched, _trimmed), lambda f: f != ""))
    image = F.when(_string(args, "$.path").isNotNull(), resolved(cwd, _string(args, "$.path")))
    session = F.coalesce(_string(args, "$.session_id"), _whole(args, "$.session_id").cast("string"), F.lit("?"))
    local = F.transform(F.filter(_list(p, "$.action.command"), lambda w: F.schema_of_variant(w) == "STRING"), lambda w: w.cast("string"))
    action, url = _string(p, "$.action.type"), _string(p, "$.action.url")
    search = (
        F.when((action == "search") & _string(p, "$.action.query").isNotNull(), F.concat(F.lit("web_search "), _quoted(_string(p, "$.action.query"))))
        .when((action == "open_page") & url.isNotNull(), F.concat(F.lit("web_search open "), url))
        .when((action == "find_in_page") & url.isNotNull(), F.concat(F.lit("web_search find "), _quoted(_string(p, "$.action.pattern")), F.lit(" in "), url)).otherwise("web_search")
    )
    summary = (
        F.when(kind == "local_shell_call", F.concat(F.lit("$ "), F.coalesce(F.array_join(local, " "), F.lit("")))).when(kind == "web_search_call", search)
        .when(own.isNotNull(), F.concat(own, F.lit(" "), F.coalesce(F.to_json(args), F.lit("{}")))).when(given & tool.isin(*B_SHELLS), F.concat(F.lit("$ "), shown))
        .when(given & (tool == "apply_patch"), F.concat(F.lit("apply_patch "), F.array_join(patched, ", "))).when(given & (tool == "view_image"), F.concat(F.lit("view_image "), F.coalesce(image, F.lit("(no path)"))))
        .when(given & (tool == "write_stdin"), F.concat(F.lit("write_stdin → session "), session)).when(given & (tool == "spawn_agent"), F.concat(F.lit("spawn_agent: "), F.coalesce(_string(args, "$.agent_type"), F.lit(""))))
        .otherwise(F.concat(tool, F.lit(" [arguments omitted]")))
    )
    known = given & tool.isin(*B_SHELLS, "apply_patch", "view_image", "write_stdin", "spawn_agent")
    none = F.array().cast("array<string>")
    plain = kind.isin("function_call", "custom_tool_call")
    return _event(
        block=F.lit(0), type=F.lit("tool_call"), summary=summary,
        call_id=F.when(kind == "web_search_call", F.coalesce(_string(p, "$.id"), fallback)).when(kind == "local_shell_call", F.coalesce(_string(p, "$.call_id"), fallback)).otherwise(_string(p, "$.call_id")),
        tool=F.when(kind == "local_shell_call", "local_shell").when(kind == "web_search_call", "web_search").otherwise(tool),
        paths=F.when(plain & given & (tool == "apply_patch"), F.transform(patched, lambda f: resolved(cwd, f))).when(plain & given & (tool == "view_image") & image.isNotNull(), F.array(image)).otherwise(none),
        urls=F.when((kind == "web_search_call") & url.isNotNull(), F.array(url)).otherwise(none), tool_kind=F.when(plain & own.isNotNull(), "own").when(plain & given & tool.isin("apply_patch", "view_image"), "artifact_access").otherwise("other"),
        input_digest=F.when(plain & own.isNull() & ~known, _digest(F.coalesce(raw, F.lit("null")))), command=F.when(plain & given, text), argv=F.when(plain & given, words), run_in=where,
    )


def b_events(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, excluded, stops) of host B's rollouts, in the form of a_events.

    The first line names the version that gates the whole file; cwd and git branch hold from the line that sets them on;
    a line with an ordinal stops the reading. An event's id is `<thread>@<offset of its line>`; the copied first lines of
    a fork keep their parent's id and time. Rollouts without a usable first line stop at once as `missing`.
    """
    heads = b_heads(lines)
    v, p = F.col("v"), F.col("p")
    rows = lines.select("transcript", "start", "end", "text", strict_json(F.col("text")).alias("v")).withColumn("object", _object(v))
    head = heads.select("transcript", F.col("id").alias("thread"), F.col("cwd").alias("head_cwd"), F.col("git_branch").alias("head_branch"), F.col("host_version").alias("head_version"), "paginated", "supported")
    rows = rows.join(head, "transcript", "left")
    ordinal = F.coalesce(F.col("object") & F.schema_of_variant(_part(v, "$.ordinal")).rlike("BIGINT|DECIMAL|DOUBLE"), F.lit(False))
    rows = rows.withColumn("version", F.when(F.col("paginated") | ordinal, F.concat("head_version", F.lit("+paginated"))).otherwise(F.col("head_version")))
    rows, stops = _stopped(rows, ~F.coalesce("supported", F.lit(False)) | ordinal)
    rows = rows.withColumn("kind", F.when(F.col("object"), _string(v, "$.type"))).withColumn("p", F.when(F.col("object"), _part(v, "$.payload"))).withColumn("time", _string(v, "$.timestamp"))
    fine = F.col("kind").isNotNull() & F.col("time").isNotNull() & _object(p)
    # What a line says about folder and branch holds from there on; an own meta without a branch clears it.
    own_meta = F.coalesce(fine & (F.col("kind") == "session_meta") & (_string(p, "$.id") == F.col("thread")), F.lit(False))
    branch = F.when(_string(p, "$.git.branch") != "", _string(p, "$.git.branch"))
    since = Window.partitionBy("transcript").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cwd", F.coalesce(F.last(F.when(fine & (F.col("kind") == "turn_context"), _string(p, "$.cwd")), ignorenulls=True).over(since), F.col("head_cwd")))
    moved = F.last(F.when(own_meta, F.struct(branch.alias("b"))), ignorenulls=True).over(since)
    rows = rows.withColumn("moved", moved).withColumn("git_branch", F.when(F.col("moved").isNotNull(), F.col("moved.b")).otherwise(F.col("head_branch")))
    rows = rows.join(fork_copies(lines, heads), ["transcript", "start"], "left")

    kind, item = F.col("kind"), F.coalesce(_string(p, "$.type"), F.lit(""))
    message = _string(p, "$.message")
    trimmed = _trimmed(message)
    is_text = (kind == "event_msg") & item.isin("user_message", "agent_message")
    cut = F.when(F.startswith(trimmed, F.lit(B_SUMMARY_PREFIX)) & F.contains(trimmed, F.lit("\n")), _trimmed(F.substring(trimmed, F.locate("\n", trimmed) + 1, F.length(trimmed)))).otherwise(trimmed)
    summary = F.when((kind == "compacted") & (trimmed != ""), cut)
    calls = (kind == "response_item") & item.isin("function_call", "custom_tool_call")
    bad_call = calls & (_string(p, "$.name").isNull() | _string(p, "$.call_id").isNull())
    outputs = (kind == "response_item") & item.isin("function_call_output", "custom_tool_call_output")
    parts, plain = _list(p, "$.output"), _string(p, "$.output")
    is_input = lambda b: F.coalesce((_string(b, "$.type") == "input_text") & _string(b, "$.text").isNotNull(), F.lit(False))
    text = F.coalesce(plain, F.array_join(F.transform(F.filter(parts, is_input), lambda b: _string(b, "$.text")), "\n"))
    bad_output = outputs & (_string(p, "$.call_id").isNull() | text.isNull())
    framed = text.rlike(B_HEADER)
    body = F.when(framed, F.regexp_replace(text, B_HEADER, "")).otherwise(text)
    first, second, running = (F.when(framed, F.regexp_extract(text, B_HEADER, k)) for k in (1, 2, 3))
    code = F.coalesce(F.when(first != "", first), F.when(second != "", second))
    whole = F.when(framed & plain.isNotNull(), (second != "") & (running == "") & ~body.rlike(B_TRUNCATED))
    result = _event(block=F.lit(0), type=F.lit("tool_result"), call_id=_string(p, "$.call_id"), text=body, is_error=F.coalesce(code != "0", F.lit(False)), intact=whole)
    other_calls = (kind == "response_item") & item.isin("local_shell_call", "web_search_call")
    fallback = F.concat("thread", F.lit("@"), F.col("start").cast("string"))
    event = (
        F.when(~fine, F.lit(None)).when(summary != "", _event(block=F.lit(0), type=F.lit("host_summary"), text=summary))
        .when(is_text & (trimmed != ""), _event(block=F.lit(0), type=F.lit("message"), role=F.when(item == "user_message", "user").otherwise("assistant"), text=trimmed))
        .when((calls & ~bad_call) | other_calls, _b_call(p, item, F.col("cwd"), fallback)).when(outputs & ~bad_output, result)
    )
    media = F.lit(0)
    for key in ("images", "local_images", "audio", "local_audio"):
        media = media + F.coalesce(F.size(_list(p, f"$.{key}")), F.lit(0))
    contextual = F.exists(_list(p, "$.content"), lambda b: F.coalesce(F.regexp_replace(F.lower(_string(b, "$.text")), rf"^{_SPACE}+", "").rlike("^(?:" + "|".join(m.replace("#", r"\#") for m in B_CONTEXTUAL) + ")"), F.lit(False)))
    role = F.coalesce(_string(p, "$.role"), F.lit(""))
    one = lambda c: F.array(F.lit(c))
    nothing = F.array().cast("array<string>")
    inner = F.filter(F.transform(parts, lambda b: F.when(is_input(b), F.lit(None)).when(F.coalesce(_string(b, "$.type"), F.lit("")).isin("input_image", "input_file"), "binary").otherwise("unsupported_entry")), lambda r: r.isNotNull())
    left = (
        F.when(F.col("text").isNull(), one("oversized_entry")).when(~F.col("object") | ~fine, one("malformed")).when(kind.isin("session_meta", "turn_context"), one("host_metadata"))
        .when(kind == "compacted", F.when(F.coalesce(trimmed, F.lit("")) == "", one("host_metadata")).otherwise(nothing))
        .when(is_text, F.when(message.isNull(), one("malformed")).otherwise(F.array_repeat(F.lit("binary"), F.when(item == "user_message", media).otherwise(0))))
        .when((kind == "event_msg") & F.startswith(item, F.lit("agent_reasoning")), one("hidden_reasoning"))
        .when(kind == "event_msg", F.when(item.isin(*B_METADATA_EVENTS), one("host_metadata")).otherwise(one("unsupported_entry")))
        .when(kind != "response_item", F.when(kind.isin(*B_METADATA_TYPES), one("host_metadata")).otherwise(one("unsupported_entry")))
        .when(item == "message", F.when(role.isin("developer", "system") | ((role == "user") & F.coalesce(contextual, F.lit(False))), one("injected_context")).otherwise(one("host_metadata")))
        .when(item == "reasoning", one("hidden_reasoning")).when(bad_call | bad_output, one("malformed")).when(outputs, F.coalesce(inner, nothing)).when(calls | other_calls, nothing)
        .when(item == "image_generation_call", one("binary")).otherwise(F.when(item.isin(*B_METADATA_ITEMS), one("host_metadata")).otherwise(one("unsupported_entry")))
    )
    copied = F.col("parent_id").isNotNull()
    event_id = F.when(copied, F.concat("parent_id", F.lit("@"), F.col("parent_start").cast("string"))).otherwise(fallback)
    rows = rows.select(
        "transcript", F.col("start").alias("line_start"), F.col("end").alias("line_end"), F.lit("main").alias("branch"), F.lit(None).cast("string").alias("agent_type"), event_id.alias("event_id"),
        F.when(copied, F.col("parent_time")).otherwise(F.col("time")).alias("observed_at"), "cwd", "git_branch", F.col("head_version").alias("host_version"),
        F.filter(F.array(event), lambda e: e.isNotNull()).alias("events"), left.alias("left"),
    )
    excluded = rows.select("transcript", F.explode("left").alias("reason")).groupBy("transcript", "reason").agg(F.count("*").alias("n"))
    return _finish(rows, ["transcript", "line_start", "line_end", "branch", "agent_type", "event_id", "observed_at", "cwd", "git_branch", "host_version"]), excluded, stops
