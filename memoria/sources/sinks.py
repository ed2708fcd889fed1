"""Sinks: records with what belongs to them, the call log and the ledger, each append visible whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import upkeep

LEDGER = "v int, id string, kind string, action string, recordId string, replacementId string, sessionId string, host string, attribution string, at string, events array<struct<host: string, eventId: string>>"


def _marks(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema("commit string").parquet(f"{path}/_commits")
    except Exception as e:  # nothing committed yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "commit string")


def append(spark: SparkSession, path: str, commit: str, tables: dict[str, DataFrame]) -> bool:
    """Append rows to several tables under one name. They show when its mark is written, all at once; a name that is known
    changes nothing and gives False, so an append that is tried again is applied once. What a lost one left is written over."""
    if not commit.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"a commit's name has letters, digits, - and _ only: {commit!r}")
    if _marks(spark, path).where(F.col("commit") == commit).limit(1).count():
        return False
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/commit={commit}")
    spark.range(1).select(F.lit(commit).alias("commit")).write.mode("overwrite").parquet(f"{path}/_commits/of={commit}")
    return True


def read(spark: SparkSession, path: str, name: str, ddl: str) -> DataFrame:
    """A table's committed rows; none where nothing was."""
    marks = _marks(spark, path).select("commit").distinct()
    try:
        rows = spark.read.schema(f"{ddl}, commit string").parquet(f"{path}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ddl)
    return rows.join(marks, "commit", "left_semi").drop("commit")


def content_hash(kind: Column, title: Column, body: Column, refs: Column, applicability: Column) -> Column:
    """SHA-256 of a record's content as a JSON list; refs and applicability are JSON texts."""
    made = F.to_json(F.struct(F.array(*(F.coalesce(c, F.lit("\x00")) for c in (kind, title, body, refs, applicability))).alias("l")))
    text = F.replace(F.substring(made, F.lit(6), F.length(made) - 6), F.lit('"\\u0000"'), F.lit("null"))
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def append_records(spark: SparkSession, path: str, commit: str, new: DataFrame, links: DataFrame, records: DataFrame, taints: DataFrame, inherit: bool = False) -> bool:
    """Append records with their links, chunks and the taints that they inherit, under one commit.

    new: id, seq, kind, title, body, workstream_id, refs (array of locator, path), applicability (JSON); links: from_id,
    to_id, relation of the new records; records: id, workstream_id, lifecycle of all there are; taints: record, cause,
    taint. Links to records that are not in the writer's scope, or not there, are left out. With inherit a copy of any
    record that is no longer active is invalidated, what rests on a wrong or removed one quarantined, and both take over
    the taints of what they cite, the stronger label winning.
    """
    hashed = new.withColumn("content_hash", content_hash(F.col("kind"), F.col("title"), F.col("body"), F.to_json(F.coalesce("refs", F.array().cast(new.schema["refs"].dataType))), F.col("applicability")))
    target = records.select(F.col("id").alias("to_id"), F.col("workstream_id").alias("there"), "lifecycle")
    kept = links.join(new.select(F.col("id").alias("from_id"), F.col("workstream_id").alias("here")), "from_id").join(target, "to_id").where(F.col("there").isNull() | F.col("here").isNull() | (F.col("there") == F.col("here")))
    tables = {"records": hashed, "links": kept.select("from_id", "to_id", "relation").distinct(), "chunks": upkeep.chunks(new)}
    if inherit:
        tables["taints"] = inherited(kept, taints)
    return append(spark, path, commit, tables)


def inherited(links: DataFrame, taints: DataFrame) -> DataFrame:
    """(record, cause, taint) that new records take over by their links (from_id, to_id, relation, lifecycle of to_id)."""
    held = links.where(F.col("relation").isin("derived_from", "supported_by")).withColumn("copy", F.col("relation") == "derived_from")
    gone = held.where((F.col("lifecycle") != "active") & (F.col("copy") | F.col("lifecycle").isin("corrected", "retracted", "forgotten")))
    own = gone.select(F.col("from_id").alias("record"), F.col("to_id").alias("cause"), F.when(F.col("copy"), "invalidated").otherwise("quarantined").alias("taint"))
    more = held.join(taints.select(F.col("record").alias("to_id"), "cause", "taint"), "to_id").select(F.col("from_id").alias("record"), "cause", F.when(F.col("copy"), F.col("taint")).otherwise("quarantined").alias("taint"))
    return own.union(more).groupBy("record", "cause").agg(F.min("taint").alias("taint"))


#: The arguments that a call's row keeps.
KEPT_ARGUMENTS = {
    "memory_recall": ("kinds", "mode", "maxBytes", "maxTokens"), "memory_bootstrap": ("maxBytes", "maxTokens", "importChoice", "workstream"), "memory_read": ("recordId", "around", "offset", "maxBytes", "maxTokens"),
    "memory_record": ("kind", "attribution", "workspaceLevel", "expectedRevision"), "memory_checkpoint": ("kind", "attribution", "workspaceLevel", "expectedRevision"), "memory_manage": ("action",),
}


def described_calls(calls: DataFrame) -> DataFrame:
    """What the call log keeps of calls (name, args, result: JSON; returned: array of ids; bytes, private): adds query,
    params (a map of named arguments, each as JSON), returned, tokens, empty, continued, continues and erased.

    Only the arguments named in KEPT_ARGUMENTS stay, of a written text only its bytes (textBytes). A private session's
    call keeps none of it. Arguments that are no JSON are none."""
    args, result = F.try_parse_json("args"), F.try_parse_json("result")
    part = lambda v, k: F.try_variant_get(v, f"$.{k}", "variant")
    string = lambda v, k: F.when(F.schema_of_variant(part(v, k)) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
    name = F.col("name")
    none = F.lit(None).cast("map<string,string>")
    params = none
    for call, keys in KEPT_ARGUMENTS.items():
        pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.to_json(part(args, k)).alias("value")) for k in keys)), lambda p: p["value"].isNotNull())
        if call in ("memory_record", "memory_checkpoint"):
            size = sum((F.coalesce(F.octet_length(string(args, k)), F.lit(0)) for k in ("body", "goal", "status")), F.lit(0))
            pairs = F.array_append(pairs, F.struct(F.lit("textBytes").alias("key"), size.cast("string").alias("value")))
        params = F.when(name == call, F.map_from_entries(pairs)).otherwise(params)
    pack = F.when(name == "memory_bootstrap", part(result, "context")).otherwise(result)
    written = F.filter(F.array(string(result, "recordId")), lambda r: r.isNotNull())
    ids = F.concat(F.filter(F.array(string(args, "recordId")), lambda r: r.isNotNull()), F.coalesce(F.try_variant_get(args, "$.recordIds", "array<string>"), F.array().cast("array<string>")))
    returned = F.when(name.isin("memory_record", "memory_checkpoint"), written).when(name == "memory_manage", ids).otherwise(F.coalesce("returned", F.array().cast("array<string>")))
    searched = name.isin("memory_recall", "memory_bootstrap")
    more = F.when(searched, string(pack, "continuation").isNotNull()).when(name == "memory_read", part(result, "nextOffset").isNotNull() & ~F.coalesce(F.is_variant_null(part(result, "nextOffset")), F.lit(True))).otherwise(F.lit(False))
    open_ = ~F.coalesce("private", F.lit(False))
    return calls.withColumns({
        "query": F.when(open_ & (name == "memory_recall"), string(args, "query")), "params": F.when(open_, F.coalesce(params, F.create_map().cast("map<string,string>"))).otherwise(F.create_map().cast("map<string,string>")),
        "returned": F.when(open_, returned).otherwise(F.array().cast("array<string>")), "tokens": F.ceil(F.col("bytes") / 4).cast("long"), "empty": F.when(open_ & searched, F.try_variant_get(pack, "$.empty", "boolean")),
        "continued": F.coalesce(open_ & (name == "memory_recall") & string(args, "continuation").isNotNull(), F.lit(False)), "continues": F.coalesce(open_ & more, F.lit(False)), "erased": F.when(~open_, "private"),
    }).drop("args", "result")


def append_ledger(entries: DataFrame, path: str) -> None:
    """Append entries (LEDGER) as JSON lines."""
    entries.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Every well-formed entry of a ledger's lines: version 1 with an id, and either a change of a record or a session made
    private. Torn and foreign lines are passed over; a ledger that is not there has none."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)
    rows = lines.select(F.from_json("value", f"{LEDGER}, torn string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "torn"}).alias("e")).select("e.*")
    fine = F.col("torn").isNull() & (F.col("v") == 1) & F.col("id").isNotNull() & (F.when(F.col("kind").isNull(), F.col("recordId")).when(F.col("kind") == "private_session", F.col("sessionId"))).isNotNull()
    return rows.where(fine).drop("torn")
