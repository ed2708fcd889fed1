"""Incremental ingest: a stream of newly landed transcript files, applied exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

LINE = "transcript string, branch string, event_id string, role string, text string"
#: What an event is known by; the content decides between a replay and a new version.
KEY = ["transcript", "branch", "event_id"]


def parsed(lines: DataFrame) -> DataFrame:
    """Rows of JSON lines (column value); torn and foreign lines have corrupt set and no fields."""
    rows = lines.select(F.from_json("value", LINE + ", corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("e"))
    return rows.select("e.*").withColumn("content_hash", F.sha2(F.concat_ws("\x1f", "role", "text"), 256))


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """Events of batches whose commit marker was written; what a lost run left behind is not seen."""
    try:
        marks = spark.read.parquet(f"{path}/_batches").select("batch").distinct()
    except Exception as e:  # no batch yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return spark.read.parquet(f"{path}/events").join(marks, "batch", "left_semi")


def apply_batch(spark: SparkSession, batch: DataFrame, number: int, path: str) -> None:
    """Append a batch's unseen events, then its marker. Running a batch again changes nothing: its rows have a folder of
    their own that is overwritten, and events of other batches are left out by an anti-join on key and content."""
    rows = batch.where("corrupt is null and event_id is not null")
    first = Window.partitionBy(*KEY, "content_hash").orderBy(F.monotonically_increasing_id())
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "corrupt")
    seen = committed(spark, path)
    if seen is not None:
        seen = seen.where(F.col("batch") != number)
        rows = rows.join(seen.select(*KEY, "content_hash"), [*KEY, "content_hash"], "left_anti")
        older = seen.select(*KEY).distinct().withColumn("again", F.lit(True))
        rows = rows.join(older, KEY, "left").withColumn("version", F.coalesce("again", F.lit(False))).drop("again")
    else:
        rows = rows.withColumn("version", F.lit(False))
    # Of several contents of one key within the batch all but the first are versions too.
    place = Window.partitionBy(*KEY).orderBy("content_hash")
    rows = rows.withColumn("version", F.col("version") | (F.row_number().over(place) > 1))
    rows.select(*KEY, "role", "text", "content_hash", "version").write.mode("overwrite").parquet(f"{path}/events/batch={number}")
    spark.range(1).select(F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{path}/_batches/batch_no={number}")


def ingest(spark: SparkSession, source: str, path: str, checkpoint: str) -> StreamingQuery:
    """Read the files that have landed in source since the last run, and stop. Files are read once; growing ones are
    told apart by operators.ingest.changes and land again as slices."""
    lines = spark.readStream.schema("value string").text(source)
    return (
        parsed(lines).writeStream.foreachBatch(lambda batch, number: apply_batch(batch.sparkSession, batch, number, path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
