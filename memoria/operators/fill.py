"""Filling in vectors by regions: what was just written, then the reader's own workstream, then the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The order in which a pass works.
REGIONS = ("fresh", "scope", "rest")
VECTOR = "model string, text_hash string, `values` array<int>, scale double"


def region(workstream: str | None, top: int, since: int = 0) -> Column:
    """The place in REGIONS of a chunk (id, workstream_id): written after the pass began (its newest chunk was top), of the
    workstream or of none, of any other; null for what an earlier pass has been through (up to since)."""
    own = F.col("workstream_id").isNull() | (F.col("workstream_id").eqNullSafe(F.lit(workstream)))
    return F.when(F.col("id") > top, 0).when(F.col("id") > since, F.when(own, 1).otherwise(2))


def missing(chunks: DataFrame, fillable: DataFrame, vectors: DataFrame, model: str, workstream: str | None, top: int, since: int = 0, limit: int = 8) -> DataFrame:
    """(text_hash, text) of the next texts without a vector of the model: by region, newest record first, each once.

    chunks: id, seq, ordinal, text, text_hash; fillable: seq, workstream_id of the records that may be embedded; vectors:
    model, text_hash. A text that many chunks share is asked for where it comes first; it shrinks to one row before the
    order is taken, and the order is a top-k, so nothing is gathered. Texts themselves are read for those rows alone."""
    rows = chunks.join(fillable.select("seq", "workstream_id"), "seq").withColumn("region", region(workstream, top, since)).where("region is not null and text_hash is not null")
    rows = rows.join(vectors.where(F.col("model") == model).select("text_hash"), "text_hash", "left_anti")
    first = rows.groupBy("text_hash").agg(F.min(F.struct("region", (-F.col("seq")).alias("newest"), "ordinal")).alias("f"))
    wanted = first.orderBy("f.region", "f.newest", "f.ordinal", "text_hash").limit(limit).select("text_hash")
    return chunks.select("text_hash", "text").join(F.broadcast(wanted), "text_hash").groupBy("text_hash").agg(F.min("text").alias("text"))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The vectors that finished steps have written below path, with their step."""
    try:
        return spark.read.schema(f"{VECTOR}, step int").parquet(path)
    except Exception as e:  # no step yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{VECTOR}, step int")


def fill(
    chunks: DataFrame, fillable: DataFrame, path: str, model: str, embed: Callable[[pd.Series], pd.DataFrame], workstream: str | None, top: int, since: int = 0, limit: int = 8, steps: int | None = None
) -> int:
    """Embed what is missing, `limit` texts a step, until nothing is or `steps` are done; returns how many were.

    embed: a batch of texts to the columns values and scale. Every step is a folder of its own that shows only when it is
    whole, so a run that was stopped goes on after its last whole step and no text is embedded twice. Chunks written
    while a pass runs are its first region; they are found if the tables given see them."""
    spark = chunks.sparkSession

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = embed(rows["text"])
            yield pd.DataFrame({"model": model, "text_hash": rows["text_hash"], "values": made["values"], "scale": made["scale"]})

    done = 0
    while steps is None or done < steps:
        known = stored(spark, path)
        n = known.agg(F.coalesce(F.max("step") + 1, F.lit(0))).first()[0]
        todo = missing(chunks, fillable, known, model, workstream, top, since, limit).persist()
        try:
            if not todo.count():
                break
            todo.repartition(spark.sparkContext.defaultParallelism).mapInPandas(work, VECTOR).write.mode("overwrite").parquet(f"{path}/step={n}")
        finally:
            todo.unpersist()
        done += 1
    return done
