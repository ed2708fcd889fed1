"""The corpus pipeline: documents to packed windows, each stage written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memoria.llm import exact_dedup, language_id, ngram_join, packing, secrets
from memoria.llm.common import stash, table


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose language the network cannot determine go: null, empty and letterless ones, and those
    whose pooled probability is below a cut fitted on held-out documents."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts one row stays, that with the largest doc_id; of rows with one id and text any one."""
    return exact_dedup.drop_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles at 0.8: of each group the document with the smallest doc_id stays. Rows
    are told apart by id and text; documents that link with nothing all stay."""
    return ngram_join.one_of_each(docs, k=5, num=4, den=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every document stays; the values of live credentials are cut out of its text."""
    return secrets.redact_live(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: all that is left, one row per piece; null or empty texts are the end id alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", keep_identified),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("packing", pack_windows),
]

#: SQL can express neither the first stage's network nor the last stage's tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
    return docs
