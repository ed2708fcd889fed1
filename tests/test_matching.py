"""Which records a query matches: all of them are asked, and each pair comes once."""

import duckdb
import pytest
from pyspark.sql import functions as F

from memoria import plans
from memoria.operators import ranking

DOCS = [(1, "Blue houses by the sea"), (39, "nothing here"), (40, "the sea"), (41, "Été bleu, sea sea"), (41, "houses"), (80, None), (81, ""), (None, "a blue one"), (121, "HOUSES")]


@pytest.mark.parametrize("docs", [DOCS, DOCS[1:2], []], ids=["odd", "none", "empty"])
def test_matching_seqs_asks_every_record(spark, tmp_path, docs):
    rows = spark.createDataFrame([(d, t, "en", "src1") for d, t in docs], "doc_id long, text string, lang string, source string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "Blue, blue ete"), (1, "the sea and houses"), (2, None), (3, "unheard")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ours = sorted(((r.query_id, r.seq) for r in plans.QUERIES["matching_seqs"](spark, str(tmp_path)).collect()), key=repr)
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    assert ours == sorted(db.execute(plans.SQL["matching_seqs"]).fetchall(), key=repr)
    if docs == DOCS:
        assert ours == sorted([(0, 1), (0, 41), (0, None), (1, 1), (1, 40), (1, 41), (1, 121)], key=repr)


def test_matches_equal_a_plain_join_in_many_blocks(spark):
    chunks = spark.range(300).select(F.col("id").alias("seq"), (F.col("id") % 2).alias("ordinal"), F.concat_ws(" ", *(F.concat(F.lit(c), F.col("id") % n) for c, n in (("a", 7), ("b", 11), ("c", 50)))).alias("body"))
    terms = spark.createDataFrame([(q, t) for q in range(9) for t in (f"a{q}", f"b{q + 3}", "c8", "none")], "query_id long, term string")
    index = ranking.asked_postings(chunks, terms.select(F.col("term").alias("word"), "term").distinct())
    want = ranking.postings(chunks).join(terms, "term").select("query_id", F.col("id").alias("seq")).distinct()
    got = ranking.matches(index, ranking.weighed(index, terms), block=2, part=40)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
