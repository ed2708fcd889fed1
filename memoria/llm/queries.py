"""The registered queries of the training-data operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, context_mixing, exact_dedup, html_extract, language_id, merge_dropout, ngram_join, nn_descent, packing, passages, periodic_runs, secrets, toxicity
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Null or empty html: empty text; null url: compared with no page; repeated rows: a row each; empty table: none."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors of one label at cosine 0.98. Null, zero or non-finite vectors and null labels link with nothing; repeated rows are copies; empty table: none."""
    return nn_descent.similar_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text. Null text or none with a letter: und and 0; repeated rows are predicted each; empty table: none."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents at a Jaccard of 0.9 over three-word shingles. Null or blank text links with nothing; repeated rows are one node and a row each; empty table: none."""
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text at a dropout of 0.1. Null or empty text: no ids; repeated rows: a row each; empty table: none."""
    import public_tokenizers

    return merge_dropout.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), rate=0.1, seed=2024)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in windows of 2048. Null or empty text: the end id alone; repeated rows are packed each; empty table: none."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that other documents have. Short and null texts have none; repeated rows count as copies; empty table: none."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"), least_words=50)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text. Null or empty text is never flagged; rows with a null id or label are left out of the fit; empty table: none."""
    docs = table(spark, sf_dir, "documents")
    categories = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), categories)
    return toxicity.score(docs, chain, list(categories))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text. Null text: none; repeated rows are scanned each; columns named like working ones do no harm; empty table: none."""
    return secrets.secret_spans(table(spark, sf_dir, "documents"), repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, the largest doc_id stays. Null counts as empty; null ids count and are not kept; empty table: none."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op11_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole text. Null or empty text: its end alone; a null id is not held out; repeated rows count and are scored each; empty table: none."""
    return context_mixing.score(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every whole text. Null, empty or blank text: no words and no runs; a null id leaves the words as they are; repeated rows: a row each; empty table: none."""
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers' tokens of every whole text linked by bytes. Null or empty text, or tokens with other bytes: zeros; repeated rows count and get a row each; empty table: none."""
    import public_tokenizers as known

    return alignment.align(table(spark, sf_dir, "documents"), known.path("byte_bpe_50k.json"), known.PATTERN, known.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_merge_dropout": op5_merge_dropout,
    "op6_packing": op6_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_context_mixing": op11_context_mixing,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _op9_sql() -> str:
    value = "[A-Za-z0-9+/_.=-]+"
    assign = f"""(?:{_any_case("password|passwd|secret|token|api_?key")})["'']?\\x20*[:=]\\x20*["'']?({value})"""
    kinds = ((0, assign), (1, secrets.ACCESS), (2, secrets.HEX))
    matches = " UNION ALL ".join(
        f"""SELECT sha, {k} AS kind, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS match, unnest(g[1:len(m)]) AS gap, {"unnest(v)" if k == 0 else "unnest(m)"} AS value
            FROM (SELECT sha, regexp_extract_all(t, '{p}', 0) AS m, {f"regexp_extract_all(t, '{p}', 1)" if k == 0 else "NULL"} AS v, regexp_split_to_array(t, '{p}') AS g FROM texts)"""
        for k, p in kinds
    )
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS sha, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents),
        texts AS (SELECT sha, any_value(t) AS t FROM d GROUP BY sha),
        matches AS ({matches}),
        placed AS (SELECT sha, kind, value, length(match) AS n, sum(length(gap) + length(match)) OVER (PARTITION BY sha, kind ORDER BY i) AS e FROM matches),
        base AS (SELECT sha, kind, value, e - n AS s, e FROM placed WHERE kind <> 0 OR length(value) >= {secrets.ASSIGN_LEAST}),
        counts AS (
            SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories, bool_or(regexp_matches(lower(value), '{secrets.PLACEHOLDER}')) AS placeholder
            FROM base JOIN d USING (sha) GROUP BY value),
        extra AS (
            SELECT DISTINCT sha, CASE WHEN owners >= 4 OR owners > 1 AND (repositories >= 8 OR placeholder) THEN 4 ELSE 3 END AS kind, CASE WHEN kind = 0 THEN e - length(value) ELSE s END AS s, e
            FROM base JOIN counts USING (value)),
        names AS (SELECT sha, kind, s, e, {list(secrets.KINDS)!r}[kind + 1] || ':' || s || ':' || e AS shown FROM (SELECT sha, kind, s, e FROM base UNION ALL SELECT sha, kind, s, e FROM extra)),
        shown AS (
            SELECT sha, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                   string_agg(shown, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base, string_agg(shown, ',' ORDER BY s, kind, e) AS spans
            FROM names GROUP BY sha)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN shown USING (sha)
    """


ORACLE_SQL: dict[str, str] = {
    "op9_secret_scan": _op9_sql(),
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
