"""Operators that other queries use in passing, or not at all, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter as M
from ..operators import retrieval as R
from ..operators import validation as D
from ..sources import files as S
from .common import ASKED, DOCS, chunks, questions, ranked, table, with_
from .corpus import FRONT, ISSUES, META, TWO, described, manifests
from .documents import sql_strip


def okapi_topk(spark, sf_dir) -> DataFrame:
    return ranked(R.okapi(chunks(spark, sf_dir), questions(spark, sf_dir)))


def fronted(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(FRONT.replace("chr(65279)", "'﻿'")).alias("t"))


def front_matter_prefixed(spark, sf_dir) -> DataFrame:
    """Front matter by its --- alone."""
    made = fronted(spark, sf_dir).withColumn("f", M.prefixed(F.col("t")))
    m = F.col("f.metadata")
    return made.select("doc_id", *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("title", "flag", "n", "lang")], F.size(F.map_keys(m)).alias("n_keys"), F.md5("f.body").alias("body"))


def front_matter_strict(spark, sf_dir) -> DataFrame:
    """Front matter that has to be there, and what is wrong where it isn't."""
    made = fronted(spark, sf_dir).withColumn("f", M.strict(F.col("t")))
    return made.select("doc_id", F.col("f.error").alias("error"), F.try_element_at("f.metadata", F.lit("lang")).alias("lang"), F.md5("f.body").alias("body"))


def store(spark, sf_dir) -> DataFrame:
    """Embeddings as a store's rows, with audiences made of labels."""
    audience = F.when(F.col("label") % 3 == 0, "student").when(F.col("label") % 3 == 1, "all")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_idx"), "label", audience.alias("audience"), "embedding")


def audience_rows(spark, sf_dir) -> DataFrame:
    """Rows for students alone, as a search gives them back: without their vectors."""
    return R.without_vectors(R.filter_by_audience(store(spark, sf_dir), "student"))


def chunk_at(spark, sf_dir) -> DataFrame:
    """The row at position 7, and the store's size."""
    rows = store(spark, sf_dir)
    return R.without_vectors(R.get_chunk(rows, 7)).select("chunk_idx", "label", F.lit(R.size_of(rows)).cast("long").alias("store_size"))


def corpus_check(spark, sf_dir) -> DataFrame:
    """Every document with what is wrong with it, by name."""
    return D.corpus_issues(described(spark, sf_dir), "stem").select("stem", F.size("issues").alias("n_issues"), F.array_join("issues", "; ").alias("issues"))


def manifest_lines(spark, sf_dir) -> DataFrame:
    """The manifest as the rows of a Markdown table."""
    docs, _ = manifests(spark, sf_dir)
    return S.manifest_table(docs, ["doc_id", "title", "language"]).select(F.col("no").cast("long").alias("no"), "line")


def failing_questions(spark, sf_dir) -> DataFrame:
    """Questions that a text report, written and read again, calls failing; its figures are made of ids."""
    i = F.col("query_id")
    metrics = questions(spark, sf_dir).select("query_id", (i % 3 / 2).alias("recall_at_1"), (i % 5 / 4).alias("recall_at_5"))
    asked = questions(spark, sf_dir).select(F.col("query_id").cast("string").alias("query_id"), "query")
    return S.failing(S.parse_report(S.report_lines(metrics)), asked).select(F.col("query_id").cast("long").alias("query_id"), "recall_at_1", "recall_at_5", F.md5("query").alias("query"))


QUERIES = {f.__name__: f for f in (okapi_topk, front_matter_prefixed, front_matter_strict, audience_rows, chunk_at, corpus_check, manifest_lines, failing_questions)}

OKAPI = r"""
d_words AS (SELECT chunk_idx, regexp_extract_all(lower(content), '[\p{L}\p{N}_]+') AS w FROM d),
d_stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d_words),
tf AS (SELECT chunk_idx, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT chunk_idx, len(w) AS dl, unnest(w) AS term FROM d_words) GROUP BY chunk_idx, term),
rated AS (SELECT term, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf FROM tf CROSS JOIN d_stats GROUP BY term),
least_idf AS (SELECT avg(idf) * 0.25::DOUBLE AS least FROM rated),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS term FROM q) GROUP BY query_id, term),
sums AS (SELECT query_id, chunk_idx, sum(times * CASE WHEN idf < 0 THEN least ELSE idf END * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
    FROM qt JOIN rated USING (term) JOIN tf USING (term) CROSS JOIN d_stats CROSS JOIN least_idf GROUP BY query_id, chunk_idx),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_idx)::INTEGER AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM sums)
"""
AUDIENCE = "CASE WHEN label % 3 = 0 THEN 'student' WHEN label % 3 = 1 THEN 'all' END"
SPLIT = f"s AS (SELECT doc_id, lang, t, string_split(t, '---') AS parts FROM (SELECT doc_id, lang, {FRONT} AS t FROM documents))"
REST = "array_to_string(parts[3:], '---')"

SQL = {
    "okapi_topk": f"{with_(DOCS, ASKED, OKAPI)} SELECT query_id, rank, chunk_idx, round(score, 6) AS score FROM kept WHERE rank <= 20 AND (score > 0 OR best <= 0)",
    "front_matter_prefixed": f"""WITH {SPLIT}, h AS (SELECT *, starts_with(t, '---') AND len(parts) >= 3 AS has FROM s)
SELECT doc_id, CASE WHEN has THEN 'T: ' || doc_id END AS title, CASE WHEN has THEN 'true' END AS flag, CASE WHEN has THEN doc_id::VARCHAR END AS n, CASE WHEN has THEN lang END AS lang, CASE WHEN has THEN 5 ELSE 0 END AS n_keys, md5(CASE WHEN has THEN {sql_strip(REST)} ELSE t END) AS body FROM h""",
    "front_matter_strict": f"""WITH {SPLIT}, h AS (SELECT *, CASE WHEN NOT starts_with(t, '---') THEN 'front matter does not begin the file' WHEN len(parts) < 3 THEN 'front matter is not closed' END AS error FROM s)
SELECT doc_id, error, CASE WHEN error IS NULL THEN lang END AS lang, CASE WHEN error IS NULL THEN md5({REST}) END AS body FROM h""",
    "audience_rows": f"SELECT vec_id AS chunk_idx, label, {AUDIENCE} AS audience FROM embeddings WHERE {AUDIENCE} = 'student'",
    "chunk_at": "SELECT vec_id AS chunk_idx, label, (SELECT count(*) FROM embeddings) AS store_size FROM embeddings WHERE vec_id = 7",
    "corpus_check": f"WITH {META} SELECT stem, len({ISSUES})::INTEGER AS n_issues, array_to_string({ISSUES}, '; ') AS issues FROM m",
    "manifest_lines": f"WITH {TWO}, n AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS no FROM d) SELECT no, '| ' || no || ' | ' || doc_id || ' | ' || coalesce(title, '') || ' | ' || coalesce(language, '') || ' |' AS line FROM n UNION ALL SELECT -2, '| # | doc_id | title | language |' UNION ALL SELECT -1, '|---|---|---|---|'",
    "failing_questions": "SELECT item_id AS query_id, (item_id % 3) / 2.0::DOUBLE AS recall_at_1, (item_id % 5) / 4.0::DOUBLE AS recall_at_5, md5(text) AS query FROM benchmark WHERE item_id % 3 = 0 OR item_id % 5 = 0",
}
