"""Tables as the plans read them, and SQL fragments that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks."""
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("chunk_idx"), F.col("text").alias("content"), "lang", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def ranked(df: DataFrame) -> DataFrame:
    """A ranking as the queries return it."""
    return df.select("query_id", F.col("rank").cast("int").alias("rank"), "chunk_idx", F.round("score", 6).alias("score"))


#: Keyword ranking of documents d (chunk_idx, content) for q (query_id, query): table bm25.
BM25 = r"""
d_words AS (SELECT chunk_idx, regexp_extract_all(lower(content), '[\p{L}\p{N}_]+') AS w FROM d),
d_stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d_words),
tf AS (SELECT chunk_idx, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT chunk_idx, len(w) AS dl, unnest(w) AS term FROM d_words) GROUP BY chunk_idx, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS term FROM q) GROUP BY query_id, term),
bm25_scores AS (SELECT query_id, chunk_idx, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
    FROM qt JOIN df USING (term) JOIN tf USING (term) CROSS JOIN d_stats GROUP BY query_id, chunk_idx),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_idx)::INTEGER AS rank FROM bm25_scores WHERE score > 0)
"""

#: Unit vectors v (kind, id, e) of the texts t (kind, id, text).
HASHED = r"""
states AS (
    WITH RECURSIVE s AS (
        SELECT kind, id, 0 AS n, ('0x' || substr(md5(text), 25, 8))::BIGINT AS state FROM t
        UNION ALL SELECT kind, id, n + 1, (state * 1664525 + 1013904223) % 4294967296 FROM s WHERE n < 64)
    SELECT kind, id, n, state::DOUBLE / 4294967295::DOUBLE * 2 - 1 AS x FROM s WHERE n > 0),
raw AS (SELECT kind, id, list(x ORDER BY n) AS e FROM states GROUP BY kind, id),
v AS (SELECT kind, id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM raw)
"""

#: Vector ranking of kind 'd' for kind 'q' of v: table dense.
DENSE = r"""
dense_scores AS (SELECT a.id AS query_id, b.id AS chunk_idx, list_inner_product(a.e, b.e) AS score FROM v a CROSS JOIN v b WHERE a.kind = 'q' AND b.kind = 'd'),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_idx)::INTEGER AS rank FROM dense_scores)
"""

#: Table fused of the first 20 of bm25 and dense.
FUSED = r"""
fused_scores AS (SELECT query_id, chunk_idx, sum(1.0::DOUBLE / (rank + 60)) AS score FROM (
    SELECT query_id, chunk_idx, rank FROM bm25 WHERE rank <= 20 UNION ALL SELECT query_id, chunk_idx, rank FROM dense WHERE rank <= 20) GROUP BY query_id, chunk_idx),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_idx)::INTEGER AS rank FROM fused_scores)
"""

DOCS = "d AS (SELECT doc_id AS chunk_idx, text AS content, lang, source FROM documents)"
ASKED = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
TEXTS = "t AS (SELECT 'd' AS kind, chunk_idx AS id, content AS text FROM d UNION ALL SELECT 'q', query_id, query FROM q)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)
