"""Retrieval and its quality: documents answer the benchmark's items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as X
from ..operators import evaluation as E
from ..operators import ranking as K
from ..operators import retrieval as R
from .common import ASKED, BM25, DENSE, DOCS, FUSED, HASHED, TEXTS, chunks, questions, ranked, table, with_


def term_stats(spark, sf_dir) -> DataFrame:
    tf = R.term_frequencies(chunks(spark, sf_dir))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most"))


def term_idf(spark, sf_dir) -> DataFrame:
    docs = chunks(spark, sf_dir)
    of_all, df = R.statistics(R.counted_terms(docs))
    df = df.where(F.col("term") != R.WHOLE).crossJoin(F.broadcast(of_all))
    return df.select("term", "df", F.round(R.idf(F.col("n_chunks"), F.col("df")), 6).alias("idf"), F.round("avg_len", 6).alias("avg_len"))


def bm25_topk(spark, sf_dir) -> DataFrame:
    return ranked(R.bm25(chunks(spark, sf_dir), questions(spark, sf_dir)))


def bm25_filtered_topk(spark, sf_dir) -> DataFrame:
    asked = questions(spark, sf_dir)
    lang = F.when(F.col("query_id") % 3 == 0, "en").when(F.col("query_id") % 3 == 1, "fr").otherwise("de")
    return ranked(R.bm25_filtered(chunks(spark, sf_dir), asked, F.create_map(F.lit("lang"), lang)))


def hashed_embedding(spark, sf_dir) -> DataFrame:
    e = R.embed(chunks(spark, sf_dir), F.col("content"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return e.select("chunk_idx", *[F.round(c, 9).alias(n) for n, c in (("first", F.col("embedding")[0]), ("last", F.col("embedding")[63]), ("total", total), ("length", X.norm(F.col("embedding"))))])


def text_vectors(spark, sf_dir) -> DataFrame:
    return R.embed(chunks(spark, sf_dir), F.col("content")).select("chunk_idx", "embedding")


def dense_topk(spark, sf_dir) -> DataFrame:
    return ranked(R.dense(text_vectors(spark, sf_dir), R.embedded_queries(questions(spark, sf_dir))))


def hyb(spark, sf_dir, k=10) -> DataFrame:
    return R.hybrid(chunks(spark, sf_dir), text_vectors(spark, sf_dir), questions(spark, sf_dir), k)


def hybrid_topk(spark, sf_dir) -> DataFrame:
    return ranked(hyb(spark, sf_dir))


def rrf_fuse(spark, sf_dir) -> DataFrame:
    """Two made-up rankings of all embeddings of a label, one by id, one by the id's remainder: whole lists are fused."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("query_id"), F.col("vec_id").alias("chunk_idx"))
    orders = ["chunk_idx"], [F.desc(F.col("chunk_idx") % 37), "chunk_idx"]
    up, down = (rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*o))) for o in orders)
    return ranked(K.top_k(K.fuse([up, down], 60), 20))


def vector_search(spark, sf_dir) -> DataFrame:
    """Raw inner products for every vector whose id is divisible by 20, as the plain store ranks."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ranked(R.dense(v.select(F.col("vec_id").alias("chunk_idx"), "embedding"), asked, k=5, normalized=False))


def vector_search_filtered(spark, sf_dir) -> DataFrame:
    """As vector_search over vectors of label 3 only: the filter comes before the ranking."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    kept = R.filter_chunks(v, {"label": 3}).select(F.col("vec_id").alias("chunk_idx"), "embedding")
    return ranked(R.dense(kept, asked, k=3, normalized=False))


def cosine_pairs(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return v.join(after, "vec_id").select("vec_id", F.round(X.cosine(F.col("e"), F.col("f")), 6).alias("cosine"), F.round(X.dot(F.col("e"), F.col("f")), 6).alias("dot"))


def parent_search(spark, sf_dir) -> DataFrame:
    """Hybrid search, documents as children of their sources."""
    docs = chunks(spark, sf_dir).withColumnRenamed("source", "parent_id")
    found = R.parents(docs, text_vectors(spark, sf_dir), questions(spark, sf_dir))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "parent_id", "chunk_idx", F.round("score", 6).alias("score"))


def gold(spark, sf_dir) -> DataFrame:
    """(query_id, gold): the documents that hold the item's text, if any."""
    asked, docs = questions(spark, sf_dir), chunks(spark, sf_dir)
    held = E.holders(docs, asked).groupBy("query_id").agg(F.sort_array(F.collect_set("chunk_idx")).alias("gold"))
    return asked.select("query_id").join(held, "query_id", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<bigint>")))


def judged(spark, sf_dir) -> DataFrame:
    found = E.collected(hyb(spark, sf_dir), "chunk_idx", "retrieved")
    return gold(spark, sf_dir).join(found, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<bigint>")))


def retrieval_metrics(spark, sf_dir) -> DataFrame:
    r, g, one = F.col("retrieved"), F.col("gold"), F.try_element_at("gold", F.lit(1))
    named = {
        "hit_1": F.coalesce(E.hit_at(r, one, 1), F.lit(False)).cast("int"), "hit_5": F.coalesce(E.hit_at(r, one, 5), F.lit(False)).cast("int"), "rr": F.coalesce(E.reciprocal_rank(r, one), F.lit(0.0)), "ndcg_retrieved_5": E.ndcg_retrieved(r, one, 5),
        "recall_1": E.recall_at(r, g, 1), "recall_5": E.recall_at(r, g, 5), "gold_recall_5": E.gold_recall_at(r, g, 5), "rr_5": E.reciprocal_rank_at(r, g), "ndcg_gold_5": E.ndcg_gold(r, g),
    }
    return judged(spark, sf_dir).select("query_id", *[(c if n.startswith("hit") else F.round(c, 6)).alias(n) for n, c in named.items()])


def retrieval_report(spark, sf_dir) -> DataFrame:
    """Means over questions that have a document and over those that don't."""
    m = retrieval_metrics(spark, sf_dir).join(gold(spark, sf_dir), "query_id").withColumn("strategy", F.when(F.size("gold") > 0, "answerable").otherwise("unanswerable"))
    return E.report(m, ["hit_1", "hit_5", "rr", "recall_5", "ndcg_gold_5"], by="strategy")


QUERIES = {f.__name__: f for f in (hybrid_topk, term_stats, term_idf, bm25_topk, bm25_filtered_topk, hashed_embedding, dense_topk, rrf_fuse, vector_search, vector_search_filtered, cosine_pairs, parent_search, retrieval_metrics, retrieval_report)}

WORDS = r"w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term)"
TAIL = "SELECT query_id, rank, chunk_idx, round(score, 6) AS score FROM"
GOLD = "gold AS (SELECT q.query_id, coalesce(list(chunk_idx ORDER BY chunk_idx) FILTER (WHERE chunk_idx IS NOT NULL), []) AS gold FROM q LEFT JOIN d ON contains(d.content, q.query) GROUP BY q.query_id)"
JUDGED = """places AS (SELECT g.query_id, g.gold, f.rank, f.chunk_idx, list_contains(g.gold, f.chunk_idx) AS good, f.chunk_idx = g.gold[1] AS one FROM gold g LEFT JOIN (SELECT * FROM fused WHERE rank <= 10) f ON f.query_id = g.query_id),
sums AS (SELECT query_id, any_value(gold) AS gold, count(*) FILTER (WHERE one AND rank = 1) AS hit_1, count(*) FILTER (WHERE one AND rank <= 5) AS hit_5, min(rank) FILTER (WHERE one) AS one_rank,
    count(*) FILTER (WHERE good AND rank = 1) AS good_1, count(*) FILTER (WHERE good AND rank <= 5) AS good_5, min(rank) FILTER (WHERE good AND rank <= 5) AS good_rank,
    coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE one AND rank <= 5), 0) AS one_dcg, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE good AND rank <= 5), 0) AS good_dcg FROM places GROUP BY query_id),
ideal AS (SELECT query_id, coalesce((SELECT sum(1 / log2(i + 1)) FROM unnest(range(1, 6)) AS u(i) WHERE i <= len(gold)), 0) AS best FROM sums),
metrics AS (SELECT sums.query_id, gold, hit_1::INTEGER AS hit_1, hit_5::INTEGER AS hit_5, coalesce(round(1.0::DOUBLE / one_rank, 6), 0) AS rr, CASE WHEN hit_5 > 0 THEN round(one_dcg, 6) ELSE 0 END AS ndcg_retrieved_5,
    CASE WHEN len(gold) > 0 THEN round(good_1::DOUBLE / len(gold), 6) ELSE 0 END AS recall_1, CASE WHEN len(gold) > 0 THEN round(good_5::DOUBLE / len(gold), 6) ELSE 0 END AS recall_5,
    CASE WHEN len(gold) > 0 THEN round(good_5::DOUBLE / len(gold), 6) ELSE 0 END AS gold_recall_5, coalesce(round(1.0::DOUBLE / good_rank, 6), 0) AS rr_5, CASE WHEN best > 0 THEN round(good_dcg / best, 6) ELSE 0 END AS ndcg_gold_5
    FROM sums JOIN ideal USING (query_id))"""
HYBRID = with_(DOCS, ASKED, TEXTS, BM25, HASHED, DENSE, FUSED)
SEARCH = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_idx, list_inner_product(a.e, b.e) AS score FROM e a CROSS JOIN e b WHERE a.vec_id % 20 = 0{}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_idx)::INTEGER AS rank FROM s) SELECT query_id, rank, chunk_idx, round(score, 6) AS score FROM r WHERE rank <= {}"""

SQL = {
    "term_stats": f"WITH {WORDS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences, max(tf) AS most FROM c GROUP BY term",
    "term_idf": rf"""WITH {WORDS}, s AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) AS avg_len FROM documents)
SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf, round(avg_len, 6) AS avg_len FROM (SELECT term, count(*) AS df FROM c GROUP BY term) CROSS JOIN s""",
    "bm25_topk": f"{with_(DOCS, ASKED, BM25)} {TAIL} bm25 WHERE rank <= 20",
    "bm25_filtered_topk": " UNION ALL ".join(
        f"({with_(f'd AS (SELECT doc_id AS chunk_idx, text AS content FROM documents WHERE lang = {lang!r})', f'q AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 3 = {k})', BM25)} {TAIL} bm25 WHERE rank <= 20)" for k, lang in enumerate(("en", "fr", "de"))
    ),
    "hashed_embedding": f"WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents), {HASHED.strip()} SELECT id AS chunk_idx, round(e[1], 9) AS first, round(e[64], 9) AS last, round(list_sum(e), 9) AS total, round(sqrt(list_inner_product(e, e)), 9) AS length FROM v",
    "dense_topk": f"{with_(DOCS, ASKED, TEXTS, HASHED, DENSE)} {TAIL} dense WHERE rank <= 20",
    "hybrid_topk": f"{HYBRID} {TAIL} fused WHERE rank <= 10",
    "rrf_fuse": """WITH a AS (SELECT label::BIGINT AS query_id, vec_id AS chunk_idx, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS up, row_number() OVER (PARTITION BY label ORDER BY vec_id % 37 DESC, vec_id) AS down FROM embeddings),
u AS (SELECT query_id, chunk_idx, up AS rank FROM a UNION ALL SELECT query_id, chunk_idx, down FROM a), f AS (SELECT query_id, chunk_idx, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u GROUP BY query_id, chunk_idx),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_idx)::INTEGER AS rank FROM f) SELECT query_id, rank, chunk_idx, round(score, 6) AS score FROM r WHERE rank <= 20""",
    "vector_search": SEARCH.format("", 5),
    "vector_search_filtered": SEARCH.format(" AND b.label = 3", 3),
    "cosine_pairs": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id, round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)), 6) AS cosine, round(list_inner_product(a.e, b.e), 6) AS dot FROM e a JOIN e b ON b.vec_id = a.vec_id + 1",
    "parent_search": f"""{with_(DOCS, ASKED, TEXTS, BM25, HASHED, DENSE, FUSED)}, p AS (SELECT f.*, d.source AS parent_id, row_number() OVER (PARTITION BY query_id, d.source ORDER BY f.rank) AS place FROM (SELECT * FROM fused WHERE rank <= 20) f JOIN d USING (chunk_idx)),
k AS (SELECT query_id, parent_id, chunk_idx, score, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank FROM p WHERE place = 1) SELECT query_id, rank, parent_id, chunk_idx, round(score, 6) AS score FROM k WHERE rank <= 5""",
    "retrieval_metrics": f"{HYBRID}, {GOLD}, {JUDGED} SELECT * EXCLUDE (gold) FROM metrics",
    "retrieval_report": f"""{HYBRID}, {GOLD}, {JUDGED} SELECT CASE WHEN len(gold) > 0 THEN 'answerable' ELSE 'unanswerable' END AS strategy, count(*) AS n_queries, round(avg(hit_1), 6) AS hit_1, round(avg(hit_5), 6) AS hit_5, round(avg(rr), 6) AS rr,
round(avg(recall_5), 6) AS recall_5, round(avg(ndcg_gold_5), 6) AS ndcg_gold_5 FROM metrics GROUP BY 1""",
}
