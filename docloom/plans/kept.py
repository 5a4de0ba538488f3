"""What is kept between jobs: a store that is changed by commits, indexes, the embedding cache, and a folder of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators.keyword_index import KeywordIndex
from ..operators.vector_index import VectorIndex
from ..sources import files as S
from ..sources.store import MARK, Store
from ..storage import fresh_dir
from .common import ASKED, BM25, DOCS, HASHED, chunks, questions, ranked, table, with_
from .documents import sql_strip
from .retrieval import SEARCH, TAIL


def store_commits(spark, sf_dir) -> DataFrame:
    """Documents are added, every fifth is replaced, every seventh deleted, every 35th added again, and all is compacted; what each language is left with."""
    store = Store(spark, fresh_dir(spark, "store"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    store.add(docs)
    store.replace(docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("new "), "text")).withColumn(MARK, F.col("doc_id") % 10 == 0))
    store.delete(docs.where("doc_id % 7 = 0"))
    store.compact()
    store.add(docs.where("doc_id % 35 = 0").withColumn("text", F.lit("back")))
    rows = store.read()
    return rows.groupBy("lang").agg(F.count("*").alias("rows"), F.sum("doc_id").alias("ids"), F.sum(F.length("text")).alias("chars"))


def keyword_index_topk(spark, sf_dir) -> DataFrame:
    """Keyword search in an index that two batches of documents were added to."""
    index, docs = KeywordIndex(spark, fresh_dir(spark, "index")), chunks(spark, sf_dir)
    index.add(docs.where("chunk_idx % 3 = 0"))
    index.add(docs.where("chunk_idx % 3 <> 0"))
    return ranked(index.search(questions(spark, sf_dir), 20))


def vector_index_topk(spark, sf_dir) -> DataFrame:
    """As vector_search, in an index that two batches of vectors were added to."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_idx"), "embedding")
    index = VectorIndex(spark, fresh_dir(spark, "index"), normalized=False)
    index.add(v.where("chunk_idx % 2 = 0"))
    index.add(v.where("chunk_idx % 2 = 1"))
    return ranked(index.search(v.where("chunk_idx % 20 = 0").select(F.col("chunk_idx").alias("query_id"), "embedding"), 5))


def cached_embeddings(spark, sf_dir) -> DataFrame:
    """Vectors of all documents, of which those of even ids were in the cache before, by one more of each batch."""
    cache, docs = S.EmbeddingCache(spark, fresh_dir(spark, "cache"), digits=1), table(spark, sf_dir, "documents").select("doc_id", "text")
    for part in ("doc_id % 4 = 0", "doc_id % 2 = 0"):
        known, new = R.embed_cached(docs.where(part), F.col("text"), cache.of(docs.where(part)))
        cache.extend(new)
    cache.compact()
    known, new = R.embed_cached(docs, F.col("text"), cache.of(docs))
    cache.extend(new)
    return known.join(cache.store.read().select("text_hash", F.lit(1).alias("held")), F.sha2("text", 256) == F.col("text_hash"), "left").select("doc_id", F.round(F.col("embedding")[0], 9).alias("first"), F.coalesce("held", F.lit(0)).alias("held"))


def corpus_written(spark, sf_dir) -> DataFrame:
    """Documents as Markdown files, read back as a corpus."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in ("doc_id", "lang")])
    at = fresh_dir(spark, "corpus")
    S.write_documents(docs.withColumn("markdown", S.markdown_document(entries, F.col("doc_id"), T.strip(F.col("text")))), at)
    back = S.read_corpus(spark, at)
    return back.select("doc_id", F.try_element_at("metadata", F.lit("lang")).alias("lang"), F.length("body").alias("chars"), F.md5("body").alias("body"))


QUERIES = {f.__name__: f for f in (store_commits, keyword_index_topk, vector_index_topk, cached_embeddings, corpus_written)}

SQL = {
    "store_commits": """WITH a AS (SELECT doc_id, lang, text FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 UNION ALL SELECT doc_id, lang, 'new ' || text FROM documents WHERE doc_id % 10 = 5 AND doc_id % 7 <> 0 UNION ALL SELECT doc_id, lang, 'back' FROM documents WHERE doc_id % 35 = 0)
SELECT lang, count(*) AS rows, sum(doc_id)::BIGINT AS ids, sum(length(text))::BIGINT AS chars FROM a GROUP BY lang""",
    "keyword_index_topk": f"{with_(DOCS, ASKED, BM25)} {TAIL} bm25 WHERE rank <= 20",
    "vector_index_topk": SEARCH.format("", 5),
    "cached_embeddings": f"WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents), {HASHED.strip()} SELECT id AS doc_id, round(e[1], 9) AS first, 1 AS held FROM v",
    "corpus_written": f"SELECT doc_id::VARCHAR AS doc_id, lang, length(body)::INTEGER AS chars, md5(body) AS body FROM (SELECT doc_id, lang, '# ' || doc_id || chr(10) || chr(10) || {sql_strip('text')} || chr(10) AS body FROM documents)",
}
