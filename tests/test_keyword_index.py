"""The kept keyword index against the search that reads all texts."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import retrieval as R
from docloom.operators.keyword_index import KeywordIndex


def shown(df):
    return sorted((r.query_id, r["rank"], r.chunk_idx, round(r.score, 7)) for r in df.collect())


def texts(spark, n, seed=1, start=0):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    rows = [(start + k, " ".join(rng.choices(words, k=rng.choice([0, 3, 20, 60, 200])))) for k in range(n)]
    return spark.createDataFrame(rows, "chunk_idx long, content string").repartition(3)


@pytest.mark.parametrize("window", [4, 64])
def test_as_bm25(spark, tmp_path, window):
    """Added by batch; questions with rare and common words, repeated words, none known, and none at all."""
    index = KeywordIndex(spark, str(tmp_path / "index"), window=window)
    parts = [texts(spark, 300), texts(spark, 200, 2, 1000), texts(spark, 1, 3, 5000).limit(0)]
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w1 w17 w17 w250"), (3, "w999999"), (4, ""), (5, None), (6, "w1"), (7, "w5 w8 w13 w21 w34 w55 w89")], "query_id long, query string")
    assert index.search(asked, 5).count() == 0
    for n in (1, 2, 3):
        index.add(parts[n - 1])
        whole = parts[0] if n == 1 else parts[0].union(parts[1])
        for k in (1, 7, 1000):
            assert shown(index.search(asked, k)) == shown(R.bm25(whole, asked, k))


def test_folders_and_windows_are_left_unread(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "index"), window=16)
    docs = texts(spark, 2000).union(spark.createDataFrame([(9000 + k, f"needle{k % 3} w1 w2") for k in range(30)], "chunk_idx long, content string"))
    index.add(docs)
    asked = spark.createDataFrame([(k, f"needle{k} w1 w2 w3") for k in range(3)], "query_id long, query string")
    shares = index.shares(asked, 5)
    assert 0 < shares["scored"] < 0.5 * shares["postings"]
    assert shown(index.search(asked, 5)) == shown(R.bm25(docs, asked, 5))
    plan = index.blocks(asked.select(F.lit("w1").alias("term")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_a_search_shuffles_blocks_and_not_a_row_a_window_term_and_question(spark, tmp_path):
    """Ten times the questions of the same words: what the plan keeps grows with blocks and questions, not with their product."""
    index = KeywordIndex(spark, str(tmp_path / "index"), window=16)
    index.add(texts(spark, 400))
    asked = spark.range(120).selectExpr("id AS query_id", "concat('w1 w2 w3 w', id % 7) AS query")
    plan = index.plan(R.query_terms(asked), 3)
    kept = {name: df.count() for name, df in plan.items() if hasattr(df, "count") and hasattr(df, "schema") and name != "blocks"}
    assert max(kept.values()) <= max(plan["heads"].count(), 120 * 4)
    assert shown(index.search(asked, 3)) == shown(R.bm25(texts(spark, 400), asked, 3))


def test_equal_scores_go_to_the_smaller_id_wherever_it_lies(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "index"), window=2)
    docs = spark.range(60).selectExpr("59 - id AS chunk_idx", "concat('same words here ', repeat('x ', CAST(id % 3 AS int))) AS content")
    index.add(docs)
    asked = spark.createDataFrame([(1, "same words"), (2, "here x")], "query_id long, query string")
    for k in (1, 5, 40):
        assert shown(index.search(asked, k)) == shown(R.bm25(docs, asked, k))


def test_questions_that_are_not_few_take_turns(spark, tmp_path, monkeypatch):
    index, docs = KeywordIndex(spark, str(tmp_path / "index"), window=8), texts(spark, 100)
    index.add(docs)
    asked = spark.createDataFrame([(k, f"w1 w{k + 2}") for k in range(6)], "query_id long, query string")
    whole = shown(R.bm25(docs, asked, 4))
    monkeypatch.setattr(R, "FEW", 5)
    assert shown(index.search(asked, 4)) == whole
