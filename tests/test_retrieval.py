import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import vectors as X
from docloom.operators import ranking as K
from docloom.operators import retrieval as R

DOCS = ["the cat sat on the mat", "a dog and a cat", "", "fish fish fish", "Điều 5 học phí", "the the the"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(DOCS)], "chunk_idx long, content string")


def bm25(query, docs=DOCS, k1=1.5, b=0.75):
    words = [d.lower().split() for d in docs]
    n, mean, out = len(docs), sum(map(len, words)) / len(docs), {}
    for i, w in enumerate(words):
        tf, score = Counter(w), 0.0
        for t in query.lower().split():
            df = sum(t in x for x in words)
            if tf[t]:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(w) / mean))
        if score > 0:
            out[i] = score
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))


def test_bm25(spark, chunks):
    asked = ["the cat", "the the cat", "fish", "nothing here", "", "HỌC phí"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = {}
    for r in R.bm25(chunks, queries).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_idx, r.score))
    for k, q in enumerate(asked):
        want = bm25(q)
        assert [i for i, _ in got.get(k, [])] == [i for i, _ in want]
        assert [s for _, s in got.get(k, [])] == pytest.approx([s for _, s in want])


def test_bm25_without_chunks(spark, chunks):
    queries = spark.createDataFrame([(1, "cat")], "query_id int, query string")
    assert R.bm25(chunks.limit(0), queries).count() == 0
    assert R.bm25(chunks, queries.limit(0)).count() == 0


def test_statistics_follow_the_filter(spark, chunks):
    docs = chunks.withColumn("lang", F.when(F.col("chunk_idx") < 3, "a").otherwise("b"))
    queries = spark.createDataFrame([(1, "the cat", "a"), (2, "the fish", "b")], "query_id int, query string, lang string")
    rows = R.filtered(docs, queries, F.create_map(F.lit("lang"), F.col("lang")), R.bm25).collect()
    assert sorted(round(r.score, 9) for r in rows if r.query_id == 1) == sorted(round(s, 9) for _, s in bm25("the cat", DOCS[:3]))
    assert {r.chunk_idx for r in rows if r.query_id == 2} == {3, 5}


def test_filters_in_one_pass_are_filters_one_by_one(spark, chunks):
    """Any number of filters, with lists, nulls, missing keys and none at all."""
    docs = chunks.withColumn("lang", F.when(F.col("chunk_idx") < 3, "a").when(F.col("chunk_idx") < 5, "b")).withColumn("tags", F.when(F.col("chunk_idx") % 2 == 0, F.array(F.lit("x"), F.lit("y"))))
    wanted = [{"lang": "a"}, {"lang": None}, {"tags": "x"}, {"lang": "b", "tags": "y"}, {"other": None}, {"other": "z"}, {}, None]
    queries = spark.createDataFrame([(k, "the cat fish học", f) for k, f in enumerate(wanted)], "query_id int, query string, f map<string,string>")
    shown = lambda df: sorted((r.query_id, r["rank"], r.chunk_idx, round(r.score, 9)) for r in df.collect())
    got = shown(R.bm25_filtered(docs, queries, F.col("f")))
    assert got == shown(R.filtered(docs, queries, F.col("f"), R.bm25)) and {r[0] for r in got} == {0, 1, 2, 3, 4, 6, 7}
    many = spark.range(40).select(F.col("id").alias("query_id"), F.lit("cat").alias("query"), F.create_map(F.lit("lang"), F.col("id").cast("string")).alias("f"))
    with pytest.raises(ValueError, match="filters"):
        R.filtered(docs, many, F.col("f"), R.bm25)
    assert R.bm25_filtered(docs, many, F.col("f")).count() == 0


def okapi(query, docs, k1=1.5, b=0.75, epsilon=0.25):
    words = [d.lower().split() for d in docs]
    n, mean = len(docs), sum(map(len, words)) / len(docs)
    df = Counter(t for w in words for t in set(w))
    idf = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    least = epsilon * sum(idf.values()) / len(idf)
    out = {}
    for i, w in enumerate(words):
        tf, terms = Counter(w), [t for t in query.lower().split() if t in w]
        if terms:
            out[i] = sum((least if idf[t] < 0 else idf[t]) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(w) / mean)) for t in terms)
    good = {i: s for i, s in out.items() if s > 0}
    return sorted((good or out).items(), key=lambda x: (-round(x[1], 9), x[0]))


def test_okapi(spark, chunks):
    """Classic weights, a floor for common words, and all that hold a word where no score is above 0."""
    common = ["a b", "a c", "a b c", "a"]
    for docs, asked in ((DOCS, ["the cat", "the the cat", "fish fish", "nothing", ""]), (common, ["a", "a b", "c b", "d"])):
        frame = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "chunk_idx long, content string")
        rows = R.okapi(frame, spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")).orderBy("query_id", "rank").collect()
        for k, q in enumerate(asked):
            want = okapi(q, docs)
            assert [r.chunk_idx for r in rows if r.query_id == k] == [i for i, _ in want]
            assert [r.score for r in rows if r.query_id == k] == pytest.approx([s for _, s in want])


def test_one_scan_for_all_statistics(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("chunk_idx"), F.col("text").alias("content"))
    df = R.bm25(docs, spark.createDataFrame([(1, "the and")], "query_id int, query string"))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("documents.parquet") == 1 and final.count("ReusedExchange") >= 2


def test_fusion_scores(spark):
    a, b = (spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(x)], "query_id int, chunk_idx long, rank int") for x in ([0, 1], [1, 2]))
    got = K.top_k(K.fuse([a, b], 60), 5).orderBy("rank").collect()
    assert [r.chunk_idx for r in got] == [1, 0, 2] and got[0].score == pytest.approx(1 / 61 + 1 / 62)
    assert K.fuse([a], 0).agg(F.max("score")).first()[0] == pytest.approx(1 / 61)


def test_dense_is_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v[7] = v[3]
    v[11] = 0
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_idx long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", v[i].tolist()) for i in range(0, 60, 3)], "query_id string, embedding array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    for block in (7, 4096):
        got = {}
        for r in R.dense(docs, asked, 4, block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_idx)
        for i in range(0, 60, 3):
            s = np.round(unit @ unit[i], 9)
            assert got[f"q{i}"] == sorted(range(300), key=lambda j: (-s[j], j))[:4]
    assert R.dense(docs, asked.limit(0)).count() == 0
    assert R.dense(docs.limit(0), asked).count() == 0


def test_odd_vectors(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [2.0]), (4, [0.0, 1.0, 9.0])], "chunk_idx long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.5]), (8, None)], "query_id int, embedding array<double>")
    assert [(r.query_id, r.chunk_idx, r.score) for r in R.dense(docs, asked, 5, normalized=False).orderBy("rank").collect()] == [(7, 3, 2.0), (7, 1, 1.0), (7, 4, 0.5)]


def test_hashed_embedding_and_cosine(spark):
    import hashlib

    def expected(text):
        s, out = int(hashlib.md5(text.encode()).hexdigest(), 16), []
        for _ in range(64):
            s = (s * 1664525 + 1013904223) % 2**32
            out.append(s / (2**32 - 1) * 2 - 1)
        return np.array(out) / np.linalg.norm(out)

    rows = R.embed(spark.createDataFrame([("a",), ("",), ("Điều 😀",)], "t string"), F.col("t")).collect()
    for r in rows:
        assert np.abs(np.array(r.embedding) - expected(r.t)).max() < 1e-12
    zero = spark.sql("SELECT array(0D, 0D) a, array(1D, 2D) b, array(2D, 4D, 9D) c")
    r = zero.select(X.cosine(F.col("a"), F.col("b")).alias("x"), X.dot(F.col("b"), F.col("c")).alias("y"), X.normalize(F.col("a")).alias("z")).first()
    assert (r.x, r.y, r.z) == (0.0, 10.0, [0.0, 0.0])


def test_a_model_is_called_in_batches(spark):
    rows = R.embed(spark.createDataFrame([("ab",), ("c",)], "t string"), F.col("t"), model=lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert sorted(r.embedding[0] for r in rows) == [1.0, 2.0]


def test_a_failing_model_falls_back(spark):
    def model(texts):
        if "bad" in texts:
            raise RuntimeError
        return [[1.0] * 64 for _ in texts]

    rows = {r.t: r.embedding for r in R.embed(spark.createDataFrame([("ok",), ("bad",)], "t string").coalesce(1), F.col("t"), model=model).collect()}
    assert rows["ok"] == [1.0] * 64 and rows["bad"] != rows["ok"] and abs(sum(x * x for x in rows["bad"]) - 1) < 1e-9


def test_models_are_tried_again(spark, tmp_path):
    """Three tries a batch, then one by one; equal texts are asked for once; too few vectors are a failure."""
    log = str(tmp_path / "calls")

    def model(texts):
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        if sum(1 for _ in open(log)) < 3:
            raise RuntimeError("busy")
        return [[float(len(t))] for t in texts]

    rows = R.embed(spark.createDataFrame([("ab",), ("c",), ("ab",)], "t string").coalesce(1), F.col("t"), model=model, wait=0.0).collect()
    assert [r.embedding for r in rows] == [[2.0], [1.0], [2.0]] and open(log).read().split() == ["2", "2", "2"]
    short = R.embed(spark.createDataFrame([("ab",), ("c",)], "t string").coalesce(1), F.col("t"), model=lambda texts: [[1.0]], wait=0.0).collect()
    assert [r.embedding for r in short] == [[1.0], [1.0]]  # right for one text, wrong for two


def test_the_cache_spares_the_model(spark, tmp_path):
    log = str(tmp_path / "asked")

    def model(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[float(len(t))] for t in texts]

    texts = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, "ccc"), (5, None)], "id int, t string")
    empty = spark.createDataFrame([], "text_hash string, embedding array<double>")
    first, new = R.embed_cached(texts.where("id < 3"), F.col("t"), empty, model=model)
    assert sorted((r.id, r.embedding) for r in first.collect()) == [(1, [2.0]), (2, [1.0])]
    again, more = R.embed_cached(texts, F.col("t"), new, model=model)
    assert sorted((r.id, r.embedding) for r in again.collect()) == [(1, [2.0]), (2, [1.0]), (3, [2.0]), (4, [3.0]), (5, None)]
    assert more.count() == 1 and sorted(open(log).read().split()) == ["aa", "b", "ccc"]


def test_a_failing_question_alone_keeps_its_order(spark):
    rows = [(q, i, s, n, f"q{q}", t) for q in (1, 2, 3) for n, (i, s, t) in enumerate([(5, 0.9, "short"), (6, 0.5, "much longer"), (7, 0.1, "mid text")], 1)]
    ranking = spark.createDataFrame(rows, "query_id int, chunk_idx long, score double, rank int, query string, content string").coalesce(1)

    def model(pairs):
        if pairs[0][0] == "q2":
            raise RuntimeError
        return [len(t) for _, t in pairs]

    got = {}
    for r in K.rerank(ranking, 2, K.model_score(model, batch=2)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_idx, r.rerank_score))
    assert got == {1: [(6, 11.0), (7, 8.0)], 2: [(5, 0.9), (6, 0.5)], 3: [(6, 11.0), (7, 8.0)]}


def test_questions_beyond_a_broadcast(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 4))
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_idx long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:50])], "query_id int, embedding array<double>")
    shown = lambda df: sorted((r.query_id, r["rank"], r.chunk_idx) for r in df.collect())
    assert shown(R.dense(docs, asked, 3, block=8, most_bytes=1000)) == shown(R.dense(docs, asked, 3))


def test_unavailable_models():
    assert R.available(None, {}) is None and R.available("a", {"a": lambda: 5}) == 5
    with pytest.warns(UserWarning):
        assert R.available("b", {}) is None


def test_reranking(spark):
    ranking = spark.createDataFrame([(1, 5, 0.9, 1, "q", "short"), (1, 6, None, 2, "q", "much longer"), (1, 7, 0.1, 3, "q", "mid text")], "query_id int, chunk_idx long, score double, rank int, query string, content string")
    order = lambda df: [r.chunk_idx for r in df.orderBy("rank").collect()]
    assert order(K.rerank(ranking, 2)) == [5, 6] and K.rerank(ranking, 2).where("rank = 2").first().rerank_score == 0.0
    assert order(K.rerank(ranking, 2, K.model_score(lambda pairs: [len(t) for _, t in pairs]))) == [6, 7]
    assert order(K.rerank(ranking, 3, K.model_score(lambda pairs: 1 / 0))) == [5, 6, 7]
    assert K.score_gap(ranking.fillna(0.5)).first().gap == pytest.approx(0.4)


def test_store(spark):
    store = spark.createDataFrame([("a", [1.0]), (None, [2.0])], "doc_id string, embedding array<double>")
    more = R.add_documents(store, store)
    assert R.size_of(more) == 4 and R.size_of(R.delete_document(more, "a")) == 2 and R.size_of(R.delete_document(more, None)) == 2
    assert R.without_vectors(store).columns == ["doc_id"]
    chunks = spark.createDataFrame([(0, "student"), (1, "all")], "chunk_idx long, audience string")
    assert R.get_chunk(chunks, 9).count() == 0 and [r.chunk_idx for r in R.filter_by_audience(chunks, "student").collect()] == [0]


def test_parents_keep_the_first_child(spark):
    ranking = spark.createDataFrame([(1, 10, "p", 1), (1, 11, "p", 2), (1, 12, "q", 3)], "query_id int, chunk_idx long, parent_id string, rank int")
    assert [(r.chunk_idx, r["rank"]) for r in K.first_per_parent(ranking, 5).orderBy("rank").collect()] == [(10, 1), (12, 2)]


def test_filters(spark):
    rows = spark.createDataFrame([(1, "a", ["x"]), (2, None, ["y", "x"]), (3, "b", None)], "id int, k string, tags array<string>")
    kept = lambda f: sorted(r.id for r in R.filter_chunks(rows, f).collect())
    assert kept({}) == [1, 2, 3] and kept({"k": "a"}) == [1] and kept({"k": None}) == [2] and kept({"k": ["a", "b"]}) == [1, 3]
    assert kept({"tags": "x"}) == [1, 2] and kept({"missing": None}) == [1, 2, 3] and kept({"missing": 1}) == []


def test_plans_prune_and_avoid_text_shuffles(spark):
    """Rankings are cut to k in each task, and no text crosses an exchange."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("chunk_idx"), F.col("text").alias("content"))
    queries = spark.createDataFrame([(1, "the and")], "query_id int, query string")
    plan = R.bm25(docs, queries)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    for line in plan.splitlines():
        assert "Exchange hashpartitioning(content" not in line


def test_keyword_search_sorts_narrow_rows_in_parts_of_one_size(spark, monkeypatch):
    """What a task sorts has no lists of questions, and more files make more parts, not larger ones."""
    from docloom import storage

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("chunk_idx"), F.col("text").alias("content"))
    asked = spark.createDataFrame([(k, "the and of") for k in range(30)], "query_id int, query string")
    want = [(r.query_id, r["rank"], r.chunk_idx, round(r.score, 9)) for r in R.bm25(docs, asked, 3).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(storage, "size_of", lambda df: 40 << 23)
    df = R.bm25(docs, asked, 3)
    assert [(r.query_id, r["rank"], r.chunk_idx, round(r.score, 9)) for r in df.orderBy("query_id", "rank").collect()] == want
    plan = df._jdf.queryExecution()
    lines = plan.executedPlan().toString().split("Initial Plan")[-1].splitlines()
    sort, join = (next(k for k, x in enumerate(lines) if part in x) for part in (" Sort [chunk_idx", " BroadcastHashJoin [term"))
    assert join < sort and "asked" not in lines[sort]
    assert "40, REPARTITION_BY_NUM" in plan.optimizedPlan().toString() or "hashpartitioning(chunk_idx" in plan.executedPlan().toString() and ", 40)" in plan.executedPlan().toString()


#: Registered queries that search by keywords.
SEARCHES = "multi_query_topk filter_comparison bm25_topk citation_text evidence_quality extractive_answer hybrid_topk parent_search rag_prompt rerank_passthrough rerank_scored retrieval_metrics".split()


@pytest.mark.parametrize("name", SEARCHES)
def test_queries_that_search_by_keywords_sort_before_they_widen(spark, monkeypatch, name):
    """Below what adds up a chunk's scores, the questions' weights are joined above the sort, and the parts are as many as the files ask for."""
    from docloom import storage
    from docloom.plans import catalog

    monkeypatch.setattr(storage, "size_of", lambda df: 40 << 23)
    lines = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    tops = [k for k, x in enumerate(lines) if "MapInArrow" in x and "asked#" in x]
    assert len(tops) >= (2 if name == "filter_comparison" else 1)
    for top in tops:
        assert "BroadcastHashJoin [term" in next(x for x in lines[top:] if " Sort [chunk_idx" in x or "BroadcastHashJoin [term" in x)
        assert ", 40), REPARTITION_BY_NUM" in next(x for x in lines[top:] if "Exchange hashpartitioning(chunk_idx" in x)


def test_frequencies_of_all_terms(spark):
    """Each chunk of one row gives a word once; rows of one id and length are one chunk, as in the statistics of keyword search."""
    rows = [(1, "a a b"), (2, "b c"), (3, None), (4, "a b"), (4, "a c"), (4, "a d e"), (None, "a"), (None, "f"), (5, "")]
    docs = spark.createDataFrame(rows, "chunk_idx long, content string")
    shown = lambda df: sorted((r.term, r.df) for r in df.collect())
    for some in (docs, docs.where("chunk_idx < 4"), docs.limit(0)):
        want = R.statistics(R.counted_terms(some))[1].where(F.col("term") != R.WHOLE)
        assert shown(R.all_frequencies(some)) == shown(want)


def test_okapi_deals_only_the_terms_of_questions(spark):
    """No exchange has a row for each word of each chunk: what is dealt by chunk was asked for, all else is added up by term."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("chunk_idx"), F.col("text").alias("content"))
    df = R.okapi(docs, spark.createDataFrame([(1, "the and")], "query_id int, query string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_idx" in plan and "chunk_len" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def test_a_task_deals_out_a_word_of_a_chunk_once(spark):
    """What crosses the exchange by chunk is a row a chunk and word with their number, not one an occurrence; rows of one id are one chunk, and null ids stay."""
    rows = [(1, "a a b a " * 500), (1, "a a b a " * 500), (2, "b c c"), (None, "c a c"), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "chunk_idx long, content string").coalesce(1)
    df = R.counted_terms(docs, F.broadcast(spark.createDataFrame([("a",), ("c",), (R.WHOLE,)], "term string")))
    got = {(r.chunk_idx, r.chunk_len, r.term): r.tf for r in df.collect()}
    assert got == {(1, 2000, "a"): 3000, (1, 2000, ""): 2, (2, 3, "c"): 2, (2, 3, ""): 1, (None, 3, "c"): 2, (None, 3, "a"): 1, (None, 3, ""): 1, (3, 0, ""): 1, (4, 0, ""): 1}
    plan = df._jdf.queryExecution().executedPlan()
    while not plan.nodeName().endswith("Exchange") or "hashpartitioning(chunk_idx" not in plan.toString().splitlines()[0]:
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in plan.nodeName() else plan.children().apply(0)
    assert plan.metrics().apply("shuffleRecordsWritten").value() == len(got)  # of 3,011 occurrences, in one batch
