import pytest
from pyspark.sql import functions as F

from docloom.operators import evaluation as E


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def ids(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def test_several_sources(spark):
    got, gold = ids("b", "x", "a", "a", "y"), ids("a", "b")
    assert value(spark, E.recall_at(got, gold, 1)) == 0.5 and value(spark, E.recall_at(got, gold, 5)) == 1.0
    assert value(spark, E.reciprocal_rank_at(got, gold)) == 1.0
    assert value(spark, E.ndcg_gold(got, gold)) == pytest.approx((1 + 1 / 2) / (1 + 1 / 1.5849625007211562))
    assert value(spark, E.recall_at(got, ids(), 5)) == 0.0 and value(spark, E.ndcg_gold(ids(), gold)) == 0.0


def test_one_source(spark):
    got = ids("x", "a", "a")
    assert value(spark, E.reciprocal_rank(got, F.lit("a"))) == 0.5 and value(spark, E.reciprocal_rank(got, F.lit("q"))) == 0.0
    assert value(spark, E.ndcg_retrieved(ids("a"), F.lit("a"), 5)) == 1.0 and value(spark, E.ndcg_retrieved(ids("x"), F.lit("a"), 5)) == 0.0
    assert value(spark, E.hit_at(got, F.lit("a"), 1)) is False


def test_evidence(spark):
    group = lambda name, *p: F.struct(F.lit(name).alias("id"), ids(*p).alias("phrases"))
    contents = ids("Alpha beta", "gamma")
    assert value(spark, E.evidence_covered(contents, F.array(group("1", "ALPHA"), group("2", "zz", "Gamma")))) == 1.0
    assert value(spark, E.evidence_covered(contents, F.array(group("1", "alpha"), group("2", "zz")))) == 0.0


def test_faithfulness(spark):
    none = F.lit(None).cast("array<struct<id: string, all_terms: array<string>>>")
    assert value(spark, E.faithfulness(F.lit("A b"), none, ids("a", "q"), F.lit(0.0))) == 0.5
    assert value(spark, E.faithfulness(F.lit(""), none, ids("a"), F.lit(1.0))) == 0.0
    assert value(spark, E.faithfulness(F.lit("x"), none, ids(), F.lit(0.0))) == 0.5 and value(spark, E.faithfulness(F.lit("x"), none, ids(), F.lit(1.0))) == 1.0


def test_audience(spark):
    assert value(spark, E.audience_match(ids("student", "all", "staff"), F.lit("student"))) == pytest.approx(2 / 3)
    assert value(spark, E.audience_match(ids(), F.lit("student"))) == 1.0


def test_rubric(spark):
    assert [value(spark, E.rubric(F.lit(r), F.lit(a))) for r, a in ((1, True), (1, False), (3, True), (4, True), (0, True))] == [2, 1, 1, 0, 0]


def test_empty_report(spark):
    df = spark.createDataFrame([], "query_id int, hit boolean")
    assert tuple(E.report(df, ["hit"]).first()) == (0, 0.0)


def test_holders(spark):
    """Texts inside one another, repeated, empty and null, in one part and in many."""
    docs = spark.createDataFrame([(1, "abcab é"), (2, ""), (3, None), (4, "xbcx ABC"), (5, "é")], "chunk_idx long, content string")
    asked = spark.createDataFrame([(1, "ab"), (2, "bc"), (3, "abcab"), (4, "ABC"), (5, ""), (6, None), (7, "é"), (8, "bc"), (9, "none")], "query_id int, query string")
    want = sorted((q.query_id, d.chunk_idx) for q in asked.collect() for d in docs.collect() if q.query is not None and d.content is not None and q.query in d.content)
    for most in (1 << 24, 100):
        assert sorted(map(tuple, E.holders(docs, asked, most).collect())) == want
    assert E.holders(docs, asked.limit(0)).count() == 0 and E.holders(docs.limit(0), asked).count() == 0
    assert "NestedLoop" not in E.holders(docs, asked)._jdf.queryExecution().executedPlan().toString()
