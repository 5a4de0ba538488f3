from pyspark.sql import functions as F

from docloom.operators import answers as A
from docloom.operators import questions as Q
from docloom.operators import validation as D


def one(spark, c, text):
    return spark.createDataFrame([(text,)], "t string").select(c(F.col("t")).alias("x")).first().x


def test_kinds(spark):
    asked = {"Học phí bao nhiêu": "FACTUAL", "cách đăng ký học phần": "PROCEDURAL", "học phí và học bổng là gì": "MULTI_HOP", "so sánh học bổng": "GLOBAL", "fpt ok": "AMBIGUOUS", "weather tomorrow": "OUT_OF_SCOPE", "abc": "AMBIGUOUS"}
    rows = Q.analyze(spark.createDataFrame([(q,) for q in asked], "query string")).collect()
    assert {r.query: r.query_type for r in rows} == asked
    out = next(r for r in rows if r.query_type == "OUT_OF_SCOPE")
    assert (out.confidence, out.filters, out.topics, out.rewritten) == (0.3, {}, [], [])


def test_rewriting_is_in_turn(spark):
    assert one(spark, Q.rewrite, "thi trượt rồi") == "Thi không đạt rồi"
    assert one(spark, Q.enrich, "học phí mức thu") == "học phí mức thu (đóng tiền)"
    assert one(spark, Q.rewrite, "") == "" and one(spark, Q.search_variants, "  ") == []


def test_decomposition(spark):
    assert one(spark, Q.decompose, "Nếu trượt môn học thì đăng ký thi lại") == ["Trượt môn học?", "Đăng ký thi lại?"]
    assert one(spark, Q.decompose, "ngắn và dài") == ["ngắn và dài"]
    assert one(spark, Q.should_decompose, "học phí và học bổng") is True and one(spark, Q.should_decompose, "vàng học phí học bổng") is False
    df = spark.createDataFrame([(1, "điều kiện học bổng và thủ tục bảo lưu")], "query_id int, query string")
    assert [r.part for r in Q.sub_queries(df).collect()] == [1, 2]


def test_models_go_first(spark):
    lines = F.array(F.lit("the first sub question"), F.lit("the second sub question"), F.lit("short"))
    assert one(spark, lambda q: Q.decompose(q, lines), "abc") == ["the first sub question", "the second sub question"]
    assert one(spark, lambda q: Q.decompose(q, F.array(F.lit("short"))), "abc") == ["abc"]
    assert one(spark, lambda q: Q.passage(q, lambda c: F.concat(F.lit("P "), c)), "abc") == "P abc" and one(spark, lambda q: Q.passage(q, lambda c: F.lit(" ")), "ojt?").startswith("Căn cứ")
    assert one(spark, lambda q: Q.rewritten_variants(q, 3, F.array(F.lit("m"), F.lit("abc"))), "abc") == ["abc", "Abc", "Quy định Đại học FPT: abc", "m"]
    assert one(spark, lambda q: Q.search_variants(q, F.array(F.lit("x"), F.lit("ABC "))), "abc") == ["abc", "x"]
    assert one(spark, lambda q: Q.rewrite(q, lambda c: F.lit("given")), "abc") == "given"


def test_answers_without_contexts(spark):
    df = spark.sql("SELECT 1 query_id, 'q' query, cast(array() as array<struct<doc_id: string, content: string>>) contexts")
    made = A.generate(df, ["doc_id", "content"]).first()
    assert made.answer == A.V.NOT_FOUND and A.V.NO_ANSWER in made.prompt and made.citations == []


def test_a_model_answers(spark):
    df = spark.sql("SELECT 1 query_id, 'q' query, array(struct('d' doc_id, 'text' content)) contexts")
    made = A.generate(df, ["doc_id", "content"], llm=lambda p: F.concat(F.lit("said "), F.length(p).cast("string"))).first()
    assert made.answer.startswith("said ") and made.answer.endswith("[1] d")


def test_first_sentence_wins_ties(spark):
    df = spark.sql("SELECT 1 query_id, 'alpha beta' query, array(struct('d' doc_id, 'Nothing to see here. Alpha is in this one. Beta alpha both are here.' content)) contexts")
    body = A.extractive(df).first().answer.split("\n\n", 1)[1]
    assert body == "- Beta alpha both are here.\n\n- Alpha is in this one.\n\n- Nothing to see here."


def test_retries_are_bounded(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, query string")
    seen = []

    def search(part, overrides):
        seen.append(overrides)
        return part.withColumn("n", F.lit(1 if overrides else 0))

    def judge(rows):
        good = (F.col("query_id") == 1) | (F.col("n") > 0)
        return rows.select("*", (~good).alias("should_abstain"), F.lit(0.0).alias("result_count"), F.lit(0.0).alias("top_score"), F.lit(0.0).alias("evidence_support"))

    rows = A.corrected(queries, search, judge, max_retries=1).collect()
    assert sorted((r.query_id, r.n) for r in rows) == [(1, 0), (2, 1)] and {"use_metadata_filter": False, "top_k_multiplier": 2} in seen


def test_manifest_rules(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, title string")
    manifest = spark.createDataFrame([("a", "x "), ("c", "z"), ("a", "q"), (None, "n")], "doc_id string, title string")
    assert sorted(tuple(r) for r in D.reconcile(docs, manifest).collect()) == [("a", "duplicate"), ("b", "missing_in_manifest"), ("c", "extra_in_manifest")]
    assert [tuple(r) for r in D.mismatches(docs, manifest).collect()] == [("a", "title", "q", "x")]
    assert "campus" in D.missing_columns(manifest)


def test_no_metadata(spark):
    df = spark.sql("SELECT cast(null as map<string,string>) m, cast(null as string) b, 's' s")
    assert len(df.select(D.issues(F.col("m"), F.col("b")).alias("x")).first().x) == 6
    log = D.check_log(df, "s", "m", "b").collect()
    assert [(r.check_name, r.passed) for r in log] == [("Encoding", True), ("Frontmatter Syntax", False)]


def test_models_that_fail(spark):
    """Questions fall back on their own rules, answers tell what went wrong."""

    def model(text):
        if "bad" in text:
            raise RuntimeError("no quota")
        return " The first sub question \nshort\nThe second sub question\nThe third sub question "

    lines = Q.asked(model, "Split: {}", lines=True)
    assert one(spark, lambda q: Q.decompose(q, lines(q)), "fine") == ["The first sub question", "The second sub question", "The third sub question"]
    assert one(spark, lambda q: Q.decompose(q, lines(q)), "Nếu bad trượt môn thì đăng ký thi lại") == ["Bad trượt môn?", "Đăng ký thi lại?"]
    assert one(spark, Q.asked(model, lines=True, most=2), "x") == ["The first sub question", "The second sub question"]
    assert one(spark, lambda q: Q.rewrite(q, Q.asked(lambda t: t.upper())), "abc") == "ABC"
    assert one(spark, lambda q: Q.rewrite(q, Q.asked(model)), "bad thi lại") == "Bad thi kết thúc học phần lần 2"
    df = spark.sql("SELECT 1 query_id, 'bad' query, array(struct('d' doc_id, 'text' content)) contexts")
    assert A.generate(df, ["doc_id", "content"], llm=A.model_text(model), cite=False).first().answer == "Lỗi khi gọi LLM: no quota"


def test_retries_search_each_suggestion_once(spark):
    """However many rounds, a round is one search a suggestion, and every question ends with one row."""
    queries = spark.createDataFrame([(k, "q") for k in range(6)], "query_id int, query string")
    seen = []

    def search(part, overrides):
        seen.append(overrides)
        return part.withColumn("n", F.lit(len(seen)))

    def judge(rows):
        low = F.when(F.col("query_id") % 3 == 0, 0.0).otherwise(1.0)
        return rows.select("*", (F.col("query_id") < 5).alias("should_abstain"), low.alias("result_count"), F.when(F.col("query_id") % 3 == 1, 0.0).otherwise(1.0).alias("top_score"), F.lit(0.0).alias("evidence_support"))

    rows = A.corrected(queries, search, judge, max_retries=2).collect()
    assert sorted(r.query_id for r in rows) == list(range(6)) and len(seen) == 1 + 3 + 3
