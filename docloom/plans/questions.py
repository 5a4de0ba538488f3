"""Questions made of ids, and what is made of them; prompts, answers, evidence and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import answers as A
from ..operators import questions as Q
from ..operators import ranking as K
from ..operators import retrieval as R
from .common import ASKED, BM25, DENSE, DOCS, FUSED, HASHED, TEXTS, chunks, questions, ranked, table, with_
from .retrieval import hyb, text_vectors

STARTS = ["Điều kiện xin", "cách đăng ký", "Nếu trượt môn thì thi lại", "Học phí", "So sánh", "Sinh viên rớt", "ojt", "GPA 3.5 điểm theo Điều 12 khi", "weather", "Fall này bảo lưu", "thầy cô liên hệ", "   ", "nghỉ học cảnh cáo"]
TOPICS = ["học bổng", "học phí HCM", "thực tập quốc tế", "phúc khảo điểm danh", "tín chỉ", "nghỉ học", "xyz", "FAP"]
JOINS = [" và ", " rồi ", ", ", " sau đó ", " đồng thời ", " ngoài ra ", " "]
ENDS = ["tốt nghiệp như thế nào?", "đăng ký học lại ở đâu", "chuyển ngành thì sao.", "bao nhiêu 12 tín chỉ!", "", "intern"]
PARTS = [(STARTS, 1), (TOPICS, 5), (JOINS, 7), (ENDS, 3)]


def asked(spark, sf_dir) -> DataFrame:
    """A question for each document id."""
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (F.floor(F.col("doc_id") / by) % len(words)).cast("int") + 1)
    a, b, c, d = (pick(*p) for p in PARTS)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(a, F.lit(" "), b, c, d).alias("query"))


def bar(c) -> F.Column:
    return F.array_join(c, "|")


def query_analysis(spark, sf_dir) -> DataFrame:
    df = Q.analyze(asked(spark, sf_dir))
    of = lambda k: F.try_element_at("filters", F.lit(k)).alias(k)
    return df.select("doc_id", "query_type", F.round("confidence", 6).alias("confidence"), of("audience"), of("campus"), of("department"), *[bar(c).alias(c) for c in ("entities", "topics", "rewritten", "decomposed")])


def query_rewrite(spark, sf_dir) -> DataFrame:
    q = F.col("query")
    return asked(spark, sf_dir).select("doc_id", Q.rewrite(q).alias("formal"), Q.enrich(q).alias("enriched"), bar(Q.rewritten_variants(q)).alias("variants"))


def query_variants(spark, sf_dir) -> DataFrame:
    return asked(spark, sf_dir).select("doc_id", F.posexplode(Q.search_variants(F.col("query"))).alias("no", "variant"))


def hyde_passage(spark, sf_dir) -> DataFrame:
    return asked(spark, sf_dir).select("doc_id", Q.passage(F.col("query")).alias("passage"))


def query_decompose(spark, sf_dir) -> DataFrame:
    return asked(spark, sf_dir).select("doc_id", Q.should_decompose(F.col("query")).alias("several"), bar(Q.decompose(F.col("query"))).alias("parts"))


def query_route(spark, sf_dir) -> DataFrame:
    df = Q.analyze(asked(spark, sf_dir)).select("doc_id", "query_type")
    both = [df.select("doc_id", F.lit(name).alias("setup"), Q.route(F.col("query_type"), *flags).alias("r")) for name, flags in (("plain", (False, False)), ("full", (True, True)))]
    return both[0].unionByName(both[1]).select("doc_id", "setup", "r.*")


def multi_query_topk(spark, sf_dir) -> DataFrame:
    asked = questions(spark, sf_dir)
    variants = asked.select("query_id", F.posexplode(Q.search_variants(F.col("query"))).alias("variant_no", "query"))
    docs = chunks(spark, sf_dir)
    found = R.multi_query(variants, lambda q, k: R.bm25(docs, q, k))
    return ranked(found.withColumn("query_id", F.col("query_id").cast("long")))


def hyde_topk(spark, sf_dir) -> DataFrame:
    passages = questions(spark, sf_dir).select("query_id", Q.passage(F.col("query")).alias("query"))
    return ranked(R.dense(text_vectors(spark, sf_dir), R.embedded_queries(passages), k=10))


FIELDS = ["doc_id", "chapter", "article", "content", "score"]


def with_contexts(spark, sf_dir) -> DataFrame:
    docs = chunks(spark, sf_dir).select("chunk_idx", F.col("chunk_idx").alias("doc_id"), F.when(F.col("chunk_idx") % 2 == 0, F.col("source")).alias("chapter"), F.col("lang").alias("article"), "content")
    found = A.gathered(R.lookup(hyb(spark, sf_dir, 3), docs), FIELDS)
    return questions(spark, sf_dir).join(found, "query_id", "left")


def rag_prompt(spark, sf_dir) -> DataFrame:
    df = with_contexts(spark, sf_dir).withColumn("prompt", A.prompt(F.col("query"), F.col("contexts"), FIELDS))
    return df.select("query_id", F.length("prompt").cast("int").alias("chars"), F.md5("prompt").alias("md5"))


def citation_text(spark, sf_dir) -> DataFrame:
    df = with_contexts(spark, sf_dir).withColumn("citations", A.citations(F.col("contexts"), FIELDS))
    return df.select("query_id", A.citations_text(F.col("citations")).alias("cited"), F.md5(F.array_join(F.transform("citations", lambda c: c["preview"]), "|")).alias("previews"))


def extractive_answer(spark, sf_dir) -> DataFrame:
    df = A.extractive(with_contexts(spark, sf_dir))
    return df.select("query_id", F.length("answer").cast("int").alias("chars"), F.md5("answer").alias("md5"))


def agent_prompt(spark, sf_dir) -> DataFrame:
    """The plain agent over the whole-document store."""
    df = with_contexts(spark, sf_dir).crossJoin(F.broadcast(chunks(spark, sf_dir).agg(F.count("*").alias("n"))))
    return df.select("query_id", F.md5(A.agent_prompt(F.col("query"), F.col("contexts"), F.col("n"))).alias("md5"))


CLAIMS = "'Cần ' || (doc_id % 9) || ',5 tín chỉ theo Điều ' || (doc_id % 20) || 'b, trước 1' || (doc_id % 9) || '/03/2024; ' || (doc_id % 13) || ' % học phí'"
PROOFS = [("'Theo điều ' || (doc_id % 6) || 'B và ngày 14/03/2024 của ' || source", "a"), ("'Nộp ' || (doc_id % 5) || ',5 tín chỉ, khoản 7'", "b")]


def made_answers(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    contexts = F.array(*[F.struct(F.lit(name).alias("doc_id"), F.expr(text).alias("content"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("section")) for text, name in PROOFS])
    return docs.select("doc_id", F.expr(CLAIMS).alias("answer"), contexts.alias("contexts"))


def evidence_support(spark, sf_dir) -> DataFrame:
    df = made_answers(spark, sf_dir).select("doc_id", F.posexplode(A.check_evidence(F.col("answer"), F.col("contexts"), ["doc_id", "section", "content"])).alias("no", "e"))
    return df.select("doc_id", "no", "e.*")


def confidence(spark, sf_dir) -> DataFrame:
    """Of vector searches; every third result counts as unsupported, results of even ids as having metadata."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = R.dense(v.select(F.col("vec_id").alias("chunk_idx"), "embedding"), asked, k=5, normalized=False).where("rank <= 1 + query_id % 5")
    rows = F.sort_array(F.collect_list(F.struct("rank", (F.col("score") - F.col("query_id") % 3 * 0.5).alias("score"), "chunk_idx")))
    df = found.groupBy("query_id").agg(rows.alias("rows"))
    evidence = F.transform("rows", lambda r: F.struct((r["rank"] % 3 != 0).alias("supported")))
    judged = A.retry(A.assess(df, F.transform("rows", lambda r: r["score"]), evidence, F.transform("rows", lambda r: r["chunk_idx"] % 2 == 0)))
    numbers = [*V.WEIGHTS, "retrieval_confidence", "overall_confidence"]
    return judged.select("query_id", *[F.round(c, 6).alias(c) for c in numbers], "should_abstain", "abstention_reason", "retry")


def rerank_passthrough(spark, sf_dir) -> DataFrame:
    df = K.rerank(hyb(spark, sf_dir), 3)
    return df.select("query_id", "chunk_idx", F.col("rank").cast("int").alias("rank"), F.round("rerank_score", 6).alias("rerank_score"))


def rerank_scored(spark, sf_dir) -> DataFrame:
    """With a Column as the scorer: how many words of the question a chunk holds."""
    found = R.lookup(hyb(spark, sf_dir), chunks(spark, sf_dir)).join(questions(spark, sf_dir), "query_id")
    words = lambda q, t: F.size(F.filter(F.array_distinct(A.T.tokens(q)), lambda w: F.contains(F.lower(t), w))).cast("double")
    return K.rerank(found, 5, words).select("query_id", "chunk_idx", F.col("rank").cast("int").alias("rank"), "rerank_score")


QUERIES = {
    f.__name__: f
    for f in (
        query_analysis, query_rewrite, query_variants, hyde_passage, query_decompose, query_route, multi_query_topk, hyde_topk, rag_prompt, citation_text, extractive_answer, agent_prompt, evidence_support, confidence,
        rerank_passthrough, rerank_scored,
    )
}

# --- SQL ---


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def any_in(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"


def count_in(x: str, words) -> str:
    return "(" + " + ".join(f"contains({x}, {quoted(w)})::INTEGER" for w in words) + ")"


def first_in(x: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {quoted(k)}) THEN {quoted(v)}" for k, v in pairs.items()) + " END"


def compact(*xs: str) -> str:
    return f"list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL)"


def once(x: str) -> str:
    """Distinct elements in order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def in_turn(x: str, pairs, test: str | None = None) -> str:
    for k, v in pairs.items():
        done = f"replace({x}, {quoted(k)}, {quoted(v)})"
        x = f"CASE WHEN contains({test}, {quoted(k)}) THEN {done} ELSE {x} END" if test else done
    return x


def topic_list(table) -> str:
    return once(compact(*[f"CASE WHEN contains(q, {quoted(k)}) THEN {quoted(v)} END" for k, v in table.items()]))


QUESTION = " || ".join(("' ' || " if k == 1 else "") + f"[{', '.join(map(quoted, words))}][(doc_id // {by}) % {len(words)} + 1]" for k, (words, by) in enumerate(PARTS))
MADE = f"asked AS (SELECT doc_id, {QUESTION} AS query FROM documents), a AS (SELECT doc_id, query, lower({strip('query')}) AS q FROM asked)"
KIND = (
    f"CASE WHEN NOT ({any_in('q', V.SCOPE)} OR length(q) <= 5) THEN 'OUT_OF_SCOPE' WHEN {count_in('q', V.CONNECTORS)} >= 1 AND ({count_in('q', V.CATEGORY_OF)} >= 2 OR {count_in('q', V.CONNECTORS)} >= 2) THEN 'MULTI_HOP' WHEN {any_in('q', V.GLOBAL)} THEN 'GLOBAL' "
    rf"WHEN {any_in('q', V.PROCEDURAL)} THEN 'PROCEDURAL' WHEN {any_in('q', V.FACTUAL)} THEN 'FACTUAL' WHEN len(regexp_extract_all(q, '\S+')) <= 3 THEN 'AMBIGUOUS' ELSE 'FACTUAL' END"
)
ENTITIES = f"list_concat(list_concat(list_transform(regexp_extract_all(q, '{V.ARTICLE_ENTITY}', 1), lambda n: 'Điều ' || n), list_transform(regexp_extract_all(q, '{V.NUMBER_ENTITY}', 1), lambda n: 'số: ' || n)), CASE WHEN {any_in('q', V.SEMESTERS)} THEN [{quoted(V.SEMESTER_ENTITY)}] ELSE [] END)"
SIMPLE = f"list_filter(list_transform(string_split_regex(q, '{V.SPLIT_SHORT}'), lambda p: {strip('p')}), lambda p: length(p) > 10)"
FORMAL_ALL = in_turn("lower(query)", V.FORMAL)
FORMAL = "upper(left(f, 1)) || substr(f, 2)"
MORE = compact(*[f"CASE WHEN contains(lower(query), {quoted(k)}) THEN CASE " + " ".join(f"WHEN NOT contains(lower(query), {quoted(t.lower())}) THEN {quoted(t)}" for t in terms) + " END END" for k, terms in V.EXPANSIONS.items()])
FRAMED = [f"CASE WHEN {any_in('lower(s)', f['words'])} THEN {quoted(f['has'][0])} || s || {quoted(f['has'][1])} ELSE {quoted(f['lacks'][0])} || s || {quoted(f['lacks'][1])} END" for f in V.VARIANT_FRAMES]
SAME = "CASE " + " ".join(f"WHEN contains(lower(s), {quoted(k)}) THEN regexp_replace(s, {quoted(k)}, {quoted(v)}, 'gi')" for k, v in V.SYNONYMS.items()) + " END"
CLEAN = f"regexp_replace({strip('query')}, '[?.!]+$', '')"


def passage_sql(clean: str) -> str:
    filled = lambda text: f"{quoted(text.split('{}')[0])} || {clean} || {quoted(text.split('{}')[1])}"
    return "CASE " + " ".join(f"WHEN {any_in(f'lower({clean})', words)} THEN {filled(text)}" for words, text in V.PASSAGES if words) + f" ELSE {filled(V.PASSAGES[-1][1])} END"


EDGE = r"(^|[^\p{L}\p{N}_])"
EDGE_END = r"([^\p{L}\p{N}_]|$)"
SEVERAL = " OR ".join(f"regexp_matches(q2, '{EDGE + p[2:-2] + EDGE_END}')" for p in V.JOINT_PATTERNS)
SPLIT = f"string_split_regex(q, '{EDGE}(?:{'|'.join(V.SPLIT_WORDS)}){EDGE_END}')"
GIVEN = f"CASE WHEN regexp_matches(q, '{V.IF_THEN}') THEN [regexp_extract(q, '{V.IF_THEN}', 1), regexp_extract(q, '{V.IF_THEN}', 2)] ELSE {SPLIT} END"
LONG = f"list_filter(list_transform({GIVEN}, lambda p: {strip('p')}), lambda p: length(p) > 10)"
SENTENCE = "list_transform(l, lambda p: upper(left(p, 1)) || substr(p, 2) || CASE WHEN regexp_matches(p, '[.?!]$') THEN '' ELSE '?' END)"


def route_sql(setup: str, reranker: bool, llm: bool) -> str:
    rows = []
    for kind, made in V.ROUTES.items():
        strategy, flags = made["strategy"], made["flags"]
        flags = set(flags)
        if kind == "AMBIGUOUS" and llm:
            strategy, flags = "hyde", {"filter", "hyde"}
        if reranker and kind not in ("AMBIGUOUS", "OUT_OF_SCOPE"):
            strategy, flags = strategy.replace("hybrid", "hybrid_reranked"), flags | {"reranker"}
        rows.append(f"('{kind}', '{setup}', '{strategy}', {', '.join(str(f in flags).lower() for f in V.ROUTE_FLAGS)})")
    return ", ".join(rows)


HYBRID = with_(DOCS, ASKED, TEXTS, BM25, HASHED, DENSE, FUSED)
CTX = "ctx AS (SELECT f.query_id, f.rank, d.chunk_idx AS doc_id, CASE WHEN d.chunk_idx % 2 = 0 THEN d.source END AS chapter, d.lang AS article, d.content, f.score FROM fused f JOIN d USING (chunk_idx) WHERE f.rank <= 3)"
REFERENCE = "array_to_string(list_filter([doc_id::VARCHAR, chapter, article], lambda x: x IS NOT NULL), ' | ')"
NL2 = "chr(10) || chr(10)"
ASK = f"{quoted(V.QUESTION_LABEL)} || query"


def lit(text: str) -> str:
    return " || chr(10) || ".join(quoted(t) for t in text.split("\n"))


WORDS = rf"list_filter(list_distinct(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')), lambda w: length(w) > 1 AND NOT list_contains([{', '.join(map(quoted, V.STOP_WORDS))}], w))"
LINES = rf"list_transform(string_split(regexp_replace(content, '([.!?\n])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')})"
FUSED_FOR = """fs AS (SELECT query_id, chunk_idx, sum(1.0::DOUBLE / (60 + rank)) AS score FROM {} GROUP BY query_id, chunk_idx),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_idx)::INTEGER AS rank FROM fs) SELECT query_id, rank, chunk_idx, round(score, 6) AS score FROM fr WHERE rank <= 10"""
VARIANTS = f"SELECT id, i - 1 AS no, v[i] AS variant FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT id, list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i) AS v FROM (SELECT id, list_transform({compact('s', *FRAMED, f'CASE WHEN lower({SAME}) <> lower(s) THEN {SAME} END')}, lambda y: {strip('y')}) AS w FROM s WHERE s <> '')))"
NUMBERS = f"list_transform(regexp_extract_all(answer, '{V.NUMBER_CLAIM}', 1), lambda n: {strip('substr(answer, greatest(instr(answer, n) - 31, 0) + 1, least(length(answer), instr(answer, n) + length(n) + 29) - greatest(instr(answer, n) - 31, 0))')})"

SQL = {
    "query_analysis": f"""WITH {MADE}, k AS (SELECT *, {KIND} AS query_type FROM a), e AS (SELECT *, {ENTITIES} AS e, {topic_list(V.CATEGORY_OF)} AS t, {in_turn("q", V.FORMAL_SHORT, "q")} AS f, {SIMPLE} AS parts, query_type <> 'OUT_OF_SCOPE' AS here FROM k)
SELECT doc_id, query_type, round(CASE WHEN here THEN least(1, 0.5 + 0.1 * least(len(t), 3) + CASE WHEN len(e) > 0 THEN 0.1 ELSE 0 END + 0.1) ELSE 0.3 END::DOUBLE, 6) AS confidence, CASE WHEN here THEN coalesce({first_in("q", V.AUDIENCE_OF)}, 'student') END AS audience,
    CASE WHEN here AND {any_in("q", V.CAMPUS_WORDS)} THEN '{V.CAMPUS}' END AS campus, CASE WHEN here THEN {first_in("q", V.DEPARTMENT_OF)} END AS department, CASE WHEN here THEN array_to_string(e, '|') ELSE '' END AS entities, CASE WHEN here THEN array_to_string(t, '|') ELSE '' END AS topics,
    CASE WHEN here THEN array_to_string({compact("query", "nullif(f, q)", quoted(V.ENRICHED_START) + " || query")}, '|') ELSE '' END AS rewritten, CASE WHEN query_type = 'MULTI_HOP' THEN CASE WHEN len(parts) > 1 THEN array_to_string(parts, '|') ELSE q END ELSE '' END AS decomposed FROM e""",
    "query_rewrite": f"""WITH {MADE}, r AS (SELECT *, {FORMAL_ALL} AS f, array_to_string({MORE}, ', ') AS m FROM a), t AS (SELECT *, {FORMAL} AS formal, CASE WHEN m <> '' THEN query || ' (' || m || ')' ELSE query END AS enriched FROM r)
SELECT doc_id, formal, enriched, array_to_string({once("[query, formal, enriched, " + quoted(V.PREFIX_START) + " || query]")}[1:4], '|') AS variants FROM t""",
    "query_variants": f"WITH {MADE}, s AS (SELECT doc_id AS id, {strip('query')} AS s FROM asked), v AS ({VARIANTS}) SELECT id AS doc_id, no::INTEGER AS no, variant FROM v",
    "hyde_passage": f"WITH {MADE}, c AS (SELECT doc_id, {CLEAN} AS c FROM asked) SELECT doc_id, {passage_sql('c')} AS passage FROM c",
    "query_decompose": f"WITH {MADE}, l AS (SELECT *, lower(query) AS q2, {LONG} AS l, len({topic_list(V.JOINT_TOPICS).replace('contains(q,', 'contains(lower(query),')}) AS n FROM a) SELECT doc_id, ({SEVERAL}) AND n >= 2 AS several, CASE WHEN len(l) > 1 THEN array_to_string({SENTENCE}, '|') ELSE query END AS parts FROM l",
    "query_route": f"WITH {MADE}, k AS (SELECT doc_id, {KIND} AS query_type FROM a), r(kind, setup, strategy, {', '.join('use_' + f for f in V.ROUTE_FLAGS)}) AS (VALUES {route_sql('plain', False, False)}, {route_sql('full', True, True)}) SELECT doc_id, r.* EXCLUDE (kind) FROM k JOIN r ON r.kind = k.query_type",
    "multi_query_topk": f"WITH {DOCS}, s AS (SELECT item_id AS id, {strip('text')} AS s FROM benchmark), vs AS ({VARIANTS}), q AS (SELECT id || '#' || no AS query_id, variant AS query FROM vs), {BM25.strip()}, per AS (SELECT split_part(query_id, '#', 1)::BIGINT AS query_id, chunk_idx, rank FROM bm25 WHERE rank <= 20), {FUSED_FOR.format('per')}",
    "hyde_topk": f"WITH {DOCS}, c AS (SELECT item_id AS query_id, {CLEAN.replace('query', 'text')} AS c FROM benchmark), q AS (SELECT query_id, {passage_sql('c')} AS query FROM c), {TEXTS}, {HASHED.strip()}, {DENSE.strip()} SELECT query_id, rank, chunk_idx, round(score, 6) AS score FROM dense WHERE rank <= 10",
    "rag_prompt": f"""{HYBRID}, {CTX}, p AS (SELECT q.query_id, {lit(V.SYSTEM_PROMPT)} || {NL2} || CASE WHEN count(rank) > 0 THEN '{V.CONTEXT_LABEL.strip()}' || chr(10) || string_agg('[' || rank || '] [Source: ' || {REFERENCE} || '] (score: ' || printf('%.3f', score) || ')' || chr(10) || content, {NL2} ORDER BY rank)
    ELSE {quoted(V.NO_CONTEXT)} END || {NL2} || {ASK.replace("query", "any_value(query)")} || {NL2} || CASE WHEN count(rank) > 0 THEN {quoted(V.ANSWER_LABEL)} ELSE {quoted(V.NO_ANSWER)} END AS prompt FROM q LEFT JOIN ctx ON ctx.query_id = q.query_id GROUP BY q.query_id)
SELECT query_id, length(prompt)::INTEGER AS chars, md5(prompt) AS md5 FROM p""",
    "citation_text": f"""{HYBRID}, {CTX} SELECT query_id, {lit(V.CITATIONS_TITLE)} || chr(10) || string_agg('[' || rank || '] ' || doc_id || ' | ' || array_to_string(list_filter([chapter, article], lambda x: x IS NOT NULL), ' > '), chr(10) ORDER BY rank) AS cited,
md5(string_agg(replace(left(content, 200), chr(10), ' '), '|' ORDER BY rank)) AS previews FROM ctx GROUP BY query_id""",
    "extractive_answer": f"""{HYBRID}, {CTX}, qw AS (SELECT query_id, query, {WORDS} AS words FROM q), lines AS (SELECT query_id, query, words, rank, ls[i] AS line, i AS pos FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT qw.*, rank, {LINES} AS ls FROM ctx JOIN qw USING (query_id)))),
o AS (SELECT *, len(list_filter(words, lambda x: contains(lower(line), x))) AS overlap FROM lines WHERE length(line) > 15), u AS (SELECT *, row_number() OVER (PARTITION BY query_id, line ORDER BY overlap DESC, rank, pos) AS n FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank, pos) AS k FROM u WHERE n = 1), best AS (SELECT query_id, string_agg('- ' || line, {NL2} ORDER BY k) AS body FROM b WHERE k <= 8 GROUP BY query_id),
f AS (SELECT q.query_id, {quoted(V.ANSWER_START[0])} || q.query || {lit(V.ANSWER_START[1])} || coalesce(best.body, left(c.content, 1500)) AS answer FROM q JOIN (SELECT * FROM ctx WHERE rank = 1) c ON c.query_id = q.query_id LEFT JOIN best ON best.query_id = q.query_id)
SELECT query_id, length(answer)::INTEGER AS chars, md5(answer) AS md5 FROM f""",
    "agent_prompt": f"""{HYBRID}, {CTX} SELECT q.query_id, md5({quoted(V.AGENT_RULES)} || {NL2} || '{V.CONTEXT_LABEL.strip()}' || chr(10) || string_agg('[' || rank || '] (nguồn: ' || doc_id || ')' || chr(10) || content, {NL2} ORDER BY rank) || {NL2} || {ASK.replace("query", "any_value(query)")} || {NL2} || {quoted(V.ANSWER_LABEL)}) AS md5
FROM q JOIN ctx ON ctx.query_id = q.query_id GROUP BY q.query_id""",
    "evidence_support": rf"""WITH a AS (SELECT doc_id, lang, {CLAIMS} AS answer, [{", ".join(p for p, _ in PROOFS)}] AS ctx FROM documents), p AS (SELECT doc_id, lang, ctx, list_concat(list_concat({NUMBERS}, regexp_extract_all(answer, '{V.ARTICLE_CLAIM}')), regexp_extract_all(answer, '{V.DATE_CLAIM}'))[1:10] AS ps FROM a),
r AS (SELECT doc_id, lang, ctx, i - 1 AS no, ps[i] AS claim FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM p)), c AS (SELECT *, lower(ctx[k]) AS content FROM (SELECT *, unnest([1, 2]) AS k FROM r)),
j AS (SELECT *, contains(content, lower({strip("claim")})) AS whole, list_filter(regexp_extract_all(claim, '{V.NUMBER}'), lambda n: contains(content, n))[1] AS number FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, no ORDER BY CASE WHEN whole OR number IS NOT NULL THEN k ELSE 9 END) AS n FROM j)
SELECT doc_id, no::INTEGER AS no, claim, whole OR number IS NOT NULL AS supported, CASE WHEN whole OR number IS NOT NULL THEN ['a', 'b'][k] ELSE '' END AS source, CASE WHEN whole OR number IS NOT NULL THEN CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'N/A' END ELSE '' END AS section,
    CASE WHEN whole THEN 1.0 WHEN number IS NOT NULL THEN 0.7 ELSE 0 END::DOUBLE AS score, CASE WHEN whole THEN claim WHEN number IS NOT NULL THEN number ELSE '' END AS matching_text FROM f WHERE n = 1""",
    "confidence": f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_idx, list_inner_product(a.e, b.e) AS score FROM e a CROSS JOIN e b WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, chunk_idx, score - query_id % 3 * 0.5::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_idx) AS rank FROM s),
g AS (SELECT query_id, count(*) AS n, max(score) AS top, max(score) FILTER (WHERE rank = 2) AS second, count(*) FILTER (WHERE rank % 3 <> 0)::DOUBLE / count(*) AS ev, count(*) FILTER (WHERE chunk_idx % 2 = 0)::DOUBLE / count(*) AS md FROM r WHERE rank <= 1 + query_id % 5 GROUP BY query_id),
x AS (SELECT query_id, least(n / 3.0::DOUBLE, 1) AS result_count, least(greatest(top, 0), 1) AS top_score, CASE WHEN n >= 2 THEN least((top - second) * 5, 1) ELSE 0.5 END::DOUBLE AS score_gap, ev AS evidence_support, md AS metadata_quality FROM g),
y AS (SELECT *, result_count * 0.3 + top_score * 0.5 + score_gap * 0.2 AS retrieval_confidence, result_count * 0.15 + top_score * 0.3 + score_gap * 0.1 + evidence_support * 0.3 + metadata_quality * 0.15 AS overall_confidence FROM x)
SELECT query_id, {", ".join(f"round({c}, 6) AS {c}" for c in (*V.WEIGHTS, "retrieval_confidence", "overall_confidence"))}, overall_confidence < 0.3 AS should_abstain,
    CASE WHEN overall_confidence >= 0.3 THEN '' WHEN result_count < 0.33 THEN {quoted(V.ABSTAIN_REASONS[0])} WHEN top_score < 0.2 THEN {quoted(V.ABSTAIN_REASONS[1])} WHEN evidence_support < 0.3 THEN {quoted(V.ABSTAIN_REASONS[2])} ELSE {quoted(V.ABSTAIN_REASONS[3])} END AS abstention_reason,
    CASE WHEN overall_confidence >= 0.3 THEN '' WHEN result_count < 0.33 THEN 'broaden_filters' WHEN top_score < 0.2 THEN 'rewrite_query' ELSE 'multi_query' END AS retry FROM y""",
    "rerank_passthrough": f"{HYBRID} SELECT query_id, chunk_idx, rank, round(score, 6) AS rerank_score FROM fused WHERE rank <= 3",
    "rerank_scored": rf"""{HYBRID}, x AS (SELECT f.query_id, f.chunk_idx, f.rank, len(list_filter(list_distinct(regexp_extract_all(lower(q.query), '[\p{{L}}\p{{N}}_]+')), lambda w: contains(lower(d.content), w)))::DOUBLE AS rerank_score FROM fused f JOIN d USING (chunk_idx) JOIN q ON q.query_id = f.query_id WHERE f.rank <= 10),
y AS (SELECT query_id, chunk_idx, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank)::INTEGER AS rank, rerank_score FROM x) SELECT * FROM y WHERE rank <= 5""",
}
