"""Validation, manifests, front matter, pages, the store and filters; quality of evidence and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter as M
from ..functions import values as V
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators import validation as D
from ..sources import files as S
from ..sources import pages as P
from ..storage import spread
from .common import BM25, DOCS, chunks, questions, table, with_
from .documents import sql_strip
from .questions import quoted
from .retrieval import HYBRID, hyb

#: Metadata made of ids, in both dialects.
MADE = {
    "title": "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '  ' ELSE 'T ' || doc_id END",
    "source_url": "CASE WHEN doc_id % 17 <> 0 THEN 'https://example.org/' || doc_id END",
    "retrieved_at": "CASE WHEN doc_id % 19 = 0 THEN '' ELSE '2024-01-02' END",
    "document_version": "'v' || (doc_id % 3)",
    "audience": "CASE doc_id % 6 WHEN 0 THEN 'Student' WHEN 1 THEN 'all' WHEN 2 THEN 'alien' WHEN 3 THEN ' staff ' WHEN 4 THEN NULL ELSE 'parent' END",
    "doc_id": "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'other' ELSE 'd' || doc_id END",
}
BODY = "CASE WHEN doc_id % 23 = 0 THEN '   ' WHEN doc_id % 29 = 0 THEN 'x' || chr(65533) WHEN doc_id % 31 = 0 THEN repeat('y', 100) ELSE text END"


def described(spark, sf_dir) -> DataFrame:
    made = F.map_filter(F.create_map(*[x for k, v in MADE.items() for x in (F.lit(k), F.expr(v))]), lambda _, v: v.isNotNull())
    body = F.expr(BODY.replace("chr(65533)", "'�'"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("stem"), made.alias("metadata"), body.alias("body"))


def doc_issues(spark, sf_dir) -> DataFrame:
    return described(spark, sf_dir).select("doc_id", F.array_join(D.issues(F.col("metadata"), F.col("body")), "; ").alias("issues"))


def strict_check_log(spark, sf_dir) -> DataFrame:
    return D.check_log(described(spark, sf_dir), "stem")


def validation_summary(spark, sf_dir) -> DataFrame:
    return D.summary(D.check_log(described(spark, sf_dir), "stem"), by="check_name")


def manifests(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("doc_id").alias("n"), F.col("source").alias("title"), F.col("lang").alias("language"), F.col("n_chars").cast("string").alias("document_version"))
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id", "left")
    rows = labels.select(F.concat(F.when(F.col("doc_id") % 9 == 0, "x").otherwise(" d"), F.col("doc_id").cast("string")).alias("doc_id"), F.concat(F.coalesce("source", F.lit("none")), F.lit(" ")).alias("title"), F.when(F.col("doc_id") % 4 == 0, "xx").otherwise(F.col("lang")).alias("language"), (F.col("n_chars") + F.col("toxic")).cast("string").alias("document_version"), "quality")
    return docs, rows.unionByName(rows.where("quality = 1"))


def manifest_reconcile(spark, sf_dir) -> DataFrame:
    return D.reconcile(*manifests(spark, sf_dir))


def manifest_consistency(spark, sf_dir) -> DataFrame:
    return D.mismatches(*manifests(spark, sf_dir)).distinct()


def manifest_upsert(spark, sf_dir) -> DataFrame:
    docs, _ = manifests(spark, sf_dir)
    new = docs.where("n % 3 = 0").withColumn("title", F.upper("title")).withColumn("doc_id", F.when(F.col("n") % 6 == 0, F.concat(F.lit("new-"), "doc_id")).otherwise(F.col("doc_id")))
    return S.upsert_manifest(docs, new)


FRONT = "CASE doc_id % 4 WHEN 0 THEN chr(65279) || '---' || chr(10) ELSE '---' || chr(10) END || 'title: \"T: ' || doc_id || '\"' || chr(10) || '# note' || chr(10) || 'flag: TRUE' || chr(10) || 'empty: ~' || chr(10) || 'n: ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || CASE doc_id % 5 WHEN 0 THEN '' ELSE '---' || chr(10) END || text"


def front_matter(spark, sf_dir) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("doc_id", F.expr(FRONT.replace("chr(65279)", "'﻿'")).alias("t")).withColumn("f", M.anchored(F.col("t")))
    m = F.col("f.metadata")
    return made.select("doc_id", *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("title", "flag", "empty", "n", "lang")], F.size(F.map_keys(m)).alias("n_keys"), F.md5("f.body").alias("body"))


def html_text(spark, sf_dir) -> DataFrame:
    df = spread(table(spark, sf_dir, "pages")).select("page_id", P.html_text(F.col("html")).alias("text"))
    return df.select("page_id", F.length("text").alias("chars"), F.md5("text").alias("md5"))


def main_content(spark, sf_dir) -> DataFrame:
    df = spread(table(spark, sf_dir, "pages")).select("page_id", P.main_content(F.col("html")).alias("text"))
    return df.select("page_id", F.length("text").alias("chars"), F.md5("text").alias("md5"))


def page_facts(spark, sf_dir) -> DataFrame:
    url, html = F.col("url"), F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", P.page_title(html).alias("title"), P.published_at(html).alias("published_at"), P.T.url_host(url).alias("host"), P.T.url_scheme(url).alias("scheme"), P.T.url_stem(url).alias("stem"), P.allowed(url, ["example.org", "www.example.com"]).alias("allowed"))


def page_documents(spark, sf_dir) -> DataFrame:
    df = P.page_documents(spread(table(spark, sf_dir, "pages")), extra=["page_id"], retrieved_at="2024-01-02")
    return df.select("doc_id", "title", "source_url", F.length("content").alias("chars"), F.md5("markdown").alias("md5"))


def store_changes(spark, sf_dir) -> DataFrame:
    """Labels' documents added again, one document deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    more = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return R.delete_document(R.add_documents(docs, more), 7).groupBy("source").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("docs"))


def cache_misses(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cache = docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("text_hash"))
    return R.missing_from_cache(docs, cache).select("text_hash", F.length("text").cast("int").alias("chars"))


def metadata_filter(spark, sf_dir) -> DataFrame:
    """Labels as metadata: each document under the filters it passes."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("quality"), F.col("quality").cast("string"))
    filters = F.array(*[F.struct(F.lit(n).alias("name"), F.create_map(*[F.lit(x) for kv in f.items() for x in kv]).cast("map<string,string>").alias("f")) for n, f in (("all", {}), ("en", {"lang": "en"}), ("good de", {"lang": "de", "quality": "1"}), ("unlabelled", {"quality": None}), ("no key", {"other": None}), ("never", {"other": "x"}))])
    rows = docs.select("doc_id", meta.alias("m"), F.explode(filters).alias("x"))
    return rows.where(R.matches_filter(F.col("m"), F.col("x.f"))).groupBy("x.name").agg(F.count("*").alias("rows"), F.sum("doc_id").alias("ids"))


def judged_rows(spark, sf_dir) -> DataFrame:
    """Hybrid rankings with contents, audiences (made of languages), and gold made of ids."""
    docs = chunks(spark, sf_dir).select("chunk_idx", "content", F.when(F.col("lang") == "en", "student").when(F.col("lang") == "fr", "ALL").when(F.col("lang") == "de", "faculty").alias("audience"))
    rows = R.lookup(hyb(spark, sf_dir, 5), docs)
    packed = F.sort_array(F.collect_list(F.struct("rank", "chunk_idx", "content", "audience")))
    found = rows.groupBy("query_id").agg(packed.alias("r"))
    of = lambda f: F.transform("r", lambda x: x[f]).alias(f)
    df = questions(spark, sf_dir).join(found, "query_id").select("query_id", "query", of("chunk_idx"), of("content"), of("audience"))
    first = lambda k: F.try_element_at("chunk_idx", F.lit(k))
    gold = F.when(F.col("query_id") % 3 == 0, F.array(first(2), F.lit(-1).cast("long"))).when(F.col("query_id") % 3 == 1, F.array(first(1), first(4))).otherwise(F.array(F.lit(-5).cast("long")))
    return df.withColumn("gold", gold)


def evidence_quality(spark, sf_dir) -> DataFrame:
    df = judged_rows(spark, sf_dir)
    words = F.split("query", " ")
    word = lambda k: F.coalesce(F.try_element_at(words, F.lit(k)), F.lit("zz"))
    groups = F.array(F.struct(F.lit("a").alias("id"), F.array(F.upper(word(1)), F.lit("qqqq")).alias("phrases")), F.struct(F.lit("b").alias("id"), F.array(word(3)).alias("phrases")))
    criteria = F.array(F.struct(F.lit("a").alias("id"), F.array(word(1), word(2)).alias("all_terms")), F.struct(F.lit("b").alias("id"), F.array().cast("array<string>").alias("all_terms")), F.struct(F.lit("c").alias("id"), F.array(F.lit("qqqq")).alias("all_terms")))
    answer = F.when(F.col("query_id") % 4 == 3, "").otherwise(F.col("query"))
    r1 = E.recall_at(F.col("chunk_idx"), F.col("gold"), 1)
    none = F.array().cast("array<string>")
    keywords = F.when(F.col("query_id") % 2 == 0, F.array(word(2), F.lit("qqqq"))).otherwise(none)
    return df.select(
        "query_id", E.evidence_covered(F.col("content"), groups).alias("evidence"), E.section_covered(F.col("chunk_idx"), F.col("content"), F.col("gold"), F.concat(F.lit("Điều 5. "), word(1), F.lit(" xx"))).alias("section"),
        F.round(E.faithfulness(answer, criteria, keywords, r1), 6).alias("by_criteria"),
        F.round(E.faithfulness(answer, F.lit(None).cast("array<struct<id: string, all_terms: array<string>>>"), keywords, r1), 6).alias("by_keywords"),
        F.round(E.audience_match(F.col("audience"), F.lit("Student")), 6).alias("audience_match"),
        E.rubric(F.array_position("chunk_idx", F.col("gold")[0]).cast("int"), F.col("query_id") % 2 == 0).alias("rubric"),
    )


def filter_comparison(spark, sf_dir) -> DataFrame:
    """The first three keyword results with and without a language filter."""
    docs, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    df = E.compared(R.bm25(R.filter_chunks(docs, {"lang": ["en", "es"]}), asked, 3), R.bm25(docs, asked, 3))
    return df.select("query_id", F.col("n_same").cast("int").alias("n_same"), *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("filtered", "unfiltered")])


QUERIES = {
    f.__name__: f
    for f in (
        doc_issues, strict_check_log, validation_summary, manifest_reconcile, manifest_consistency, manifest_upsert, front_matter, html_text, main_content, page_facts, page_documents, store_changes, cache_misses, metadata_filter,
        evidence_quality, filter_comparison,
    )
}

# --- SQL ---

META = "m AS (SELECT doc_id AS id, 'd' || doc_id AS stem, " + ", ".join(f"{v} AS {k}_" for k, v in MADE.items()) + f", {BODY} AS body FROM documents)"


def found_issue(name: str) -> str:
    missing, empty = f"Missing required metadata field: '{name}'", f"Empty required metadata field: '{name}'"
    return f"CASE WHEN {name}_ IS NULL THEN {quoted(missing)} WHEN {sql_strip(name + '_')} = '' THEN {quoted(empty)} END"


EXPECTED = quoted(f"' (expected one of: {V.AUDIENCES})")
INVALID = quoted("Invalid audience value: '")
ISSUES = (
    "list_filter(["
    + ", ".join(
        [
            "CASE WHEN contains(body, chr(65533)) THEN 'Encoding issue: File contains Unicode replacement character (' || chr(92) || 'ufffd)' END", *map(found_issue, V.REQUIRED_FIELDS),
            f"CASE WHEN lower({sql_strip('audience_')}) NOT IN ('', {', '.join(map(quoted, V.AUDIENCES))}) THEN {INVALID} || audience_ || {EXPECTED} END",
            f"CASE WHEN {sql_strip('body')} = '' THEN 'Empty content: Document body contains no text' WHEN length({sql_strip('body')}) < 100 THEN 'Suspiciously short document: Body has ' || length({sql_strip('body')}) || ' characters (minimum: 100)' END",
        ]
    )
    + "], lambda x: x IS NOT NULL)"
)
LACKS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN coalesce({sql_strip(n + '_')}, '') = '' THEN '{n}' END" for n in V.REQUIRED_FIELDS) + "], lambda x: x IS NOT NULL), ', ')"
N_KEYS = " + ".join(f"({k}_ IS NOT NULL)::INTEGER" for k in MADE)
STRICT = quoted(f"'. Must be one of: {V.STRICT_AUDIENCES}")
LOG = f"""x AS (SELECT *, {LACKS} AS lacks, coalesce(lower({sql_strip("audience_")}), '') AS aud, length({sql_strip("body")}) AS n, contains(body, chr(65533)) AS bad FROM m),
log AS (SELECT stem AS target, 'Encoding' AS check_name, NOT bad AS passed, CASE WHEN bad THEN 'Contains Unicode replacement character (' || chr(92) || 'ufffd)' ELSE 'UTF-8 valid' END AS message FROM x
UNION ALL SELECT stem, 'Frontmatter Syntax', true, 'Parsed ' || ({N_KEYS}) || ' frontmatter keys' FROM x WHERE NOT bad
UNION ALL SELECT stem, 'Required Fields', lacks = '', CASE WHEN lacks = '' THEN 'All 5 required fields present' ELSE 'Missing required fields: ' || lacks END FROM x WHERE NOT bad
UNION ALL SELECT stem, 'Audience Value', aud IN ('all', 'faculty', 'staff', 'student'), CASE WHEN aud IN ('all', 'faculty', 'staff', 'student') THEN 'Audience ''' || aud || ''' is valid' WHEN aud = '' THEN 'Audience field is empty or missing' ELSE 'Invalid audience ''' || aud || {STRICT} END FROM x WHERE NOT bad
UNION ALL SELECT stem, 'doc_id Matching', coalesce(doc_id_ = stem, true), CASE WHEN doc_id_ IS NULL THEN 'Implicit doc_id from stem ''' || stem || '''' WHEN doc_id_ = stem THEN 'doc_id matches stem ''' || stem || '''' ELSE 'Frontmatter doc_id ''' || doc_id_ || ''' does not match filename stem ''' || stem || '''' END FROM x WHERE NOT bad
UNION ALL SELECT stem, 'Body Content', n > 100, CASE WHEN n > 100 THEN 'Body content non-empty (' || format('{{:,}}', n) || ' characters > 100)' ELSE 'Body content too short: ' || n || ' characters (must be > 100)' END FROM x WHERE NOT bad)"""
TWO = """d AS (SELECT 'd' || doc_id AS doc_id, doc_id AS n, source AS title, lang AS language, n_chars::VARCHAR AS document_version FROM documents),
r AS (SELECT CASE WHEN l.doc_id % 9 = 0 THEN 'x' ELSE ' d' END || l.doc_id AS doc_id, coalesce(source, 'none') || ' ' AS title, CASE WHEN l.doc_id % 4 = 0 THEN 'xx' ELSE lang END AS language, (n_chars + toxic)::VARCHAR AS document_version, quality FROM labels l LEFT JOIN documents o ON o.doc_id = l.doc_id),
f AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE quality = 1)"""
DECODE = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"
H1 = sql_strip("regexp_replace(" + DECODE.format("regexp_replace(regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g')") + ", '\\s+', ' ', 'g')")
RANKS = "p AS (SELECT f.query_id, f.rank, f.chunk_idx, d.content, CASE d.lang WHEN 'en' THEN 'student' WHEN 'fr' THEN 'all' WHEN 'de' THEN 'faculty' ELSE 'all' END AS audience FROM fused f JOIN d USING (chunk_idx) WHERE f.rank <= 5)"

SQL = {
    "doc_issues": f"WITH {META} SELECT id AS doc_id, array_to_string({ISSUES}, '; ') AS issues FROM m",
    "strict_check_log": f"WITH {META}, {LOG} SELECT *, false AS is_warning FROM log",
    "validation_summary": f"WITH {META}, {LOG} SELECT check_name, count(*) AS checks, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, 0::BIGINT AS warnings FROM log GROUP BY check_name",
    "manifest_reconcile": f"WITH {TWO}, k AS (SELECT trim(doc_id) AS doc_id, count(*) AS n FROM f GROUP BY 1) SELECT coalesce(d.doc_id, k.doc_id) AS doc_id, CASE WHEN k.n IS NULL THEN 'missing_in_manifest' WHEN d.doc_id IS NULL THEN 'extra_in_manifest' ELSE 'duplicate' END AS status FROM (SELECT DISTINCT doc_id FROM d) d FULL JOIN k ON k.doc_id = d.doc_id WHERE k.n IS NULL OR d.doc_id IS NULL OR k.n > 1",
    "manifest_consistency": f"WITH {TWO} " + " UNION ".join(f"SELECT d.doc_id, '{c}' AS field, trim(f.{c}) AS manifest_value, trim(d.{c}) AS document_value FROM d JOIN f ON trim(f.doc_id) = d.doc_id WHERE trim(f.{c}) <> trim(d.{c})" for c in ("title", "language", "document_version")),
    "manifest_upsert": f"WITH {TWO}, new AS (SELECT CASE WHEN n % 6 = 0 THEN 'new-' ELSE '' END || doc_id AS doc_id, upper(title) AS title, document_version FROM d WHERE n % 3 = 0), u AS (SELECT doc_id, title, document_version FROM d WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new) SELECT doc_id, '' AS file_path, title, '' AS source_url, '' AS retrieved_at, document_version, '' AS license_or_permission FROM u",
    "front_matter": f"""WITH t AS (SELECT doc_id, lang, doc_id % 5 <> 0 AS has, text, {FRONT} AS t FROM documents) SELECT doc_id, CASE WHEN has THEN 'T: ' || doc_id END AS title, CASE WHEN has THEN 'true' END AS flag, NULL::VARCHAR AS empty, CASE WHEN has THEN doc_id::VARCHAR END AS n, CASE WHEN has THEN lang END AS lang,
CASE WHEN has THEN 5 ELSE 0 END AS n_keys, md5(CASE WHEN has THEN text ELSE ltrim(t, chr(65279)) END) AS body FROM t""",
    "page_facts": f"""SELECT page_id, {H1} AS title, NULL::VARCHAR AS published_at, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(url, '^([a-z]+):', 1) AS scheme,
regexp_replace(regexp_extract(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '(.)[.][^.]*$', '\\1') AS stem, regexp_extract(url, '^https?://([^/?#:]+)', 1) IN ('example.org', 'www.example.com') AS allowed FROM pages""",
    "store_changes": "WITH u AS (SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT source, count(*) AS rows, count(DISTINCT doc_id) AS docs FROM u WHERE doc_id <> 7 GROUP BY source",
    "cache_misses": "SELECT DISTINCT sha256(text) AS text_hash, length(text)::INTEGER AS chars FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)",
    "metadata_filter": "WITH d AS (SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) "
    + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, sum(doc_id)::BIGINT AS ids FROM d{w} HAVING count(*) > 0" for n, w in (("all", ""), ("en", " WHERE lang = 'en'"), ("good de", " WHERE lang = 'de' AND quality = 1"), ("unlabelled", " WHERE quality IS NULL"), ("no key", ""))),
    "evidence_quality": rf"""{HYBRID}, {RANKS}, c AS (SELECT query_id, string_agg(lower(content), chr(10) ORDER BY rank) AS whole, list(chunk_idx ORDER BY rank) AS ids, list(lower(content) ORDER BY rank) AS cs, count(*) FILTER (WHERE audience IN ('student', 'all'))::DOUBLE / count(*) AS audience_match FROM p GROUP BY query_id),
g AS (SELECT q.query_id, c.*, q.query, string_split(q.query, ' ') AS ws, CASE q.query_id % 3 WHEN 0 THEN [ids[2], -1] WHEN 1 THEN [ids[1], ids[4]] ELSE [-5] END AS gold, CASE WHEN q.query_id % 4 = 3 THEN '' ELSE lower(q.query) END AS answer FROM q JOIN c ON c.query_id = q.query_id),
w AS (SELECT *, coalesce(ws[1], 'zz') AS w1, coalesce(ws[2], 'zz') AS w2, coalesce(ws[3], 'zz') AS w3, list_contains(gold, ids[1]) AS right_first FROM g),
k AS (SELECT *, list_filter(string_split_regex(lower({sql_strip(r"replace(replace(replace('Điều 5. ' || w1 || ' xx', 'Điều', ''), 'CHƯƠNG', ''), '.', '')")}), '\s+'), lambda x: length(x) > 2) AS names FROM w)
SELECT query_id, (contains(whole, lower(w1)) AND contains(whole, lower(w3)))::INTEGER::DOUBLE AS evidence, (len(list_filter([1, 2, 3, 4, 5], lambda i: list_contains(gold, ids[i]) AND (len(names) = 0 OR len(list_filter(names, lambda n: contains(cs[i], n))) > 0))) > 0)::INTEGER::DOUBLE AS section,
    CASE WHEN answer <> '' THEN round((contains(answer, lower(w1)) AND contains(answer, lower(w2)))::INTEGER / 3.0::DOUBLE, 6) WHEN query_id % 2 = 0 THEN 0 WHEN right_first THEN 1 ELSE 0.5 END::DOUBLE AS by_criteria,
    CASE WHEN query_id % 2 = 0 AND answer <> '' THEN contains(answer, lower(w2))::INTEGER / 2.0::DOUBLE WHEN query_id % 2 = 0 THEN 0 WHEN right_first THEN 1 ELSE 0.5 END::DOUBLE AS by_keywords, round(audience_match, 6) AS audience_match,
    CASE WHEN list_position(ids, gold[1]) = 1 AND query_id % 2 = 0 THEN 2 WHEN coalesce(list_position(ids, gold[1]), 0) BETWEEN 1 AND 3 THEN 1 ELSE 0 END AS rubric FROM k""",
    "filter_comparison": f"""WITH a AS ({with_(DOCS.replace("FROM documents", "FROM documents WHERE lang IN ('en', 'es')"), "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)", BM25)} SELECT query_id, list(chunk_idx ORDER BY rank) AS f FROM bm25 WHERE rank <= 3 GROUP BY query_id),
b AS ({with_(DOCS, "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)", BM25)} SELECT query_id, list(chunk_idx ORDER BY rank) AS u FROM bm25 WHERE rank <= 3 GROUP BY query_id)
SELECT query_id, len(list_intersect(coalesce(f, []), coalesce(u, [])))::INTEGER AS n_same, coalesce(array_to_string(f, ','), '') AS filtered, coalesce(array_to_string(u, ','), '') AS unfiltered FROM a FULL JOIN b USING (query_id)""",
}
