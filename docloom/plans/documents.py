"""Text functions, cleaning and chunking over documents, some of them dressed up as policy papers or scraped pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import structure as S
from ..functions import text as T
from ..functions import values as V
from ..operators import chunking as C
from ..operators import cleaning as L
from ..storage import spread
from .common import table

# --- made-up texts: literals and expressions in both dialects ---

POLICY = [
    ("CASE WHEN doc_id % 4 = 0 THEN '' ELSE '# ' END",), ("source",), " ", ("doc_id",), "\n## CHƯƠNG ", ("CASE doc_id % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'IV' WHEN 2 THEN 'ix' WHEN 3 THEN 'XII' ELSE '3' END",), ": Phần ", ("lang",), "\n\n",
    ("text",), "\n**Mục 2. Chung**\n", ("lang",), "\n### Điều ", ("doc_id % 30",), ("CASE WHEN doc_id % 7 = 0 THEN 'A' ELSE '' END",), ". Quy  định\n", ("text",), "\n#### Khoản ", ("doc_id % 5",), ": Chi *tiết*\nNội dung\n##### Ghi chú [thêm](x)\n", ("source",), "\n#### Lưu ý\nĐọc kỹ\nKhoản 9. Cuối\nmột",
    "\n## Phụ lục ", ("lang",), "\n", ("source",), "\n### Phụ lục ", ("lang",), "\nHết.\n\n",
]
SCRAPED = [
    "Trang chủ > Tin tức\n### Mục lục\n", ("replace(text, chr(10), chr(10) || '[Xem thêm →](/x)' || chr(10) || '  ' || chr(10) || chr(10) || chr(10) || chr(10))",), "\n## **Tin ", ("lang",), "**\n\nFPT University\n## Tin ", ("lang",), " ##\n# Tin ", ("lang",),
    "\n[Toggle](#)Lọc: a\nlọc: \n* [[email protected]](/cdn-cgi/l/email-protection#ab12)\n# *", ("source",), "*\n## ", ("source",), "\n## ", ("source",), "   \ncuối\n## ", ("source",), "\n \n",
]


def spark_text(parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.expr(p[0]).cast("string") for p in parts])


def sql_text(parts) -> str:
    return " || ".join("'" + p.replace("'", "''") + "'" if isinstance(p, str) else f"({p[0]})::VARCHAR" for p in parts)


def docs(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def policies(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "lang", "source", spark_text(POLICY).alias("text"))


def scraped(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", spark_text(SCRAPED).alias("text"))


def digest(df: DataFrame, *keys: str, column: str = "content") -> DataFrame:
    return df.select(*keys, F.length(column).cast("int").alias("chars"), F.md5(column).alias("md5"))


# --- flat chunkers ---


def pieces_of(spark, sf_dir, chunks) -> DataFrame:
    return digest(C.exploded(docs(spark, sf_dir), chunks, ["doc_id"]), "doc_id", "part_index", "total_parts")


def fixed_chunks(spark, sf_dir) -> DataFrame:
    return pieces_of(spark, sf_dir, C.fixed(F.col("text")))


def sentence_chunks(spark, sf_dir) -> DataFrame:
    return pieces_of(spark, sf_dir, C.by_sentences(F.col("text")))


def recursive_chunks(spark, sf_dir) -> DataFrame:
    return pieces_of(spark, sf_dir, C.recursive(F.col("text")))


def chunk_stats(spark, sf_dir) -> DataFrame:
    return C.chunk_stats(docs(spark, sf_dir), C.by_sentences(F.col("text")), ["lang"]).withColumn("avg_length", F.round("avg_length", 6))


def strategy_compare(spark, sf_dir) -> DataFrame:
    return C.compare(docs(spark, sf_dir), F.col("text")).withColumn("avg_length", F.round("avg_length", 6))


# --- structured chunkers ---


def joined(path: str) -> F.Column:
    return F.array_join(path, " > ").alias(path)


def heading_sections(spark, sf_dir) -> DataFrame:
    rows = C.sections(policies(spark, sf_dir), "doc_id", "text")
    return digest(rows.withColumn("path", joined("path")), "doc_id", F.col("section_ord").cast("int").alias("section_ord"), "path", "chapter", "chapter_number", "article", "article_number", "clause", "clause_number", "slug", column="body")


def plain_sections(spark, sf_dir) -> DataFrame:
    rows = C.sections(policies(spark, sf_dir), "doc_id", "text", advanced=False)
    return digest(rows.withColumn("path", joined("path")), "doc_id", F.col("section_ord").cast("int").alias("section_ord"), "path", column="body")


def section_ids(spark, sf_dir) -> DataFrame:
    """Id, context prefix and context header of each section as one chunk."""
    rows = C.heading_chunks(policies(spark, sf_dir), "doc_id", "text", size=1 << 20)
    rows = C.contextual(rows.join(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id"), F.when(F.col("lang") != "en", F.col("lang")))
    return rows.select("doc_id", F.col("section_ord").cast("int").alias("section_ord"), "title", "chunk_id", C.context_prefix(F.col("title"), F.col("path")).alias("prefix"), "context_header")


def heading_chunks(spark, sf_dir) -> DataFrame:
    return digest(C.heading_chunks(policies(spark, sf_dir), "doc_id", "text"), "doc_id", "section_ord", "chunk_id", "part_index", "total_parts", column="retrieval_content")


def section_chunks(spark, sf_dir) -> DataFrame:
    return digest(C.section_chunks(policies(spark, sf_dir), "doc_id", "text"), "doc_id", "section_ord", "part_index", "total_parts")


def parent_child_chunks(spark, sf_dir) -> DataFrame:
    return digest(C.parent_child_chunks(policies(spark, sf_dir), "doc_id", "text", parent_size=1800, child_size=450, overlap=60), "doc_id", "section_ord", "parent_id", "chunk_id", "child_index", "total_children", column="retrieval_content")


def parent_texts(spark, sf_dir) -> DataFrame:
    rows = C.parent_child_chunks(policies(spark, sf_dir), "doc_id", "text", parent_size=1800, child_size=450, overlap=60)
    return digest(C.parents_of(rows, ["section_ord", "chunk_id"]), "parent_id", column="parent_content")


# --- cleaning ---


def clean_lines(spark, sf_dir) -> DataFrame:
    return digest(scraped(spark, sf_dir).withColumn("content", L.remove_boilerplate(F.col("text"))), "doc_id")


def normalize_ws(spark, sf_dir) -> DataFrame:
    return digest(scraped(spark, sf_dir).withColumn("content", T.normalize_whitespace(F.col("text"))), "doc_id")


def normalize_headings(spark, sf_dir) -> DataFrame:
    return digest(L.normalize_headings(scraped(spark, sf_dir), "doc_id", "text"), "doc_id", column="text")


def clean_documents(spark, sf_dir) -> DataFrame:
    return digest(L.clean_documents(scraped(spark, sf_dir), "doc_id", "text"), "doc_id", column="text")


def clean_markdown(spark, sf_dir) -> DataFrame:
    made = F.concat(F.lit("a b \n  Image: x\nimage y\n"), F.replace("text", F.lit("\n"), F.lit(" \n\n\n ")))
    return digest(docs(spark, sf_dir).withColumn("content", L.clean_markdown(made)), "doc_id")


# --- text functions ---


def text_functions(spark, sf_dir) -> DataFrame:
    """Slugs and heading clean-up of first lines with accents, links and emphasis."""
    line = F.concat(F.lit("## **Điều "), F.col("doc_id").cast("string"), F.lit("**. [Quy   chế]("), F.col("source"), F.lit(") _"), F.split("text", "\n")[0], F.lit("_"))
    df = docs(spark, sf_dir).select("doc_id", "text", line.alias("line"))
    c = F.col("line")
    return df.select(
        "doc_id", T.fold_accents(c).alias("folded"), T.slug(c).alias("slug"), T.url_slug(c).alias("url_slug"), T.clean_heading(c).alias("heading"), T.plain_heading(c).alias("plain"), T.yaml_quote(F.concat(c, F.lit('\\"'))).alias("quoted"),
        T.preview(F.col("text")).alias("preview"), T.contains_folded(F.col("text"), F.upper(F.substring("text", 5, 8))).alias("holds"),
    )


def numerals(spark, sf_dir) -> DataFrame:
    """Roman numerals and other numbers, made of ids."""
    rows = docs(spark, sf_dir).select("doc_id", F.translate(F.col("doc_id").cast("string"), "0123456789", "IVXLCDMIVX").alias("numeral"))
    labels = F.when(F.col("doc_id") % 3 == 0, F.col("numeral")).when(F.col("doc_id") % 3 == 1, F.col("doc_id").cast("string")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit("B.")))
    return rows.select("doc_id", "numeral", T.roman(F.col("numeral")).alias("value"), T.number_label(labels).alias("label"), T.number_label(F.concat(F.lit("Phần "), F.col("numeral"))).alias("other"))


QUERIES = {
    f.__name__: f
    for f in (
        fixed_chunks, sentence_chunks, recursive_chunks, chunk_stats, strategy_compare, heading_sections, plain_sections, section_ids, heading_chunks, section_chunks, parent_child_chunks, parent_texts,
        clean_lines, normalize_ws, normalize_headings, clean_documents, clean_markdown, text_functions, numerals,
    )
}

# --- SQL ---

ACCENTS = "'" + "".join(V.ACCENTED.values()) + "', '" + "".join(k * len(v) for k, v in V.ACCENTED.items()) + "'"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_one_spaced(x: str) -> str:
    return sql_strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def sql_heading(x: str) -> str:
    inner = rf"regexp_replace({sql_strip(x)}, '^#+\s*', '')"
    inner = rf"regexp_replace({inner}, '\[([^\]]+)\]\([^\)]+\)', '\1', 'g')"
    return sql_one_spaced(f"regexp_replace({inner}, '[*_]', '', 'g')")


def sql_slug(x: str, n: int) -> str:
    return f"coalesce(nullif(rtrim(left(trim(regexp_replace(translate(lower({x}), {ACCENTS}), '[^a-z0-9]+', '_', 'g'), '_'), {n}), '_'), ''), 'sec')"


def sql_sections(policy: bool) -> str:
    """Tables l (a row a line with its state) and sec (a row a section)."""
    kinds = S.POLICY if policy else S.PLAIN
    clean = sql_heading if policy else (lambda x: sql_one_spaced(rf"regexp_replace({x}, '\*\*|__', '', 'g')"))
    pattern = lambda h: "(?i)" + h.pattern
    bare = sql_strip("line")
    tests = [(f"regexp_matches(bare, '{pattern(h)}')", f"'{h.kind}'", str(h.level), clean(f"regexp_extract(bare, '{pattern(h)}', 1)"), f"regexp_extract(bare, '{pattern(h)}', {h.number})" if h.number else "NULL") for h in kinds]
    md = (f"regexp_matches(bare, '{V.MARKDOWN}')", "'markdown'", f"length(regexp_extract(bare, '{V.MARKDOWN}', 1))", clean(f"regexp_extract(bare, '{V.MARKDOWN}', 2)"), "NULL")
    tests = [*tests, md] if policy else [md, *tests]
    case = lambda k: "CASE " + " ".join(f"WHEN {t[0]} THEN {t[k]}" for t in tests) + " END"
    levels = [1, 2, 3, 4, 5, 6] + ([] if policy else [20, 30, 40])
    names = ", ".join(f"CASE WHEN max(no) FILTER (WHERE level = {n}) OVER w > coalesce(max(no) FILTER (WHERE level < {n}) OVER w, -1) THEN last_value(CASE WHEN level = {n} THEN heading END IGNORE NULLS) OVER w END" for n in levels)
    roman = "CASE WHEN regexp_matches(upper(number), '^[IVXLCDM]+$') THEN (SELECT sum(CASE WHEN v < m THEN -v ELSE v END)::BIGINT::VARCHAR FROM (SELECT v, coalesce(max(v) OVER (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS m FROM (SELECT i, CASE substr(upper(number), i, 1) WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 ELSE 1000 END AS v FROM unnest(range(1, length(number) + 1)) AS u(i)))) END"
    state = ""
    if policy:
        last = lambda cond: f"coalesce(max(no) FILTER (WHERE {cond}) OVER w, -1)"
        value = lambda cond, c: f"last_value(CASE WHEN {cond} THEN {c} END IGNORE NULLS) OVER w"
        ends = {"chapter": "kind = 'markdown' AND level <= 2", "article": "kind IN ('chapter', 'section') OR kind = 'markdown' AND level <= 4", "clause": "kind IN ('chapter', 'section', 'article') OR kind = 'markdown' AND level <= 4"}
        for k, end in ends.items():
            own = f"kind = '{k}'"
            state += f", CASE WHEN {last(own)} > {last(end)} THEN {value(own, 'heading')} END AS {k}, CASE WHEN {last(own)} > {last(end)} THEN {value(own, 'label')} END AS {k}_number"
        deep = "kind = 'markdown' AND level >= 2"
        ended = "kind IN ('chapter', 'section', 'article', 'clause') OR kind = 'markdown' AND level = 1"
        state += f", CASE WHEN {last(deep)} > {last(ended)} THEN {sql_slug(value(deep, 'heading'), 25)} END AS slug"
        state += ", first_value(CASE WHEN kind = 'markdown' AND level = 1 THEN heading END IGNORE NULLS) OVER w AS first_title"
    columns = "".join(f", any_value({c}) AS {c}" for c in (("chapter", "chapter_number", "article", "article_number", "clause", "clause_number", "slug", "first_title") if policy else ()))
    return rf"""p AS (SELECT doc_id, lang, source, {sql_text(POLICY)} AS text FROM documents),
l0 AS (SELECT doc_id, i - 1 AS no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM p))),
l1 AS (SELECT *, {bare} AS bare FROM l0),
l2 AS (SELECT doc_id, no, line, {case(1)} AS kind, {case(2)} AS level, {case(3)} AS heading, {case(4)} AS number FROM l1),
l3 AS (SELECT *, CASE WHEN regexp_matches(number, '^[0-9]+$') THEN number ELSE coalesce({roman}, lower(regexp_extract(number, '^([0-9]+[a-zA-Z]?)', 1))) END AS label FROM l2),
l AS (SELECT *, count(kind) OVER w AS section_ord, list_filter([{names}], lambda x: x IS NOT NULL AND x <> '') AS names{state} FROM l3 WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sec AS (SELECT doc_id, section_ord::INTEGER AS section_ord, {sql_strip("coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE kind IS NULL), '')")} AS body, any_value(names) AS names{columns} FROM l GROUP BY doc_id, section_ord),
secs AS (SELECT *, array_to_string(list_filter(names, lambda x, i: i = 1 OR lower(x) <> lower(names[i - 1])), ' > ') AS path FROM sec WHERE body <> '')"""


MD = "length({0})::INTEGER AS chars, md5({0}) AS md5"
SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({sql_strip('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {sql_strip('x')}), lambda x: x <> '')"
GROUPED = f"SELECT doc_id, lang, list_transform(range(0, (len(s) + 2) // 3), lambda k: array_to_string(s[3 * k + 1:3 * k + 3], ' ')) AS parts FROM (SELECT doc_id, lang, {SENTENCES} AS s FROM documents)"
PARTS = "SELECT doc_id, i::INTEGER AS part_index, len(parts)::INTEGER AS total_parts, length(parts[i])::INTEGER AS chars, md5(parts[i]) AS md5 FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM ({}))"
FIXED = "SELECT doc_id, list_transform(range(0, CASE WHEN text IS NULL OR text = '' THEN 0 WHEN length(text) <= 500 THEN 1 ELSE (length(text) - 500 + 449) // 450 + 1 END), lambda k: substr(text, k * 450 + 1, 500)) AS parts FROM documents"
CALLS = "(?i)" + L.CALL_LINE.removeprefix("(?iu)")


def sql_lines(text: str) -> str:
    """What lines() gives for texts with line feeds only."""
    return rf"string_split(regexp_replace({text}, '\n$', ''), chr(10))"


def sql_unboilered(text: str) -> str:
    shown = rf"regexp_replace(regexp_replace({text}, '(?i){V.HIDDEN_EMAIL}', '{V.SHOWN_EMAIL}', 'g'), '(?i){V.INLINE_TOGGLE}', '', 'g')"
    noise = " OR ".join(f"regexp_matches({sql_strip('x')}, '{p}')" for p in (CALLS, *("(?i)" + q for q in (V.CONTENTS_LINE, V.FILTER_LINE, V.BREADCRUMB_LINE))))
    return f"array_to_string(list_filter({sql_lines(shown)}, lambda x: NOT ({noise})), chr(10))"


def sql_spaced(text: str) -> str:
    trimmed = rf"regexp_replace(regexp_replace(regexp_replace(array_to_string({sql_lines(text)}, chr(10)), '[ \t]+\n', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '[ \t]+$', '')"
    body = sql_strip(rf"regexp_replace({trimmed}, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')")
    return f"CASE WHEN {body} = '' THEN '' ELSE {body} || chr(10) END"


def sql_headings(source: str) -> str:
    """Table h (doc_id, text) of headings normalised in ``source`` (doc_id, text)."""
    title = rf"regexp_extract(bare, '{V.MARKDOWN}', 2)"
    inner = f"CASE WHEN starts_with(t, '**') AND ends_with(t, '**') AND length(t) > 4 THEN substr(t, 3, length(t) - 4) WHEN starts_with(t, '*') AND ends_with(t, '*') AND length(t) > 2 THEN substr(t, 2, length(t) - 2) ELSE t END"
    return rf"""h0 AS (SELECT doc_id, i AS no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, {sql_lines("text")} AS ls FROM {source}))),
h1 AS (SELECT *, {sql_strip("line")} AS bare FROM h0),
h2 AS (SELECT *, regexp_extract(bare, '{V.MARKDOWN}', 1) AS hashes, {title} AS t FROM h1),
h3 AS (SELECT *, {sql_strip(rf"regexp_replace({sql_strip(inner)}, '\s+#+$', '')")} AS title FROM h2),
h4 AS (SELECT *, CASE WHEN hashes <> '' THEN hashes || ' ' || lower(title) END AS name FROM h3),
h5 AS (SELECT *, last_value(name IGNORE NULLS) OVER w AS last_name, max(no) FILTER (WHERE name IS NOT NULL) OVER w AS last_at, max(no) FILTER (WHERE name IS NULL AND bare <> '' AND lower(bare) NOT IN ('{V.BANNERS[0]}', '{V.BANNERS[1]}')) OVER w AS text_at
    FROM h4 WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT doc_id, coalesce(string_agg(CASE WHEN name IS NULL THEN line ELSE hashes || ' ' || title END, chr(10) ORDER BY no) FILTER (WHERE NOT coalesce(name = last_name AND coalesce(text_at, -1) < last_at, false)), '') AS text FROM h5 GROUP BY doc_id)"""


SCR = f"s AS (SELECT doc_id, {sql_text(SCRAPED)} AS text FROM documents)"
LINE = "line AS (SELECT doc_id, text, '## **Điều ' || doc_id || '**. [Quy   chế](' || source || ') _' || string_split(text, chr(10))[1] || '_' AS x FROM documents)"
TITLE = "titled AS (SELECT *, coalesce(nullif(first_value(first_title) OVER (PARTITION BY doc_id ORDER BY section_ord), ''), doc_id::VARCHAR) AS title FROM secs)"
PATH = "list_filter(string_split(path, ' > '), lambda x: x <> '')"
ROMAN = "sum(CASE WHEN v < m THEN -v ELSE v END)::INTEGER"

SQL = {
    "fixed_chunks": PARTS.format(FIXED),
    "sentence_chunks": PARTS.format(GROUPED),
    "chunk_stats": f"SELECT lang, count(*) AS count, round(avg(length(part)), 6) AS avg_length FROM (SELECT lang, unnest(parts) AS part FROM ({GROUPED})) GROUP BY lang",
    "heading_sections": f"WITH {sql_sections(True)} SELECT doc_id, section_ord, path, chapter, chapter_number, article, article_number, clause, clause_number, slug, {MD.format('body')} FROM secs",
    "plain_sections": f"WITH {sql_sections(False)} SELECT doc_id, section_ord, path, {MD.format('body')} FROM secs",
    "section_ids": f"""WITH {sql_sections(True)}, {TITLE}, x AS (SELECT t.*, documents.lang, CASE WHEN lower(split_part(path, ' > ', 1)) = lower(title) THEN {PATH}[2:] ELSE {PATH} END AS rest FROM titled t JOIN documents USING (doc_id))
SELECT doc_id, section_ord, title, array_to_string(list_filter([doc_id::VARCHAR, 'chapter_' || chapter_number, 'article_' || article_number, CASE WHEN clause_number IS NOT NULL THEN 'clause_' || clause_number WHEN article_number IS NULL AND chapter_number IS NULL AND slug IS NOT NULL THEN 'sec_' || slug END, 'part_1'], lambda x: x IS NOT NULL), '__') AS chunk_id,
    '[SECTION]' || chr(10) || array_to_string(list_concat(['Document: ' || title], rest), ' > ') AS prefix,
    'Document: ' || title || '. Chapter: ' || coalesce(nullif(chapter, ''), 'N/A') || '. Article: ' || coalesce(nullif(article, ''), 'N/A') || '. Audience: ' || CASE WHEN lang <> 'en' THEN lang ELSE 'sinh viên' END || '.' AS context_header FROM x""",
    "clean_lines": f"WITH {SCR}, c AS (SELECT doc_id, {sql_unboilered('text')} AS content FROM s) SELECT doc_id, {MD.format('content')} FROM c",
    "normalize_ws": f"WITH {SCR}, c AS (SELECT doc_id, {sql_spaced('text')} AS content FROM s) SELECT doc_id, {MD.format('content')} FROM c",
    "normalize_headings": f"WITH {SCR}, {sql_headings('s')} SELECT doc_id, {MD.format('text')} FROM h",
    "clean_documents": f"WITH {SCR}, b AS (SELECT doc_id, {sql_unboilered('text')} AS text FROM s), {sql_headings('b')}, c AS (SELECT doc_id, {sql_spaced('text')} AS content FROM h) SELECT doc_id, {MD.format('content')} FROM c",
    "clean_markdown": rf"""WITH a AS (SELECT doc_id, 'a' || chr(160) || 'b ' || chr(10) || '  Image: x' || chr(10) || 'image y' || chr(10) || replace(text, chr(10), ' ' || chr(10) || chr(10) || chr(10) || ' ') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(replace(t, chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g') AS t FROM a), c AS (SELECT doc_id, {sql_strip(r"regexp_replace(regexp_replace(t, '(?im)^\s*image\s*:?.*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS content FROM b) SELECT doc_id, {MD.format("content")} FROM c""",
    "text_functions": f"""WITH {LINE} SELECT doc_id, translate(lower(x), {ACCENTS}) AS folded, {sql_slug('x', 50)} AS slug, coalesce(nullif(trim(regexp_replace(lower({sql_strip('x')}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'document') AS url_slug, {sql_heading('x')} AS heading,
{sql_one_spaced(r"regexp_replace(x, '[*][*]|__', '', 'g')")} AS plain, '"' || replace(replace(x || chr(92) || '"', chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' AS quoted, replace(left(text, 200), chr(10), ' ') AS preview,
contains(replace(lower(text), 'ß', 'ss'), replace(lower(upper(substr(text, 5, 8))), 'ß', 'ss')) AS holds FROM line""",
    "numerals": f"""WITH n AS (SELECT doc_id, translate(doc_id::VARCHAR, '0123456789', 'IVXLCDMIVX') AS numeral FROM documents),
letters AS (SELECT doc_id, i, CASE substr(numeral, i, 1) WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 ELSE 1000 END AS v FROM (SELECT doc_id, numeral, unnest(range(1, length(numeral) + 1)) AS i FROM n)),
after AS (SELECT *, coalesce(max(v) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS m FROM letters), vals AS (SELECT doc_id, {ROMAN} AS value FROM after GROUP BY doc_id)
SELECT n.doc_id, numeral, value, CASE n.doc_id % 3 WHEN 0 THEN value::VARCHAR WHEN 1 THEN n.doc_id::VARCHAR ELSE n.doc_id || 'b' END AS label, rtrim(left('phan_' || lower(numeral), 20), '_') AS other FROM n JOIN vals ON n.doc_id = vals.doc_id""",
}
