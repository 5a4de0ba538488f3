"""Web pages: text, titles, dates and metadata from HTML that is already in a table."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators.cleaning import clean_markdown
from .files import markdown_document

BLOCKS, SKIPPED, NOISE = frozenset(V.BLOCK_TAGS), frozenset(V.SKIP_TAGS), frozenset(V.NOISE_TAGS)
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])


class PlainText(HTMLParser):
    """Visible text with line ends around blocks; the title is part of it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in SKIPPED
        if not self.hidden and tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden -= tag in SKIPPED
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def plain_text(html: str | None) -> str:
    parser = PlainText()
    parser.feed(html or "")
    parser.close()
    text = re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+", " ", "".join(parser.out)))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


class Tree(HTMLParser):
    """Elements as [tag, attributes, children], children being elements and strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        element = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append([tag, {k: v or "" for k, v in attrs}, []])

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)


def noisy(element) -> bool:
    names = f"{element[1].get('class', '')} {element[1].get('id', '')}".lower()
    return element[0] in NOISE or any(n in names for n in V.NOISE_NAMES)


def visible(element) -> list[str]:
    """Pieces of text of an element without noise, without recursion."""
    out, todo = [], [element]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is element or not noisy(x):
            if x[0] in BLOCKS:
                todo.append("\n")
            todo += reversed(x[2])
            if x[0] in BLOCKS:
                todo.append("\n")
    return out


def found(root, test):
    """First element, in document order and outside noise, that passes."""
    todo = [root]
    while todo:
        x = todo.pop()
        if x is not root and test(x):
            return x
        todo += [c for c in reversed(x[2]) if not isinstance(c, str) and not noisy(c)]
    return None


MAIN_TESTS = [lambda x: x[0] == "article", *[(lambda x, c=c: c in x[1].get("class", "").split()) for c in V.MAIN_CLASSES], lambda x: x[0] == "main"]


def main_text(html: str | None) -> str:
    """Text of the first likely main element that is long enough, else of the body, without noise."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    for test in MAIN_TESTS:
        element = found(tree.root, test)
        if element and len(" ".join("".join(visible(element)).split())) >= V.MIN_MAIN:
            break
    else:
        element = found(tree.root, lambda x: x[0] == "body") or tree.root
    return "".join(visible(element))


def html_text(html: Column) -> Column:
    """In Python, a hundred rows at a time: a parser's state has no built-in counterpart."""
    return F.udf(plain_text, "string", useArrow=False)(html)


def main_content(html: Column) -> Column:
    return clean_markdown(F.udf(main_text, "string", useArrow=False)(html))


# --- native: titles, dates, addresses ---

ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def decoded(c: Column) -> Column:
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first such element, white space collapsed; null if there is none or it is empty."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.nullif(T.one_spaced(decoded(F.regexp_replace(inner, "<[^>]*>", " "))), F.lit(""))


def meta_content(html: Column, attribute: str, value: str) -> Column:
    tag = F.regexp_extract(html, rf"(?is)<meta\b[^>]*\b{attribute}=[\"']{re.escape(value)}[\"'][^>]*>", 0)
    return F.nullif(T.strip(decoded(F.regexp_extract(tag, r"(?is)\bcontent=[\"']([^\"']*)[\"']", 1))), F.lit(""))


def page_title(html: Column) -> Column:
    return F.coalesce(tag_text(html, "h1"), meta_content(html, "property", "og:title"), tag_text(html, "title"), F.lit(V.NO_TITLE))


def published_at(html: Column) -> Column:
    """From the first of three meta tags, else a time element's attribute or text; null if none has it."""
    time = F.nullif(T.strip(F.regexp_extract(html, r"(?is)<time\b[^>]*\bdatetime=[\"']([^\"']*)[\"']", 1)), F.lit(""))
    return F.coalesce(meta_content(html, "property", "article:published_time"), meta_content(html, "name", "date"), meta_content(html, "name", "publish_date"), time, tag_text(html, "time"))


def allowed(url: Column, domains: list[str] | None = None) -> Column:
    """Whether a page may be read: http or https, and one of the domains if any are given."""
    good = F.coalesce(T.url_scheme(url).isin("http", "https"), F.lit(False))
    return good & F.coalesce(T.url_host(url).isin(*domains), F.lit(False)) if domains else good


#: Content types that are read, and the charset where none is given.
READ_TYPES, CHARSET = ("text/html", "text/plain"), "utf-8"


def decoded_bodies(responses: DataFrame, body: str = "body", content_type: str = "content_type", out: str = "html") -> DataFrame:
    """``responses`` (bytes and the Content-Type header) with the body as text: rows of other types than HTML and plain text go, and so do unknown charsets; bytes that can't be decoded become replacement characters."""
    header = F.split(F.lower(F.coalesce(F.col(content_type), F.lit(""))), ";", 2)
    kind = F.trim(header[0])
    charset = F.coalesce(F.nullif(F.regexp_extract(F.col(content_type), r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1), F.lit("")), F.lit(CHARSET))

    def run(bodies: pa.Array, charsets: pa.Array) -> pa.Array:
        made = []
        for b, c in zip(bodies, charsets, strict=True):
            try:
                made.append(None if b.as_py() is None else b.as_py().decode(c.as_py(), errors="replace"))
            except LookupError:
                made.append(None)
        return pa.array(made, pa.string())

    run.__annotations__ = {"bodies": pa.Array, "charsets": pa.Array, "return": pa.Array}
    read = responses.where(kind.isin(*READ_TYPES)).withColumn(out, F.arrow_udf(run, "string")(F.col(body), charset))
    return read.where(F.col(out).isNotNull())


@lru_cache(4096)
def rules(text: str) -> RobotFileParser:
    made = RobotFileParser()
    made.parse(text.splitlines())
    made.modified()
    return made


def robots_allowed(pages: DataFrame, robots: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """``pages`` that the rules of their site let ``agent`` read.

    robots: (site, robots), the text of each site's robots.txt, '' where it has none; site is scheme://host:port as the
    address gives it. Sites without a row can't be verified, so their pages go. One row a site counts.
    """

    def run(texts: pa.Array, urls: pa.Array) -> pa.Array:
        return pa.array([t.as_py() is not None and rules(t.as_py()).can_fetch(agent, u.as_py()) for t, u in zip(texts, urls, strict=True)])

    run.__annotations__ = {"texts": pa.Array, "urls": pa.Array, "return": pa.Array}
    site = F.lower(F.regexp_extract(F.col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    own = robots.select(F.lower("site").alias("robots__site"), F.col("robots").alias("robots__text")).where("robots__text is not null").dropDuplicates(["robots__site"])
    joined = pages.where(allowed(F.col(url))).withColumn("robots__of", site).join(own, F.col("robots__of") == F.col("robots__site"))
    return joined.where(F.arrow_udf(run, "boolean")(F.col("robots__text"), F.col(url))).select(*pages.columns)


def page_documents(pages: DataFrame, url: str = "url", html: str = "html", retrieved_at: str = "", extra: list[str] = (), min_length: int = V.MIN_PAGE) -> DataFrame:  # type: ignore[assignment]
    """(doc_id, title, source_url, content, metadata, markdown) of pages that may be read and have enough text.

    extra: columns to keep as metadata where they have a value and a plain name.
    """
    rows = pages.where(allowed(F.col(url))).withColumn("content__", html_text(F.col(html))).where(F.length("content__") >= min_length)
    title = tag_text(F.col(html), "title")
    doc_id = T.url_slug(F.coalesce(F.nullif(T.url_stem(F.col(url)), F.lit("")), title, F.lit("")))
    rows = rows.select("*", doc_id.alias("doc_id__"), F.coalesce(title, F.initcap(F.replace(doc_id, F.lit("-"), F.lit(" ")))).alias("title__"))
    known = [("doc_id", F.col("doc_id__")), ("title", F.col("title__")), ("source_url", F.col(url)), ("retrieved_at", F.lit(retrieved_at)), ("document_version", F.lit("not-stated"))]
    known += [(c, F.col(c).cast("string")) for c in extra if re.match(V.METADATA_KEY, c)]
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in known]), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return rows.select(F.col("doc_id__").alias("doc_id"), F.col("title__").alias("title"), F.col(url).alias("source_url"), F.col("content__").alias("content"), F.map_from_entries(entries).alias("metadata"), markdown_document(entries, F.col("title__"), F.col("content__")).alias("markdown"))
