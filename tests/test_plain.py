"""Queries without SQL against plain Python over the whole smallest tables, and rows whose keys repeat or are null."""

import hashlib
import html
import random
import re
from urllib.parse import urlparse

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from docloom.functions import values as V
from docloom.operators import chunking as C
from docloom.operators import cleaning as L
from docloom.plans import catalog, documents

from test_chunking import directly, windows

md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
rows_of = lambda df, *names: sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


# --- sections, by looking back from each line ---

KINDS = [("chapter", V.CHAPTER, 2, 2), ("section", V.SECTION, 3, 2), ("article", V.ARTICLE, 4, 2), ("clause", V.CLAUSE, 5, 2)]
PLAIN = [("chapter", V.PLAIN_CHAPTER, 20, 0), ("section", V.PLAIN_SECTION, 30, 0), ("article", V.PLAIN_ARTICLE, 40, 0)]


def cleaned(name):
    name = re.sub(r"^#+\s*", "", name.strip())
    name = re.sub(r"\[([^\]]+)\]\([^\)]+\)", r"\1", name)
    return " ".join(re.sub(r"[*_]", "", name).split())


def slugged(name, most):
    folded = name.lower()
    for plain, letters in V.ACCENTED.items():
        for letter in letters:
            folded = folded.replace(letter, plain)
    return re.sub(r"[^a-z0-9]+", "_", folded).strip("_")[:most].rstrip("_") or "sec"


def labelled(number):
    number = number.strip()
    if number.isdigit():
        return number
    if re.fullmatch("[IVXLCDM]+", number.upper()):
        values, total = [V.ROMAN[c] for c in number.upper()], 0
        for k, v in enumerate(values):
            total += -v if any(w > v for w in values[k + 1 :]) else v
        return str(total)
    return re.match("([0-9]+[a-zA-Z]?)", number)[1].lower() if number[:1].isdigit() else slugged(number, 20)


def heading(line, policy):
    line = line.strip()
    marked = re.match(V.MARKDOWN, line)
    found = [(kind, level, m[1], m[n] if n else None) for kind, p, level, n in (KINDS if policy else PLAIN) if (m := re.match(p, line, re.IGNORECASE))]
    own = [("markdown", len(marked[1]), marked[2], None)] if marked else []
    return next(iter(found + own if policy else own + found), None)


def plain_sections(text, policy):
    lines = text.splitlines()
    heads = [heading(x, policy) for x in lines]
    at = [k for k, h in enumerate(heads) if h]
    clean = cleaned if policy else (lambda x: " ".join(re.sub(r"\*\*|__", "", x).split()))
    out = []
    for n, begin in enumerate([-1, *at]):
        end = at[n] if n < len(at) else len(lines)
        body = "\n".join(lines[begin + 1 : end]).strip()
        if not body:
            continue
        before, path, level = [heads[k] for k in at[:n]][::-1], [], 99
        for h in before:  # from the nearest heading up
            if h[1] < level:
                path, level = [clean(h[2]), *path], h[1]
        path = [p for p in path if p]
        section = {"ord": n, "body": body, "path": [p for k, p in enumerate(path) if not k or p.casefold() != path[k - 1].casefold()]}
        for kind, ends in (("chapter", 2), ("article", 4), ("clause", 4)):
            above = {"chapter": (), "article": ("chapter", "section"), "clause": ("chapter", "section", "article")}[kind]
            own = next((h for h in before if h[0] == kind or h[0] in above or h[0] == "markdown" and h[1] <= ends), None)
            section[kind] = labelled(own[3]) if own and own[0] == kind and policy else None
        section["slug"] = slugged(clean(before[0][2]), 25) if before and before[0][0] == "markdown" and before[0][1] > 1 else None
        section["titles"] = [clean(h[2]) for h in before[::-1] if h[0] == "markdown" and h[1] == 1]
        out.append(section)
    return out


def split(text, room, separators, overlap=0):
    return [text] if len(text) <= room else directly(text, room, separators, overlap, True)


def chunk_name(doc, s, part):
    tail = f"clause_{s['clause']}" if s["clause"] else f"sec_{s['slug']}" if s["slug"] and not s["article"] and not s["chapter"] else None
    names = [doc, s["chapter"] and f"chapter_{s['chapter']}", s["article"] and f"article_{s['article']}", tail, f"part_{part}"]
    return "__".join(x for x in names if x)


def plain_chunks(doc, text, size, prefixed=True, least=200):
    """(section, chunk id, part, parts, prefix, content) of the heading chunker."""
    sections = plain_sections(text, True)
    title = (sections[0]["titles"][:1] if sections else []) or [doc]
    out = []
    for s in sections:
        path = s["path"][1:] if s["path"] and s["path"][0].casefold() == title[0].casefold() else s["path"]
        prefix = "[SECTION]\n" + " > ".join([f"Document: {title[0]}", *path])
        parts = split(s["body"], max(least, size - len(prefix) - 2) if prefixed else size, C.ADVANCED)
        out += [(s["ord"], chunk_name(doc, s, k), k, len(parts), prefix, p) for k, p in enumerate(parts, 1)]
    return out


@pytest.fixture(scope="module")
def policies(spark):
    return {r.doc_id: r.text for r in documents.policies(spark, DATA).collect()}


def test_heading_chunks(spark, policies):
    want = [(i, n, name, k, of, len(t := f"{prefix}\n\n{p}"), md5(t)) for i, text in policies.items() for n, name, k, of, prefix, p in plain_chunks(str(i), text, 1000)]
    assert rows_of(catalog.QUERIES["heading_chunks"](spark, DATA), "doc_id", "section_ord", "chunk_id", "part_index", "total_parts", "chars", "md5") == sorted(want, key=str)


def test_section_chunks(spark, policies):
    want = []
    for i, text in policies.items():
        for s in plain_sections(text, False):
            prefix = "[SECTION]\n" + " > ".join(s["path"]) if s["path"] else ""
            whole = f"{prefix}\n\n{s['body']}" if prefix else s["body"]
            parts = [s["body"]] if len(whole) <= 1000 else directly(s["body"], max(200, 1000 - (len(prefix) + 2 if prefix else 0)), C.SECTIONED)
            want += [(i, s["ord"], k, len(parts), len(t := f"{prefix}\n\n{p.strip()}" if prefix else p.strip()), md5(t)) for k, p in enumerate(parts, 1)]
    assert rows_of(catalog.QUERIES["section_chunks"](spark, DATA), "doc_id", "section_ord", "part_index", "total_parts", "chars", "md5") == sorted(want, key=str)


def test_parents_and_children(spark, policies):
    children, parents = [], {}
    for i, text in policies.items():
        for n, name, _, _, prefix, p in plain_chunks(str(i), text, 1800, False, 300):
            kids = split(p, 450, C.ADVANCED, 60)
            children += [(i, n, name, f"{name}__child_{k}", k, len(kids), len(t := f"{prefix}\n\n{c}"), md5(t)) for k, c in enumerate(kids, 1)]
            parents.setdefault(name, []).append((n, f"{name}__child_1", p))
    assert rows_of(catalog.QUERIES["parent_child_chunks"](spark, DATA), "doc_id", "section_ord", "parent_id", "chunk_id", "child_index", "total_children", "chars", "md5") == sorted(children, key=str)
    want = sorted((name, len(first[2]), md5(first[2])) for name, found in parents.items() for first in [min(found)])
    got = rows_of(catalog.QUERIES["parent_texts"](spark, DATA), "parent_id", "chars", "md5")
    assert [x[0] for x in got] == [x[0] for x in want]
    assert all((n, m) in {(len(p), md5(p)) for _, _, p in parents[name]} for name, n, m in got)


def test_recursive_and_compared_strategies(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = [(i, k, len(parts), len(p), md5(p)) for i, t in texts.items() for parts in [directly(t or "", 500, C.RECURSIVE)] for k, p in enumerate(parts, 1)]
    assert rows_of(catalog.QUERIES["recursive_chunks"](spark, DATA), "doc_id", "part_index", "total_parts", "chars", "md5") == sorted(want, key=str)

    def by_sentences(t):
        found = [s.strip() for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s.strip()]
        return [" ".join(found[k : k + 3]) for k in range(0, len(found), 3)]

    ways = {"fixed_size": lambda t: windows(t, 200, 0), "by_sentences": by_sentences, "recursive": lambda t: directly(t, 200, C.RECURSIVE)}
    got = {r.strategy: (r["count"], r.avg_length) for r in catalog.QUERIES["strategy_compare"](spark, DATA).collect()}
    for name, way in ways.items():
        parts = [p for t in texts.values() if t for p in way(t)]
        assert got[name] == (len(parts), round(sum(map(len, parts)) / len(parts), 6))


# --- pages, by their tags one after another ---


def tags(page):
    """("text", it) and ("open" or "close", tag, attributes) in order; what stands in scripts and styles is not text."""
    at, out = 0, []
    for m in re.finditer(r"<!--.*?-->|<!DOCTYPE[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>", page, re.DOTALL):
        if m.start() < at:
            continue
        out.append(("text", html.unescape(page[at : m.start()]), ""))
        at = m.end()
        if m[2]:
            out.append(("close" if m[1] else "open", m[2].lower(), m[3]))
            if m[2].lower() in ("script", "style") and not m[1]:
                at = page.find(f"</{m[2]}", at)
    return [*out, ("text", html.unescape(page[at:]), "")]


def visible(page):
    hidden, out = 0, []
    for kind, x, _ in tags(page):
        if kind == "text":
            out.append("" if hidden else x)
            continue
        opened = kind == "open"
        if x in V.SKIP_TAGS:
            hidden = max(0, hidden + (1 if opened else -1))
        elif x in V.BLOCK_TAGS and not hidden:
            out.append("\n")
    text = re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+", " ", "".join(out)))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def test_html_text(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    want = sorted(((r.page_id, len(t), md5(t)) for r in pages for t in [visible(r.html)]), key=str)
    assert rows_of(catalog.QUERIES["html_text"](spark, DATA), "page_id", "chars", "md5") == want


def held(page, element):
    """What the first such element holds, without what its noisy elements do; elements that nothing closes end with it."""
    inside, noisy, out, depth = False, 0, [], []
    for kind, x, attributes in tags(page):
        if kind == "open" and x == element and not inside:
            inside = True
            out.append("\n" if element in V.BLOCK_TAGS else "")
            continue
        if not inside:
            continue
        if kind == "text":
            out.append("" if noisy else x)
        elif kind == "close" and x == element:
            break
        elif kind == "open":
            names = " ".join(re.findall(r"(?:class|id)=\"([^\"]*)\"", attributes)).lower()
            if x != "br":
                depth.append((x, x in V.NOISE_TAGS or any(n in names for n in V.NOISE_NAMES)))
                noisy += depth[-1][1]
            if x in V.BLOCK_TAGS and not noisy:
                out.append("\n" if x != "br" else "\n\n")
        elif any(d[0] == x for d in depth):
            while depth:
                name, bad = depth.pop()
                if name in V.BLOCK_TAGS and not noisy:
                    out.append("\n")
                noisy -= bad
                if name == x:
                    break
    while depth:
        name, bad = depth.pop()
        if name in V.BLOCK_TAGS and not noisy:
            out.append("\n")
        noisy -= bad
    return "".join(out) + ("\n" if element in V.BLOCK_TAGS else "")


def test_main_content(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    want = []
    for r in pages:
        text = held(r.html, "article")
        text = text if len(" ".join(text.split())) >= V.MIN_MAIN else held(r.html, "body")
        text = re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+\n", "\n", text.replace(" ", " ")))
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r"(?im)^\s*image\s*:?.*$", "", text)).strip()
        want.append((r.page_id, len(text), md5(text)))
    assert rows_of(catalog.QUERIES["main_content"](spark, DATA), "page_id", "chars", "md5") == sorted(want, key=str)


def test_page_documents(spark):
    want = []
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        url, text = urlparse(r.url), visible(r.html)
        if url.scheme not in ("http", "https") or len(text) < V.MIN_PAGE:
            continue
        title = " ".join(html.unescape(re.search(r"<title>(.*?)</title>", r.html, re.DOTALL)[1]).split())
        stem = re.sub(r"(?<=.)\.[^.]*$", "", url.path.rstrip("/").rsplit("/", 1)[-1])
        doc_id = re.sub(r"[^a-z0-9]+", "-", (stem or title).lower().strip()).strip("-") or "document"
        known = [("doc_id", doc_id), ("title", title), ("source_url", r.url), ("retrieved_at", "2024-01-02"), ("document_version", "not-stated"), ("page_id", str(r.page_id))]
        quoted = lambda v: '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        markdown = "---\n" + "\n".join(f"{k}: {quoted(v)}" for k, v in known if v) + f"\n---\n\n# {title}\n\n{text}\n"
        want.append((doc_id, title, r.url, len(text), md5(markdown)))
    assert len(want) > 20
    assert rows_of(catalog.QUERIES["page_documents"](spark, DATA), "doc_id", "title", "source_url", "chars", "md5") == sorted(want, key=str)


# --- keys that repeat or are null ---


def test_rows_that_share_keys_stay_apart(spark):
    texts = ["# A\none\n# A\n# A\n## B\ntwo", "# C\nthree\nTrang chủ > x\n# C\n\n# C", "plain text", "# A\none\n# A\n# A\n## B\ntwo"]
    df = spark.createDataFrame([(1, texts[0], "p"), (1, texts[1], "q"), (None, texts[2], "r"), (1, texts[3], "p"), (None, None, "s")], "id int, text string, body string").repartition(3)
    got = sorted((r.id is None, r.body, r.text) for r in L.clean_documents(df, "id", "text").collect())
    assert got == [(False, "p", "# A\none\n# A\n## B\ntwo\n"), (False, "p", "# A\none\n# A\n## B\ntwo\n"), (False, "q", "# C\nthree\n# C\n"), (True, "r", "plain text\n"), (True, "s", "")]
    found = sorted((str(r.id), r.body, r.path) for r in C.sections(df.select("id", "text"), "id", "text").collect())
    assert found == sorted([("1", "one", ["A"]), ("1", "two", ["A", "B"]), ("1", "one", ["A"]), ("1", "two", ["A", "B"]), ("1", "three\nTrang chủ > x", ["C"]), ("None", "plain text", [])])
    chunks = C.heading_chunks(df.select("id", "text", F.lit("T").alias("name")), "id", "text", "name")
    assert chunks.count() == 6 and {r.title for r in chunks.collect()} == {"T"}
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # no text is shuffled for its sections


def test_random_outlines(spark):
    """Sections against looking back from each line, on lines in random order."""
    rng = random.Random(7)
    pieces = ["# Một", "## CHƯƠNG II: Hai", "### Điều 6. Ba", "#### Khoản 1. Bốn", "Mục 3 Năm", "chương iv", "**Điều 12a. X**", "###### sâu", "##### [a](b) _c_", "text", "  more text ", "", "* list", "#no", "Khoản", "Điều khoản"]
    texts = ["\n".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for policy in (True, False):
        got = sorted((r.id, r.section_ord, r.body, tuple(r.path)) for r in C.sections(df, "id", "text", advanced=policy).collect())
        assert got == sorted((k, s["ord"], s["body"], tuple(s["path"])) for k, t in enumerate(texts) for s in plain_sections(t, policy))
    chunks = sorted((r.id, r.section_ord, r.chunk_id) for r in C.heading_chunks(df, "id", "text").collect())
    assert chunks == sorted((k, n, name) for k, t in enumerate(texts) for n, name, *_ in plain_chunks(str(k), t, 1000))
