"""Headings and sections of single texts, in plain Python functions: Spark hands a worker a hundred rows at a time, where an Arrow batch of 10,000 long texts and their sections takes half a gigabyte.

What a line means depends on the lines before it, so a text is read line by line; a row's result depends on that row alone,
and nothing is shuffled. Names, numbers and slugs are left as they stand in the text: callers clean them with Columns.

Defined results: a null or empty text has no sections and normalises to ''.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

MARKDOWN = re.compile(V.MARKDOWN)


@dataclass(frozen=True)
class Heading:
    """A kind of heading: its pattern (group 1 the text, ``number`` the group of its number), its level in the path, and its first letter in either case."""

    kind: str
    pattern: str
    level: int
    letter: str
    number: int = 0


POLICY = (Heading("chapter", V.CHAPTER, 2, "C", 2), Heading("section", V.SECTION, 3, "M", 2), Heading("article", V.ARTICLE, 4, "Đ", 2), Heading("clause", V.CLAUSE, 5, "K", 2))
PLAIN = (Heading("chapter", V.PLAIN_CHAPTER, 20, "C"), Heading("section", V.PLAIN_SECTION, 30, "M"), Heading("article", V.PLAIN_ARTICLE, 40, "Đ"))
PARTS = ("chapter", "article", "clause")


def ended_by(kind: str, level: int) -> tuple[str, ...]:
    """Parts that a heading brings to an end."""
    if kind == "markdown":
        return PARTS if level <= 2 else PARTS[1:] if level <= 4 else ()
    return {"chapter": PARTS, "section": PARTS[1:], "article": PARTS[1:], "clause": PARTS[2:]}[kind]


class Reader:
    """Sections of texts whose headings are Markdown's and those of ``kinds``."""

    def __init__(self, kinds: tuple[Heading, ...], markdown_first: bool):
        self.kinds = [(h, re.compile(h.pattern, re.IGNORECASE)) for h in kinds]
        self.markdown_first = markdown_first
        self.maybe = frozenset("#*" + "".join(h.letter.lower() + h.letter for h in kinds))

    def heading(self, line: str) -> tuple[str, int, str, str | None] | None:
        """(kind, level, name, number) of a stripped line."""
        if not line or line[0] not in self.maybe:  # most lines need no other test
            return None
        marked = MARKDOWN.match(line)
        if marked and self.markdown_first:
            return "markdown", len(marked[1]), marked[2], None
        for h, pattern in self.kinds:
            if m := pattern.match(line):
                return h.kind, h.level, m[1], m[h.number] if h.number else None
        return ("markdown", len(marked[1]), marked[2], None) if marked else None

    def sections(self, text: str | None) -> list[dict]:
        found: list[dict] = []
        path: dict[int, str] = {}
        parts: dict[str, tuple[str, str | None]] = {}
        deep = title = opened = None
        number, body = 0, []

        def close() -> None:
            nonlocal opened
            whole = "\n".join(body).strip()
            body.clear()
            if not whole:
                return
            if not found:
                opened = title
            here = {k: parts.get(k, (None, None)) for k in PARTS}
            found.append({"section_ord": number, "body": whole, "path": [path[n] for n in sorted(path)], "deep": deep, "doc_title": opened} | {k: v[0] for k, v in here.items()} | {f"{k}_number": v[1] for k, v in here.items()})

        for line in (text or "").splitlines():
            read = self.heading(line.strip())
            if read is None:
                body.append(line)
                continue
            close()
            number += 1
            kind, level, name, label = read
            path = {n: x for n, x in path.items() if n < level} | {level: name}
            parts = {k: v for k, v in parts.items() if k not in ended_by(kind, level)} | ({kind: (name, label)} if kind in PARTS else {})
            deep = name if kind == "markdown" and level > 1 else None
            if title is None and kind == "markdown" and level == 1:
                title = name
        close()
        return found


@lru_cache(2)
def reader(advanced: bool) -> Reader:
    return Reader(POLICY, False) if advanced else Reader(PLAIN, True)


NAMED = [n for k in PARTS for n in (k, f"{k}_number")]
SECTION_DDL = "array<struct<section_ord: int, body: string, path: array<string>, " + ", ".join(f"{n}: string" for n in NAMED) + ", deep: string, doc_title: string>>"


def outline(text: Column, advanced: bool = True) -> Column:
    """The sections that hold text, in order: section_ord (the number of headings up to it), body, path (active headings from
    the top level down), chapter, article and clause with their numbers, deep (the last Markdown heading below level 1, if
    no other heading came after it) and doc_title (the first level-1 heading, if it stands before any text)."""

    return F.udf(lambda t: reader(advanced).sections(t), SECTION_DDL, useArrow=False)(text)


def unwrapped(title: str) -> str:
    """A heading without emphasis around all of it and without hashes at its end."""
    for mark in ("**", "*"):
        if title.startswith(mark) and title.endswith(mark) and len(title) > 2 * len(mark):
            title = title[len(mark) : -len(mark)].strip()
            break
    return re.sub(r"\s+#+$", "", title).strip()


def with_plain_headings(text: str | None) -> str:
    """Markdown headings without emphasis; one that repeats the heading before it, with only blank or banner lines between, goes."""
    out: list[str] = []
    before = None  # the heading that the next one would repeat
    for line in (text or "").splitlines():
        bare = line.strip()
        read = MARKDOWN.match(bare) if bare.startswith("#") else None
        if read is None:
            if bare and bare.lower() not in V.BANNERS:
                before = None
            out.append(line)
            continue
        title = unwrapped(read[2].strip())
        if before != (now := (read[1], title.lower())):
            out.append(f"{read[1]} {title}")
        before = now
    return "\n".join(out)


def normalize_headings(text: Column) -> Column:
    return F.udf(with_plain_headings, "string", useArrow=False)(text)
