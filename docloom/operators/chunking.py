"""Chunking: arrays of pieces of a text, and rows of sections and chunks of structured documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import structure as S
from ..functions import text as T

STRINGS = "array<string>"
RECURSIVE = ("\n\n", "\n", ". ", " ", "")
SECTIONED = ("\n\n", "\n", ". ", "; ", ", ", " ", "")
ADVANCED = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")


def none() -> Column:
    return F.array().cast(STRINGS)


# --- flat chunkers: Column -> array<string> ---


def fixed(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of ``size`` characters, each ``size - overlap`` after the one before; none that only repeats an end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step, n = size - overlap, F.length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(text, k * step + 1, F.lit(size)))
    return F.when(F.coalesce(n, F.lit(0)) > 0, cut).otherwise(none())


def sentences(text: Column) -> Column:
    """Stripped, without empty ones; a sentence ends at . ! or ? before white space."""
    parts = F.transform(F.split(T.strip(text), r"(?<=[.!?])\s+", -1), T.strip)
    return F.filter(parts, lambda s: s != "")


def by_sentences(text: Column, most: int = 3) -> Column:
    most = max(1, most)

    def grouped(whole):
        groups = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / F.lit(most)).cast("int"))
        return F.when(F.size(whole) > 0, F.transform(groups, lambda k: F.array_join(F.slice(whole, k * most + 1, F.lit(most)), " "))).otherwise(none())

    return T.let(sentences(text), grouped)


def packed(text: str, separator: str, size: int) -> list[str]:
    """The parts between separators, joined again as long as they fit."""
    out: list[str] = []
    for part in filter(None, map(str.strip, text.split(separator))):
        if out and len(out[-1]) + len(separator) + len(part) <= size:
            out[-1] += separator + part
        else:
            out.append(part)
    return out


def pieces(text: str | None, size: int, separators: tuple[str, ...], overlap: int = 0, stripped: bool = False) -> list[str]:
    """``text`` in pieces of ``size`` characters at most: separator by separator, what is still too long is taken apart and packed; at the empty separator, or the end, it is cut.

    stripped: cut pieces lose white space at their ends.
    """
    found = [text.strip()] if text and text.strip() else []
    for separator in separators:
        if not separator or all(len(x) <= size for x in found):
            break
        found = [y for x in found for y in (packed(x, separator, size) if len(x) > size and separator in x else [x])]
    step, out = size - overlap if size > overlap else size, []
    for x in found:
        if len(x) <= size:
            out.append(x)
            continue
        last = max(0, -(-(len(x) - size) // step)) if overlap else (len(x) - 1) // size
        cut = [x[k * step : k * step + size] for k in range(last + 1)]
        out += [y.strip() if stripped else y for y in cut if y.strip()]
    return out


def recursive(text: Column, size: int | Column = 500, separators: tuple[str, ...] = RECURSIVE, overlap: int = 0, stripped: bool = False) -> Column:
    """``pieces``, a hundred rows at a time: the packing depends on everything packed before, which no built-in does without copying its result at each step."""
    run = F.udf(lambda t, n: pieces(t, n, separators, overlap, stripped), STRINGS, useArrow=False)
    return run(text, size if isinstance(size, Column) else F.lit(size))


def strategies(text: Column, size: int = 200) -> dict[str, Column]:
    return {"fixed_size": fixed(text, size, 0), "by_sentences": by_sentences(text, 3), "recursive": recursive(text, size)}


def chunk_stats(df: DataFrame, chunks: Column, by: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Number of chunks and their mean length, 0 without any."""
    return df.select(*by, F.explode_outer(chunks).alias("chunk")).groupBy(*by).agg(F.count("chunk").alias("count"), F.coalesce(F.avg(F.length("chunk")), F.lit(0.0)).alias("avg_length"))


def compare(df: DataFrame, text: Column, size: int = 200) -> DataFrame:
    """chunk_stats of each strategy."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), c.alias("chunks")) for n, c in strategies(text, size).items()])).alias("s"))
    return chunk_stats(rows.select("s.strategy", "s.chunks"), F.col("chunks"), ["strategy"])


def exploded(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """A row a chunk with ``part_index`` from 1 and ``total_parts``."""
    # an outer explode: an inner one makes Spark infer a filter that computes the chunks a second time
    rows = df.withColumn("pieces__", chunks).select(*keep, F.size("pieces__").alias("total_parts"), F.posexplode_outer("pieces__").alias("part_index", "content")).where("content is not null")
    return rows.withColumn("part_index", F.col("part_index") + 1)


# --- sections ---


def unrepeated(path: Column) -> Column:
    return F.filter(path, lambda x, k: (k == 0) | (T.folded(x) != T.folded(F.element_at(path, F.greatest(k, F.lit(1))))))


def sections(docs: DataFrame, key: str, text: str, advanced: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., section_ord, path, body[, chapter, chapter_number, article, ..., slug, doc_title]) of sections with text.

    A document is read whole, in its own row: nothing is shuffled, and rows that share a key, or have none, stay apart.
    """
    own = [key, *keep]
    # an outer explode: an inner one makes Spark infer a filter that reads the texts a second time
    rows = docs.select(*own, F.explode_outer(S.outline(F.col(text), advanced)).alias("s__")).where("s__ is not null").select(*own, "s__.*")
    clean = T.clean_heading if advanced else T.plain_heading
    path = F.filter(F.transform("path", lambda x: T.strip(clean(x))), lambda x: x != "")
    named = [F.col("section_ord"), F.col("body")]
    if advanced:
        named += [c for k in S.PARTS for c in (clean(F.col(k)).alias(k), F.when(F.col(f"{k}_number").isNotNull(), T.number_label(F.col(f"{k}_number"))).alias(f"{k}_number"))]
        named += [F.when(F.col("deep").isNotNull(), T.slug(clean(F.col("deep")), 25)).alias("slug"), clean(F.col("doc_title")).alias("doc_title")]
    return rows.select(*own, *named, path.alias("path")).withColumn("path", unrepeated(F.col("path")))


# --- prefixes and ids ---


def section_prefix(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.concat(F.lit("[SECTION]\n"), F.array_join(path, " > "))).otherwise("")


def context_prefix(title: Column, path: Column) -> Column:
    """[SECTION] with document title and path, which doesn't begin with the title again."""
    kept = F.filter(path, lambda p: T.strip(p) != "")
    same = (F.size(kept) > 0) & (title != "") & (T.folded(F.coalesce(F.try_element_at(kept, F.lit(1)), F.lit(""))) == T.folded(title))
    kept = F.when(same, F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
    start = F.when(title != "", F.array(F.concat(F.lit("Document: "), title))).otherwise(none())
    whole = F.array_join(F.concat(start, kept), " > ")
    return F.concat(F.lit("[SECTION]\n"), F.when(whole != "", whole).otherwise("Document"))


def chunk_id(doc: Column, chapter: Column, article: Column, clause: Column, slug: Column, part: Column) -> Column:
    name = F.coalesce(F.nullif(F.btrim(F.regexp_replace(doc, r"[^a-zA-Z0-9_\-]+", "_"), F.lit("_")), F.lit("")), F.lit("doc"))
    tail = F.when(clause.isNotNull(), F.concat(F.lit("clause_"), clause)).when(article.isNull() & chapter.isNull() & slug.isNotNull(), F.concat(F.lit("sec_"), slug))
    return F.concat_ws("__", name, F.concat(F.lit("chapter_"), chapter), F.concat(F.lit("article_"), article), tail, F.concat(F.lit("part_"), part.cast("string")))


# --- chunkers of structured documents: rows of chunks ---


def section_chunks(docs: DataFrame, key: str, text: str, size: int = 1000) -> DataFrame:
    """(key, section_ord, part_index, total_parts, content): each section under its path, long ones in parts; only the body is split, so a chunk may exceed ``size``."""
    size = max(200, size)
    rows = sections(docs, key, text, advanced=False).withColumn("prefix", section_prefix(F.col("path")))
    whole = F.when(F.col("prefix") != "", F.concat_ws("\n\n", "prefix", "body")).otherwise(F.col("body"))
    room = F.greatest(F.lit(200), size - F.when(F.col("prefix") != "", F.length("prefix") + 2).otherwise(0))
    parts = F.when(F.length(whole) <= size, F.array("body")).otherwise(recursive(F.col("body"), room, SECTIONED))
    out = exploded(rows, parts, [key, "section_ord", "prefix"])
    content = T.strip(F.col("content"))
    return out.withColumn("content", F.when(F.col("prefix") != "", F.concat(F.col("prefix"), F.lit("\n\n"), content)).otherwise(content)).drop("prefix")


def heading_chunks(docs: DataFrame, key: str, text: str, title: str | None = None, size: int = 1000, prefixed: bool = True, min_size: int = 200, separators: tuple[str, ...] = ADVANCED) -> DataFrame:
    """A row a chunk: chunk_id, content, retrieval_content, title, headings, path, part_index, total_parts.

    The title is ``title``'s, or the first level-1 heading if it stands before any text, or the id.
    """
    size = max(min_size, size)
    name = F.col(key).cast("string")
    given = docs.withColumn("title__", F.trim(F.col(title)) if title else F.lit(None).cast("string"))
    rows = sections(given, key, text, keep=("title__",))
    rows = rows.withColumn("title", F.coalesce(F.nullif("title__", F.lit("")), F.nullif("doc_title", F.lit("")), name)).drop("title__")
    rows = rows.withColumn("prefix", context_prefix(F.col("title"), F.col("path")) if prefixed else F.lit(""))
    room = F.greatest(F.lit(min_size), size - F.length("prefix") - 2) if prefixed else F.lit(size)
    parts = F.when(F.length("body") <= room, F.array("body")).otherwise(recursive(F.col("body"), room, separators, stripped=True))
    keep = [key, "section_ord", "title", "prefix", "path", *[f"{k}{n}" for k in ("chapter", "article", "clause") for n in ("", "_number")], "slug"]
    out = exploded(rows, parts, keep)
    out = out.withColumn("chunk_id", chunk_id(name, *[F.col(c) for c in ("chapter_number", "article_number", "clause_number", "slug", "part_index")]))
    return out.withColumn("retrieval_content", F.when(F.col("prefix") != "", F.concat_ws("\n\n", "prefix", "content")).otherwise(F.col("content"))).drop("prefix")


def parent_child_chunks(docs: DataFrame, key: str, text: str, title: str | None = None, parent_size: int = 2000, child_size: int = 400, overlap: int = 50) -> DataFrame:
    """Heading chunks as parents, and in each the children that are searched; overlap only where a child is cut within a word run."""
    child_size = max(100, child_size)
    overlap = min(overlap, child_size // 2)
    rows = heading_chunks(docs, key, text, title, parent_size, prefixed=False, min_size=min(300, parent_size))
    rows = rows.withColumnRenamed("chunk_id", "parent_id").withColumnRenamed("content", "parent_content").drop("retrieval_content", "part_index", "total_parts")
    parts = F.when(F.length("parent_content") <= child_size, F.array("parent_content")).otherwise(recursive(F.col("parent_content"), child_size, ADVANCED, overlap, True))
    out = exploded(rows, parts, rows.columns).withColumnsRenamed({"part_index": "child_index", "total_parts": "total_children"})
    out = out.withColumn("chunk_id", F.concat(F.col("parent_id"), F.lit("__child_"), F.col("child_index").cast("string")))
    return out.withColumn("retrieval_content", F.concat(context_prefix(F.col("title"), F.col("path")), F.lit("\n\n"), F.col("content")))


def parents_of(children: DataFrame, order: list[str]) -> DataFrame:
    """(parent_id, parent_content): the first of each id."""
    content = F.coalesce(F.nullif("parent_content", F.lit("")), "content")
    return children.groupBy("parent_id").agg(F.min_by(content, F.struct(*order)).alias("parent_content"))


def context_header(title: Column, chapter: Column, article: Column, audience: Column) -> Column:
    named = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("N/A"))
    return F.concat(F.lit("Document: "), title, F.lit(". Chapter: "), named(chapter), F.lit(". Article: "), named(article), F.lit(". Audience: "), audience, F.lit("."))


def contextual(chunks: DataFrame, doc_audience: Column | None = None, default_audience: str = "sinh viên") -> DataFrame:
    """Adds context_header and puts it before the text; the document's audience goes before the chunk's."""
    given = [F.nullif(c, F.lit("")) for c in ([doc_audience] if doc_audience is not None else []) + ([F.col("audience")] if "audience" in chunks.columns else [])]
    audience = F.coalesce(*given, F.lit(default_audience))
    out = chunks.withColumn("context_header", context_header(F.col("title"), F.col("chapter"), F.col("article"), audience)).withColumn("audience", audience)
    return out.withColumn("content", T.strip(F.col("content"))).where("content <> ''").withColumn("retrieval_content", F.concat_ws("\n\n", "context_header", "content"))


