"""Understanding of questions: kinds, filters, rewriting, decomposition and routing, as columns over a column of questions."""

from __future__ import annotations

import warnings
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

NO_STRINGS = "array<string>"


def none() -> Column:
    return F.array().cast(NO_STRINGS)


def compact(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def word(w: str) -> str:
    """A pattern of ``w`` as a whole word of any script."""
    return r"(?<![\p{L}\p{N}_])" + w + r"(?![\p{L}\p{N}_])"


# --- models ---


def asked(model, instruction: str = "{}", lines: bool = False, most: int | None = None):
    """A Column function of a question: ``model`` (a function of one text to one text) is called in Arrow batches with ``instruction``, its {} being the question.

    The answer is stripped; with ``lines`` it is a list of its lines of more than 10 characters, ``most`` at most. Where the
    model fails the value is null, so that callers fall back on their own rules.
    """

    def of(question):
        if question is None:
            return None
        try:
            said = model(instruction.replace("{}", question)).strip()
        except Exception as error:
            warnings.warn(f"the model failed: {error!r}", stacklevel=2)
            return None
        return [x.strip() for x in said.splitlines() if len(x.strip()) > 10][:most] if lines else said

    return F.pandas_udf(lambda questions: pd.Series([of(q) for q in questions], dtype=object), NO_STRINGS if lines else "string")


# --- analysis ---


def in_scope(q: Column) -> Column:
    """Short questions count as in scope."""
    return T.any_in(q, V.SCOPE) | (F.length(q) <= 5)


def kind(q: Column) -> Column:
    joints, topics = T.count_in(q, V.CONNECTORS), T.count_in(q, list(V.CATEGORY_OF))
    several = (joints >= 1) & ((topics >= 2) | (joints >= 2))
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    return (
        F.when(several, "MULTI_HOP").when(T.any_in(q, V.GLOBAL), "GLOBAL").when(T.any_in(q, V.PROCEDURAL), "PROCEDURAL")
        .when(T.any_in(q, V.FACTUAL), "FACTUAL").when(words <= 3, "AMBIGUOUS").otherwise("FACTUAL")
    )


def filters(q: Column) -> Column:
    """map<string,string>: audience (student if nothing tells), campus and department, where known."""
    found = {"audience": F.coalesce(T.first_in(q, V.AUDIENCE_OF), F.lit("student")), "campus": F.when(T.any_in(q, V.CAMPUS_WORDS), V.CAMPUS), "department": T.first_in(q, V.DEPARTMENT_OF)}
    return F.map_filter(F.create_map(*[x for k, v in found.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def entities(q: Column) -> Column:
    articles = F.transform(F.regexp_extract_all(q, F.lit(V.ARTICLE_ENTITY), F.lit(1)), lambda n: F.concat(F.lit("Điều "), n))
    numbers = F.transform(F.regexp_extract_all(q, F.lit(V.NUMBER_ENTITY), F.lit(1)), lambda n: F.concat(F.lit("số: "), n))
    return F.concat(articles, numbers, F.when(T.any_in(q, V.SEMESTERS), F.array(F.lit(V.SEMESTER_ENTITY))).otherwise(none()))


def topics(q: Column, table: dict[str, str] = V.CATEGORY_OF) -> Column:
    """Distinct, in the table's order."""
    return F.array_distinct(compact(*[F.when(F.contains(q, F.lit(k)), F.lit(v)) for k, v in table.items()]))


def formal_variants(query: Column, q: Column) -> Column:
    """The question, its formal version if that differs, and the question with its context. A word counts if the question as asked has it."""
    formal = reduce(lambda text, pair: F.when(F.contains(q, F.lit(pair[0])), F.replace(text, F.lit(pair[0]), F.lit(pair[1]))).otherwise(text), V.FORMAL_SHORT.items(), q)
    return compact(query, F.nullif(formal, q), F.concat(F.lit(V.ENRICHED_START), query))


def simple_parts(q: Column) -> Column:
    parts = F.filter(F.transform(F.split(q, V.SPLIT_SHORT, -1), T.strip), lambda p: F.length(p) > 10)
    return T.let(parts, lambda p: F.when(F.size(p) > 1, p).otherwise(F.array(q)))


def analyze(queries: DataFrame, query: str = "query") -> DataFrame:
    """Adds query_type, confidence, filters, entities, topics, rewritten and decomposed; questions out of scope get nothing but their type."""
    df = queries.withColumn("q__", F.lower(T.strip(F.col(query)))).withColumn("in__", in_scope(F.col("q__")))
    q, here = F.col("q__"), F.col("in__")
    df = df.withColumn("query_type", F.when(here, kind(q)).otherwise("OUT_OF_SCOPE"))
    df = df.withColumn("filters", F.when(here, filters(q)).otherwise(F.create_map().cast("map<string,string>")))
    for name, value in {"entities": entities(q), "topics": topics(q), "rewritten": formal_variants(F.col(query), q)}.items():
        df = df.withColumn(name, F.when(here, value).otherwise(none()))
    df = df.withColumn("decomposed", F.when(F.col("query_type") == "MULTI_HOP", simple_parts(q)).otherwise(none()))
    sure = 0.5 + 0.1 * F.least(F.size("topics"), F.lit(3)) + F.when(F.size("entities") > 0, 0.1).otherwise(0.0) + F.when(F.size(F.map_keys("filters")) > 0, 0.1).otherwise(0.0)
    return df.withColumn("confidence", F.when(here, F.least(sure, F.lit(1.0))).otherwise(0.3)).drop("q__", "in__")


# --- rewriting ---


def rewrite(query: Column, llm=None) -> Column:
    """In formal words: replacements are made in order, each in what the ones before have left. llm: a Column function that is used instead where it gives a value."""
    formal = T.let(T.replaced_in_turn(F.lower(query), V.FORMAL), lambda x: F.when(x != "", T.capitalized(x)).otherwise(x))
    return F.coalesce(llm(query), formal) if llm else formal


def enrich(query: Column) -> Column:
    """For each known word of the question, the first of its expansions that the question lacks, in brackets."""
    low = F.lower(query)
    missing = [F.when(F.contains(low, F.lit(k)), F.coalesce(*[F.when(~F.contains(low, F.lit(t.lower())), F.lit(t)) for t in terms])) for k, terms in V.EXPANSIONS.items()]
    return T.let(F.array_join(compact(*missing), ", "), lambda more: F.when(more != "", F.concat(query, F.lit(" ("), more, F.lit(")"))).otherwise(query))


def rewritten_variants(query: Column, most: int = 3, more: Column | None = None) -> Column:
    """The question and its distinct rewritten forms, then what a model gave (``more``), ``most`` besides the question."""
    own = F.array_distinct(F.array(query, rewrite(query), enrich(query), F.concat(F.lit(V.PREFIX_START), query)))
    whole = F.array_distinct(F.concat(own, F.coalesce(more, none()))) if more is not None else own
    return F.slice(whole, 1, most + 1)


def search_variants(query: Column, more: Column | None = None) -> Column:
    """The question, and what a model gave (``more``) or else framed and synonymous versions, without repeats whatever the case; nothing for a blank question."""
    asked = T.strip(query)
    low = F.lower(asked)
    around = lambda x: F.concat(F.lit(x[0]), asked, F.lit(x[1]))
    framed = [F.when(T.any_in(low, f["words"]), around(f["has"])).otherwise(around(f["lacks"])) for f in V.VARIANT_FRAMES]
    same = F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.regexp_replace(asked, rf"(?iu)\Q{k}\E", v)) for k, v in V.SYNONYMS.items()])
    own = compact(*framed, F.when(F.lower(same) != low, same))
    rest = F.when(F.coalesce(F.size(more), F.lit(0)) > 0, more).otherwise(own) if more is not None else own
    whole = F.filter(F.transform(F.concat(F.array(asked), rest), T.strip), lambda x: x != "")
    once = T.let(whole, lambda a: F.filter(a, lambda x, k: F.array_position(F.transform(a, F.lower), F.lower(x)) == k + 1))
    return F.when(F.coalesce(asked, F.lit("")) != "", once).otherwise(none())


def passage(query: Column, llm=None) -> Column:
    """A passage such as an answer might stand in: what ``llm``, a Column function, gives, or else by the first topic of the question that is known."""
    clean = F.regexp_replace(T.strip(query), "[?.!]+$", "")
    filled = lambda text: F.concat(F.lit(text.split("{}")[0]), clean, F.lit(text.split("{}")[1]))
    known = [F.when(T.any_in(F.lower(clean), words), filled(text)) for words, text in V.PASSAGES if words]
    given = [F.nullif(T.strip(llm(query)), F.lit(""))] if llm else []
    return F.coalesce(*given, *known, filled(V.PASSAGES[-1][1]))


# --- decomposition ---


def should_decompose(query: Column) -> Column:
    q = F.lower(query)
    patterns = [p.replace(r"\b", "(?:(?<![\\p{L}\\p{N}_])(?=[\\p{L}\\p{N}_])|(?<=[\\p{L}\\p{N}_])(?![\\p{L}\\p{N}_]))") for p in V.JOINT_PATTERNS]
    return reduce(lambda a, b: a | b, [q.rlike(p) for p in patterns]) & (F.size(topics(q, V.JOINT_TOPICS)) >= 2)


def decompose(query: Column, more: Column | None = None) -> Column:
    """Sub-questions of more than 10 characters, as sentences; the question itself if there are fewer than two. ``more``: a model's lines, which count instead: those that are long enough, or the question itself if they are fewer than two; null where it failed."""
    q = F.lower(T.strip(query))
    parts = F.split(q, "|".join(word(w) for w in V.SPLIT_WORDS), -1)
    given = F.when(q.rlike(V.IF_THEN), F.array(F.regexp_extract(q, V.IF_THEN, 1), F.regexp_extract(q, V.IF_THEN, 2))).otherwise(parts)
    long = F.filter(F.transform(given, T.strip), lambda p: F.length(p) > 10)
    asked = F.transform(long, lambda p: F.concat(T.capitalized(p), F.when(p.rlike("[.?!]$"), "").otherwise("?")))
    own = T.let(asked, lambda a: F.when(F.size(a) > 1, a).otherwise(F.array(query)))
    if more is None:
        return own
    lines = F.filter(F.transform(more, T.strip), lambda p: F.length(p) > 10)
    return F.when(more.isNull(), own).otherwise(T.let(lines, lambda p: F.when(F.size(p) >= 2, p).otherwise(F.array(query))))


def sub_queries(queries: DataFrame, query: str = "query") -> DataFrame:
    """A row a sub-question, with ``part`` from 1."""
    own = [c for c in queries.columns if c != query]
    return queries.select(*own, F.posexplode(decompose(F.col(query))).alias("part", query)).withColumn("part", F.col("part") + 1)


# --- routing ---


def route(query_type: Column, reranker: bool = False, llm: bool = False) -> Column:
    """struct<strategy, use_filter, use_reranker, use_rewrite, use_multi_query, use_hyde, use_decomposition> for a type of question."""

    def decided(kind: str) -> Column:
        strategy, flags = V.ROUTES[kind]["strategy"], set(V.ROUTES[kind]["flags"])
        if kind == "AMBIGUOUS" and llm:
            strategy, flags = "hyde", {"filter", "hyde"}
        if reranker and kind in ("FACTUAL", "PROCEDURAL", "MULTI_HOP", "GLOBAL"):
            strategy, flags = "hybrid_reranked" if strategy == "hybrid" else strategy, flags | {"reranker"}
        return F.struct(F.lit(strategy).alias("strategy"), *[F.lit(f in flags).alias(f"use_{f}") for f in V.ROUTE_FLAGS])

    return reduce(lambda c, k: c.when(query_type == k, decided(k)), [k for k in V.ROUTES if k != "FACTUAL"], F.when(query_type.isNull(), decided("FACTUAL"))).otherwise(decided("FACTUAL"))
