"""Prompts, citations, extractive answers, evidence and confidence, over rows of a question and its contexts.

contexts: array<struct<doc_id, chapter, article, section, content, score>>, best first; any of chapter, article, section
and score may be missing from the struct or null.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..storage import cut


def gathered(ranking: DataFrame, columns: list[str], query_col: str = "query_id") -> DataFrame:
    """(query_id, contexts), by rank."""
    rows = F.sort_array(F.collect_list(F.struct("rank", F.struct(*columns).alias("c"))))
    return ranking.groupBy(query_col).agg(F.transform(rows, lambda x: x["c"]).alias("contexts"))


def named(x: Column, fields: list[str], wanted: list[str]) -> list[Column]:
    return [F.nullif(x[f].cast("string"), F.lit("")) for f in wanted if f in fields]


# --- prompts and citations ---


def context_text(contexts: Column, fields: list[str]) -> Column:
    """[n] [Source: ...] (score: 0.000) and the content, n from 1."""
    shown = lambda x: F.when(x["score"].isNotNull(), F.concat(F.lit(" (score: "), F.format_string("%.3f", x["score"].cast("double")), F.lit(")"))).otherwise("") if "score" in fields else F.lit("")
    source = lambda x: F.concat_ws(" | ", F.coalesce(x["doc_id"].cast("string"), F.lit("unknown")), *named(x, fields, ["chapter", "article"]))
    return F.array_join(F.transform(contexts, lambda x, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] [Source: "), source(x), F.lit("]"), shown(x), F.lit("\n"), x["content"])), "\n\n")


def prompt(query: Column, contexts: Column, fields: list[str], system: str = V.SYSTEM_PROMPT) -> Column:
    asked = F.concat(F.lit(V.QUESTION_LABEL), query)
    full = F.concat_ws("\n\n", F.lit(system), F.concat(F.lit(V.CONTEXT_LABEL), context_text(contexts, fields)), asked, F.lit(V.ANSWER_LABEL))
    bare = F.concat_ws("\n\n", F.lit(system), F.lit(V.NO_CONTEXT), asked, F.lit(V.NO_ANSWER))
    return F.when(F.coalesce(F.size(contexts), F.lit(0)) > 0, full).otherwise(bare)


def agent_prompt(query: Column, contexts: Column, store_size: Column) -> Column:
    """The plain agent's prompt, or its message for an empty store or result."""
    listed = F.array_join(F.transform(contexts, lambda x, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] (nguồn: "), F.coalesce(x["doc_id"].cast("string"), F.lit("unknown")), F.lit(")\n"), x["content"])), "\n\n")
    full = F.concat_ws("\n\n", F.lit(V.AGENT_RULES), F.concat(F.lit(V.CONTEXT_LABEL), listed), F.concat(F.lit(V.QUESTION_LABEL), query), F.lit(V.ANSWER_LABEL))
    return F.when(store_size == 0, V.EMPTY_STORE).when(F.coalesce(F.size(contexts), F.lit(0)) == 0, V.EMPTY_RESULT).otherwise(full)


def citations(contexts: Column, fields: list[str]) -> Column:
    """array<struct<index, source, section, preview>>."""
    section = lambda x: F.coalesce(F.nullif(F.concat_ws(" > ", *named(x, fields, ["chapter", "article", "section"])), F.lit("")), F.lit("N/A"))
    return F.transform(contexts, lambda x, k: F.struct((k + 1).cast("string").alias("index"), F.coalesce(x["doc_id"].cast("string"), F.lit("unknown")).alias("source"), section(x).alias("section"), T.preview(x["content"]).alias("preview")))


def citations_text(cited: Column) -> Column:
    line = lambda c: F.concat(F.lit("["), c["index"], F.lit("] "), c["source"], F.when(c["section"] != "N/A", F.concat(F.lit(" | "), c["section"])).otherwise(""))
    return F.when(F.coalesce(F.size(cited), F.lit(0)) > 0, F.array_join(F.concat(F.array(F.lit(V.CITATIONS_TITLE)), F.transform(cited, line)), "\n")).otherwise("")


# --- extractive answers ---


def content_words(query: Column) -> Column:
    return F.filter(F.array_except(T.tokens(query), F.array(*map(F.lit, V.STOP_WORDS))), lambda w: F.length(w) > 1)


def extractive(rows: DataFrame, key: str = "query_id", query: str = "query", contexts: str = "contexts", most: int = 8, top: int = 5) -> DataFrame:
    """Adds ``answer``: the sentences of the first contexts that hold most words of the question, each once; equal ones in reading order."""
    held = rows.select(key, content_words(F.col(query)).alias("words"), F.posexplode(F.slice(contexts, 1, top)).alias("ctx", "c"))
    parts = F.transform(F.split(F.col("c.content"), r"(?<=[.!?\n])\s+", -1), T.strip)
    lines = held.select(key, "words", "ctx", F.posexplode_outer(parts).alias("pos", "line")).where(F.length("line") > 15)  # outer: see chunking.exploded
    lines = lines.withColumn("overlap", T.let(F.lower("line"), lambda low: F.size(F.filter("words", lambda w: F.contains(low, w)))))
    order = [F.desc("overlap"), "ctx", "pos"]
    once = lines.withColumn("n", F.row_number().over(Window.partitionBy(key, "line").orderBy(*order))).where("n = 1")
    best = once.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("n") <= most)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: F.concat(F.lit("- "), x["line"]))
    bodies = best.groupBy(key).agg(F.array_join(listed, "\n\n").alias("body__"))
    start = F.substring(F.try_element_at(contexts, F.lit(1))["content"], 1, 1500)
    said = F.concat(F.lit(V.ANSWER_START[0]), F.col(query), F.lit(V.ANSWER_START[1]), F.coalesce("body__", start))
    return rows.join(bodies, key, "left").withColumn("answer", F.when(F.coalesce(F.size(contexts), F.lit(0)) > 0, said).otherwise(V.NOT_FOUND)).drop("body__")


def model_text(model):
    """A Column function of a prompt: ``model`` (a function of one text to one text) called in Arrow batches; where it fails, the answer tells so."""

    def run(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            try:
                out.append(model(p))
            except Exception as error:
                out.append(V.MODEL_FAILED + str(error))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")


def generate(rows: DataFrame, fields: list[str], llm=None, key: str = "query_id", query: str = "query", contexts: str = "contexts", cite: bool = True) -> DataFrame:
    """Adds prompt, citations and answer. llm: a Column function of the prompt, such as ``model_text`` makes. Without one the answer is extractive."""
    rows = rows.withColumn("prompt", prompt(F.col(query), F.col(contexts), fields))
    rows = rows.withColumn("answer", llm(F.col("prompt"))) if llm else extractive(rows, key, query, contexts)
    if not cite:
        return rows
    rows = rows.withColumn("citations", citations(F.col(contexts), fields))
    return rows.withColumn("answer", T.let(citations_text(F.col("citations")), lambda t: F.when(t != "", F.concat_ws("\n", "answer", t)).otherwise(F.col("answer"))))


# --- evidence ---


def key_phrases(text: Column, most: int = 10) -> Column:
    """Numbers of something with what stands around their first occurrence, then articles, then dates."""

    def around(n):
        at = F.instr(text, n) - 1
        low = F.greatest(at - 30, F.lit(0))
        return T.strip(F.substring(text, low + 1, F.least(F.length(text), at + F.length(n) + 30) - low))

    numbers = F.transform(F.regexp_extract_all(text, F.lit(V.NUMBER_CLAIM), F.lit(1)), around)
    others = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (V.ARTICLE_CLAIM, V.DATE_CLAIM)]
    return F.slice(F.concat(numbers, *others), 1, most)


def support(phrases: Column, contexts: Column, fields: list[str]) -> Column:
    """array<struct<claim, supported, source, section, score, matching_text>>: the first context that has the phrase (1) or one of its numbers (0.7) supports it."""
    section = lambda x: F.coalesce(F.nullif(F.concat_ws(" > ", *named(x, fields, ["chapter", "article", "section"])), F.lit("")), F.lit("N/A"))
    kind = "struct<score: double, source: string, section: string, text: string>"

    def of(phrase):
        numbers = F.regexp_extract_all(phrase, F.lit(V.NUMBER), F.lit(0))

        def judged(x):
            low = F.lower(x["content"])
            number = F.try_element_at(F.filter(numbers, lambda n: F.contains(low, n)), F.lit(1))
            whole = F.contains(low, F.lower(T.strip(phrase)))
            score = F.when(whole, 1.0).when(number.isNotNull(), 0.7)
            return F.struct(score.alias("score"), F.coalesce(x["doc_id"].cast("string"), F.lit("unknown")).alias("source"), section(x).alias("section"), F.when(whole, phrase).otherwise(number).alias("text")).cast(kind)

        first = F.try_element_at(F.filter(F.transform(contexts, judged), lambda j: j["score"].isNotNull()), F.lit(1))
        return T.let(first, lambda j: F.struct(phrase.alias("claim"), j.isNotNull().alias("supported"), F.coalesce(j["source"], F.lit("")).alias("source"), F.coalesce(j["section"], F.lit("")).alias("section"), F.coalesce(j["score"], F.lit(0.0)).alias("score"), F.coalesce(j["text"], F.lit("")).alias("matching_text")))

    return F.transform(phrases, of)


def check_evidence(answer: Column, contexts: Column, fields: list[str]) -> Column:
    checked = T.let(key_phrases(answer), lambda p: support(p, contexts, fields))
    return F.when((answer != "") & (F.size(contexts) > 0), checked).otherwise(F.array().cast("array<struct<claim: string, supported: boolean, source: string, section: string, score: double, matching_text: string>>"))


# --- confidence ---


def signals(scores: Column, evidence: Column, has_metadata: Column) -> dict[str, Column]:
    """scores: array of doubles, one a context; evidence: as check_evidence gives; has_metadata: array of booleans, one a context."""
    n = F.coalesce(F.size(scores), F.lit(0))
    best = F.sort_array(scores, asc=False)
    top = F.coalesce(F.try_element_at(best, F.lit(1)), F.lit(0.0))
    known = F.coalesce(F.size(evidence), F.lit(0)) > 0
    return {
        "result_count": F.least(n / 3.0, F.lit(1.0)),
        "top_score": F.least(F.greatest(top, F.lit(0.0)), F.lit(1.0)),
        "score_gap": F.when(n >= 2, F.least((top - F.try_element_at(best, F.lit(2))) * 5, F.lit(1.0))).otherwise(0.5),
        "evidence_support": F.when(known, F.size(F.filter(evidence, lambda e: e["supported"])) / F.nullif(F.size(evidence), F.lit(0))).otherwise(0.5),
        "metadata_quality": F.when(n > 0, F.size(F.filter(has_metadata, lambda m: m)) / F.nullif(n, F.lit(0))).otherwise(0.0),
    }


def assess(rows: DataFrame, scores: Column, evidence: Column, has_metadata: Column, threshold: float = V.ABSTAIN_BELOW) -> DataFrame:
    """Adds the signals, retrieval_confidence, overall_confidence, should_abstain and abstention_reason."""
    rows = rows.withColumns(signals(scores, evidence, has_metadata))
    weighted = lambda weights: sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    rows = rows.withColumn("retrieval_confidence", weighted(V.RETRIEVAL_WEIGHTS)).withColumn("overall_confidence", weighted(V.WEIGHTS))
    rows = rows.withColumn("should_abstain", F.col("overall_confidence") < threshold)
    few, low, bare, other = V.ABSTAIN_REASONS
    reason = F.when(F.col("result_count") < 0.33, few).when(F.col("top_score") < 0.2, low).when(F.col("evidence_support") < 0.3, bare).otherwise(other)
    return rows.withColumn("abstention_reason", F.when(F.col("should_abstain"), reason).otherwise(""))


def retry(assessed: DataFrame, attempt: int = 0, max_retries: int = 2) -> DataFrame:
    """Adds ``retry``: what to change for another try, or '' if none is due."""
    change = F.when(F.col("result_count") < 0.33, "broaden_filters").when(F.col("top_score") < 0.2, "rewrite_query").otherwise("multi_query")
    return assessed.withColumn("retry", F.when(F.col("should_abstain"), change).otherwise("") if attempt < max_retries else F.lit(""))


def corrected(queries: DataFrame, search, assess_fn, max_retries: int = 2) -> DataFrame:
    """search(queries, overrides) -> rows a question; questions whose rows are to be retried are searched again with the overrides of their suggestion, ``max_retries`` times at most.

    A round is one search a suggestion, whatever led to it, and is computed once: the next reads what it left in the shared folder.
    """
    done, todo = [], [({}, queries)]
    for attempt in range(max_retries + 1):
        judged = [cut(retry(assess_fn(search(part, overrides)), attempt, max_retries)) for overrides, part in todo]
        done += [x.where("retry = ''") for x in judged]
        again = reduce(DataFrame.unionByName, [x.select("query_id", "retry") for x in judged])
        wanted = [r.retry for r in again.where("retry <> ''").select("retry").distinct().orderBy("retry").collect()]  # three at most
        if not wanted:
            break
        todo = [(V.RETRY_OVERRIDES[s], queries.join(again.where(F.col("retry") == s).select("query_id"), "query_id", "left_semi")) for s in wanted]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), done)
