"""Retrieval quality, for whole sets of questions.

Inputs are rows with arrays: ``retrieved`` (document ids, best first), ``gold`` (expected ids) and so on, or the long
form that ``collected`` makes them from. Metrics are Columns, so a report is one projection and one aggregation.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def collected(ranking: DataFrame, value: str, out: str, query_col: str = "query_id") -> DataFrame:
    """(query_id, out array), by rank."""
    rows = F.sort_array(F.collect_list(F.struct("rank", value)))
    return ranking.groupBy(query_col).agg(F.transform(rows, lambda x: x[value]).alias(out))


def first(values: Column, k: int) -> Column:
    return F.slice(values, 1, k)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part.cast("double") / F.nullif(whole, F.lit(0))).otherwise(0.0)


# --- one expected document ---


def holders(chunks: DataFrame, queries: DataFrame, most_bytes: int = 1 << 24) -> DataFrame:
    """(query_id, chunk_idx): the chunks that hold a question's text, word for word; an empty text is in all that aren't null.

    A task looks for all questions at once, in one pass over a text (Aho-Corasick). Questions are dealt to parts of about
    ``most_bytes`` by a hash, a part is sent to all tasks, and only sets larger than that read the texts again.
    """
    import ahocorasick

    asked = queries.where("query IS NOT NULL").select("query_id", "query").distinct()
    kinds = dict(asked.dtypes)["query_id"], dict(chunks.dtypes)["chunk_idx"]
    size = asked.agg(F.sum(F.octet_length("query") + 64)).first()[0] or 0
    n = max(1, -(-size // most_bytes))
    sc = chunks.sparkSession.sparkContext

    def found(part: DataFrame) -> DataFrame:
        rows = part.select("query", "query_id").toArrow()
        shared = sc.broadcast((rows.column(0).to_pylist(), rows.column(1).combine_chunks()))

        def run(batches):
            texts, ids = shared.value
            machine, everywhere, places = ahocorasick.Automaton(), [], {}
            for k, text in enumerate(texts):
                places.setdefault(text, []).append(k)
            for text, own in places.items():
                if text:
                    machine.add_word(text, own)
                else:
                    everywhere = own
            machine.make_automaton()
            for batch in batches:
                row, number = [], []
                for k, text in enumerate(batch.column(1)):
                    if not text.is_valid:
                        continue
                    met = {id(own): own for _, own in (machine.iter(text.as_py()) if len(machine) else ())}
                    own = [x for some in (everywhere, *met.values()) for x in some]
                    row += [k] * len(own)
                    number += own
                yield pa.record_batch([ids.take(pa.array(number, pa.int64())), batch.column(0).take(pa.array(row, pa.int64()))], names=["query_id", "chunk_idx"])

        return chunks.select("chunk_idx", "content").mapInArrow(run, f"query_id {kinds[0]}, chunk_idx {kinds[1]}")

    part = F.pmod(F.xxhash64("query_id"), F.lit(n))
    return reduce(DataFrame.unionByName, [found(asked.where(part == k) if n > 1 else asked) for k in range(n)])


def hit_at(retrieved: Column, gold: Column, k: int) -> Column:
    return F.array_contains(first(retrieved, k), gold)


def reciprocal_rank(retrieved: Column, gold: Column) -> Column:
    """Over all that was retrieved; 0 if it isn't there."""
    return share(F.lit(1), F.array_position(retrieved, gold))


def dcg(relevance: Column) -> Column:
    """relevance: array of doubles, best rank first."""
    gains = F.transform(relevance, lambda r, k: r / F.log2(k.cast("double") + 2))
    return F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)


def ndcg_retrieved(retrieved: Column, gold: Column, k: int) -> Column:
    """Against the best order of what was retrieved; a repeated document counts each time."""
    relevance = F.transform(first(retrieved, k), lambda d: F.when(d == gold, 1.0).otherwise(0.0))
    return share_of_best(dcg(relevance), dcg(F.sort_array(relevance, asc=False)))


def share_of_best(value: Column, best: Column) -> Column:
    return F.when(best > 0, value / F.nullif(best, F.lit(0.0))).otherwise(0.0)


# --- several expected documents ---


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Share of the distinct expected documents among the first k."""
    return share(F.size(F.array_intersect(first(retrieved, k), gold)), F.size(gold))


def gold_recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    """As ``recall_at``, but an expected document that is listed twice counts twice."""
    return share(F.size(F.filter(gold, lambda g: F.array_contains(first(retrieved, k), g))), F.size(gold))


def reciprocal_rank_at(retrieved: Column, gold: Column, k: int = 5) -> Column:
    found = F.filter(F.transform(first(retrieved, k), lambda d, i: F.when(F.array_contains(gold, d), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(found) > 0, 1.0 / F.try_element_at(found, F.lit(1))).otherwise(0.0)


def ndcg_gold(retrieved: Column, gold: Column, k: int = 5) -> Column:
    """Against all expected documents at the top; a document counts once, at its first place."""
    top = first(retrieved, k)
    relevance = F.transform(top, lambda d, i: F.when(F.array_contains(gold, d) & (F.array_position(top, d) == i + 1), 1.0).otherwise(0.0))
    return share_of_best(dcg(relevance), dcg(F.array_repeat(F.lit(1.0), F.least(F.size(F.array_distinct(gold)), F.lit(k)))))


# --- evidence, answers, audience ---


def evidence_covered(contents: Column, groups: Column, k: int = 5) -> Column:
    """1 if each group (array<struct<id, phrases>>) has a phrase in the first k contents, whatever the case; null without groups."""
    whole = T.folded(F.array_join(first(contents, k), "\n"))
    covered = T.let(whole, lambda t: F.forall(groups, lambda g: F.exists(g["phrases"], lambda p: F.contains(t, T.folded(p)))))
    return F.when(F.size(groups) > 0, covered.cast("double"))


def section_words(section: Column) -> Column:
    bare = F.regexp_replace(section, r"Điều|CHƯƠNG|\.", "")
    return F.filter(F.split(F.lower(T.strip(bare)), r"\s+"), lambda w: F.length(w) > 2)


def section_covered(retrieved: Column, contents: Column, gold: Column, section: Column, k: int = 5) -> Column:
    """1 if one of the first k chunks is of an expected document and has a word of the section's name (or the name has none)."""
    words = section_words(section)
    rows = F.arrays_zip(first(retrieved, k).alias("doc"), first(contents, k).alias("content"))
    good = lambda x: F.array_contains(gold, x["doc"]) & ((F.size(words) == 0) | F.exists(words, lambda w: F.contains(F.lower(x["content"]), w)))
    return F.exists(rows, good).cast("double")


def faithfulness(answer: Column, criteria: Column, keywords: Column, recall_at_1: Column) -> Column:
    """Share of criteria (array<struct<id, all_terms>>) whose terms are all in the answer; else of keywords in it; without either 1 or 0.5 as the first document is right or not."""
    text = T.folded(answer)
    has_answer = F.coalesce(answer, F.lit("")) != ""
    met = F.size(F.filter(criteria, lambda c: (F.size(c["all_terms"]) > 0) & F.forall(c["all_terms"], lambda t: F.contains(text, T.folded(t)))))
    said = F.size(F.filter(keywords, lambda w: F.contains(F.lower(answer), F.lower(w))))
    return (
        F.when((F.size(criteria) > 0) & has_answer, share(met, F.size(criteria)))
        .when((F.size(keywords) > 0) & has_answer, share(said, F.size(keywords)))
        .when(F.coalesce(F.size(keywords), F.lit(0)) <= 0, F.when(recall_at_1 > 0, 1.0).otherwise(0.5))
        .otherwise(0.0)
    )


def audience_match(audiences: Column, expected: Column, k: int = 5) -> Column:
    """Share of the first k that are for the expected audience or for all; 1 if nothing was retrieved."""
    top = first(audiences, k)
    good = F.size(F.filter(top, lambda a: F.coalesce(F.lower(a), F.lit("all")).isin("all") | (F.coalesce(F.lower(a), F.lit("all")) == F.lower(expected))))
    return F.when(F.coalesce(F.size(top), F.lit(0)) > 0, share(good, F.size(top))).otherwise(1.0)


def rubric(rank: Column, answers: Column) -> Column:
    """2: right document first and the context answers; 1: among the first three, or an incomplete answer; 0: else."""
    return F.when((rank == 1) & answers, 2).when(rank.between(1, 3), 1).otherwise(0)


def report(metrics: DataFrame, names: list[str], by: str | None = None, digits: int = 6) -> DataFrame:
    """Unweighted means over questions, 0 for none; a row for each value of ``by``."""
    means = [F.round(F.coalesce(F.avg(F.col(n).cast("double")), F.lit(0.0)), digits).alias(n) for n in names]
    grouped = metrics.groupBy(by) if by else metrics.groupBy()
    return grouped.agg(F.count("*").alias("n_queries"), *means)


def compared(with_filter: DataFrame, without: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, n_same, filtered, unfiltered): the first k of the same questions with and without a filter."""
    a = collected(with_filter.where(F.col("rank") <= k), "chunk_idx", "filtered")
    b = collected(without.where(F.col("rank") <= k), "chunk_idx", "unfiltered")
    both = b.join(a, "query_id", "full")
    empty = F.array().cast("array<bigint>")
    f, u = F.coalesce("filtered", empty), F.coalesce("unfiltered", empty)
    return both.select("query_id", F.size(F.array_intersect(f, u)).alias("n_same"), f.alias("filtered"), u.alias("unfiltered"))


def failing(reports: DataFrame, benchmark: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Questions whose first document, or none of five, was right, with their text."""
    return reports.where("recall_at_5 = 0 or recall_at_1 = 0").join(benchmark, id_col)
