"""Top-k, rank fusion and de-duplication over rankings (query_id, chunk_idx, score, rank)."""

from __future__ import annotations

import warnings
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores that differ less count as equal, so that the order of additions can't decide a tie.
DIGITS = 9


def rounded(score: Column) -> Column:
    return F.round(score, DIGITS)


def top_k(scored: DataFrame, k: int, query_col: str = "query_id", item_col: str = "chunk_idx", score_col: str = "score") -> DataFrame:
    """Adds ``rank`` (from 1) and keeps k rows a query: highest score first, ties to the smaller item. Spark prunes each task to k rows a query before the shuffle."""
    order = Window.partitionBy(query_col).orderBy(rounded(F.col(score_col)).desc(), item_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(0, k))


def fuse(rankings: list[DataFrame], k: int = 60, query_col: str = "query_id", item_col: str = "chunk_idx") -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over all lists an item is in; a k of 0 or less counts as 60. Scores are ignored."""
    k = k if k > 0 else 60
    lists = reduce(DataFrame.unionByName, [r.select(query_col, item_col, "rank") for r in rankings])
    return lists.groupBy(query_col, item_col).agg(F.sum(1.0 / (F.col("rank") + k)).alias("score"))


def first_per_parent(ranking: DataFrame, k: int, query_col: str = "query_id", parent_col: str = "parent_id") -> DataFrame:
    """The best ranked row of each parent, ranked anew; k parents a query."""
    best = Window.partitionBy(query_col, parent_col).orderBy("rank")
    kept = ranking.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place").withColumnRenamed("rank", "child_rank")
    again = Window.partitionBy(query_col).orderBy("child_rank")
    return kept.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)


def rerank(ranking: DataFrame, k: int, score_fn=None, text_col: str = "content", query_text_col: str = "query") -> DataFrame:
    """Ordered by ``score_fn(query column, text column)``, a Column, best first; without one the first k, as they are.

    A question for which any text got no score keeps its order and its scores, as without a scorer.
    """
    passed = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    if score_fn is None:
        return ranking.where(F.col("rank") <= k).withColumn("rerank_score", passed)
    scored = ranking.withColumn("rerank_score", score_fn(F.col(query_text_col), F.col(text_col)))
    failed = F.max(F.isnull("rerank_score")).over(Window.partitionBy("query_id"))
    scored = scored.withColumn("failed__", failed)
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("failed__"), None).otherwise(F.col("rerank_score")).desc_nulls_last(), "rank")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("rerank_score", F.when(F.col("failed__"), passed).otherwise(F.col("rerank_score"))).drop("failed__")


def model_score(model, batch: int = 32):
    """A scorer for ``rerank``: model is a function of a list of (query, text) to scores, such as a cross-encoder's logits or an API's relevance; it gets the pairs of one question, ``batch`` at most, in a call. A question for which a call fails has no scores."""

    def of(pairs: list) -> list:
        try:
            made = [float(x) for at in range(0, len(pairs), batch) for x in model(pairs[at : at + batch])]
            return made if len(made) == len(pairs) else [None] * len(pairs)
        except Exception as error:
            warnings.warn(f"reranking failed: {error!r}", stacklevel=2)
            return [None] * len(pairs)

    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(queries), dtype="float64")
        for places in queries.reset_index(drop=True).groupby(queries.to_numpy(), sort=False, dropna=False).indices.values():
            out.iloc[places] = of([(queries.iloc[i], texts.iloc[i]) for i in places])
        return out

    return lambda query, text: F.pandas_udf(run, "double")(query, text)


def score_gap(ranking: DataFrame) -> DataFrame:
    """(query_id, gap): the best score less the second best; null for fewer than two."""
    best = F.reverse(F.sort_array(F.collect_list("score")))
    return ranking.where("rank <= 2").groupBy("query_id").agg(best.alias("s")).select("query_id", F.when(F.size("s") > 1, F.col("s")[0] - F.try_element_at("s", F.lit(2))).alias("gap"))
