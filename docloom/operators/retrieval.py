"""Retrieval of chunks for whole sets of questions at once.

chunks: (chunk_idx, content, retrieval_content?, metadata columns); queries: (query_id, query). Results are rankings
(query_id, chunk_idx, score, rank). Questions are a stated, bounded set: they are broadcast if they are few enough, and
otherwise joined (keyword search) or taken in blocks (vector search).
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from ..functions import vectors as X
from ..storage import cut, parts_for
from .ranking import DIGITS, first_per_parent, fuse, top_k

#: Rows that may be broadcast.
FEW = 200_000


def are_few(df: DataFrame, most: int = FEW) -> bool:
    return df.limit(most + 1).count() <= most


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if are_few(df, most) else df


def searchable(chunks: DataFrame) -> Column:
    """``retrieval_content`` where there is one that isn't empty, else ``content``."""
    parts = [F.nullif(F.col("retrieval_content"), F.lit(""))] if "retrieval_content" in chunks.columns else []
    return F.coalesce(*parts, F.col("content"), F.lit(""))


# --- keyword search ---

#: Stands among a chunk's terms for the chunk itself; no token is empty.
WHOLE = ""


def counted_terms(chunks: DataFrame, terms: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., chunk_idx, chunk_len, term, tf), with one row of term WHOLE a chunk, so that one pass over the texts gives all statistics.

    Only occurrences of ``terms`` leave the scan, added up batch by batch; they are dealt by chunk, which all later grouping
    by chunk reuses, to more parts the more there is to read, so that a task's share stays as it is. Without ``terms`` a task
    counts the words of its chunks before anything is shuffled.
    """
    key = [*by, "chunk_idx", "chunk_len", "term"]
    words = chunks.select(*by, "chunk_idx", T.tokens(searchable(chunks)).alias("words"))
    # an outer explode: an inner one makes Spark infer a filter that tokenises every text a second time
    rows = words.select(*by, "chunk_idx", F.size("words").alias("chunk_len"), F.explode_outer(F.concat(F.array(F.lit(WHOLE)), "words")).alias("term"))
    if terms is None:
        return rows.groupBy(*key).agg(F.count("*").alias("tf"))
    # a term that may be null gets a filter in some plans above it, whose exchanges then differ
    found = rows.join(terms, "term", "left_semi").select(*key[:-1], F.coalesce("term", F.lit(WHOLE)).alias("term"))
    return counted_in_batches(found).repartition(parts_for(chunks), "chunk_idx").groupBy(*key).agg(F.sum("n").alias("tf"))


def counted_in_batches(rows: DataFrame) -> DataFrame:
    """Distinct ``rows`` of each Arrow batch and n, how often it holds them. Equal rows of different batches stay apart, so a task holds one batch; where equal rows are near one another, as a chunk's words are, what is dealt out afterwards, and held by its writer, is less."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            yield from pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([([], "count_all")]).select([*names, "count_all"]).rename_columns([*names, "n"]).to_batches()

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("n", LongType())]))


def term_frequencies(chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(chunk_idx, chunk_len, term, tf)."""
    return counted_terms(chunks, terms).where(F.col("term") != WHOLE)


def statistics(counted: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(by..., n_chunks, avg_len), one row a group, and (by..., term, df), both of ``counted_terms``.

    Both come from one aggregation by term, whose exchange they share: each uses all of its columns, or Spark would prune
    them apart and compute it twice.
    """
    whole = F.col("term") == WHOLE
    here = lambda c: F.sum(F.when(whole, c).otherwise(F.lit(0)))
    terms = counted.groupBy(*by, "term").agg(F.count("*").alias("df"), here(F.col("tf")).alias("n_whole"), here(F.col("chunk_len") * F.col("tf")).alias("total"))
    n = F.sum(F.when(F.col("df") > 0, F.col("n_whole")))
    of_all = terms.groupBy(*by).agg(n.alias("n_chunks"), F.coalesce(F.sum("total") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("avg_len"))
    return of_all, terms.where("n_whole >= 0 AND total >= 0").select(*by, "term", "df")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """(n_chunks, avg_len), one row; chunks without words count."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.avg(F.size(T.tokens(searchable(chunks)))), F.lit(0.0)).alias("avg_len"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    """Always positive."""
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def okapi_idf(n: Column, df: Column) -> Column:
    """The classic weight, negative for terms that more than half of the chunks hold."""
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def query_terms(queries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., query_id, term, times): a term counts as often as the question holds it."""
    return queries.select(*by, "query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy(*by, "query_id", "term").agg(F.count("*").alias("times"))


def part_of(tf: Column, chunk_len: Column, avg_len: Column, k1: float, b: float) -> Column:
    """What a term's frequency in a chunk makes of its weight; it grows with the frequency and falls with the length."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * chunk_len / F.greatest(avg_len, F.lit(1e-12))))


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 20, k1: float = 1.5, b: float = 0.75, by: str | None = None) -> DataFrame:
    """BM25 with positive idf; only chunks that hold a term of the question. Rows of one ``chunk_idx`` are one chunk.

    by: a column of both; questions see the chunks of their value alone, and statistics are those of these chunks.
    Questions whose terms are few meet each chunk's terms as lists, and a task adds up and ranks its chunks; with more, pairs
    of chunk and question are added up by a shuffle.
    """
    group = (by,) if by else ()
    wanted = query_terms(queries, group)
    small = are_few(wanted)  # then the terms and the weights are few as well
    shared = F.broadcast if small else lambda df: df
    terms = wanted.select("term").distinct().union(wanted.sparkSession.range(1).select(F.lit(WHOLE)))
    tf = counted_terms(chunks, shared(terms), group)
    of_all, df = statistics(tf, group)
    weights = shared(wanted).join(df, [*group, "term"])
    weights = weights.join(shared(of_all), list(group)) if group else weights.crossJoin(F.broadcast(of_all))  # no more groups than questions, or one row
    weights = weights.select(*group, "query_id", "term", (F.col("times") * idf(F.col("n_chunks"), F.col("df"))).alias("weight"), "avg_len")
    part = part_of(F.col("tf"), F.col("chunk_len"), F.col("avg_len"), k1, b)
    if small:
        asked = numbered(queries)
        listed = weights.join(F.broadcast(asked), "query_id").groupBy(*group, "term", "avg_len").agg(F.collect_list(F.struct("number", "weight")).alias("asked"))
        rows = in_turn(tf, "chunk_idx").join(F.broadcast(listed), [*group, "term"]).select("chunk_idx", part.alias("part"), "asked", "turn__")
        return top_k(best_of_tasks(rows, asked, k), k).select("query_id", "chunk_idx", "score", "rank")
    scored = tf.join(weights, [*group, "term"]).groupBy("chunk_idx", "query_id").agg(F.sum(F.col("weight") * part).alias("score"))
    return top_k(scored.where("score > 0"), k).select("query_id", "chunk_idx", "score", "rank")


def numbered(queries: DataFrame) -> DataFrame:
    """(query_id, number) of questions that are few, from 0."""
    return queries.select("query_id").distinct().withColumn("number", F.row_number().over(Window.orderBy("query_id")) - 1)


def in_turn(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` in the order of ``by`` within partitions, before a broadcast join widens them: what is sorted, and spilled, is narrow. ``turn__``, which a join's reader has to take along, keeps Spark from leaving out a sort below a join."""
    return rows.sortWithinPartitions(by).withColumn("turn__", F.monotonically_increasing_id())


def best_of_tasks(rows: DataFrame, asked: DataFrame, k: int, above: float | None = 0.0) -> DataFrame:
    """(query_id, chunk_idx, score): each task's k best chunks a question, of rows (chunk_idx, part, asked array<struct<number, weight>>, ...) a term and chunk; all of a chunk's rows are in one partition, and follow one another. asked: (query_id, number). Only scores ``above`` count, if there is such a limit."""
    kind = dict(rows.dtypes)["chunk_idx"]
    schema = f"number int, chunk_idx {kind}, score double"

    def run(batches):
        pool = Pool(k, above=above)
        for table, codes in whole_groups(batches):
            pool.add(table, codes)
        yield from pool.batches()

    found = rows.mapInArrow(run, schema)
    return found.join(F.broadcast(asked), "number").select("query_id", "chunk_idx", "score")


def whole_groups(batches):
    """(rows, codes): batches that end where a value of the first column does, whose rows follow one another; codes are equal for equal values."""
    held = None
    for batch in (b for b in batches if b.num_rows):
        table = batch if held is None else pa.concat_batches([held, batch])
        codes = table.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        edge = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if (codes != codes[-1]).any() else 0
        if edge:
            yield table.slice(0, edge), codes[:edge]
        held = table.slice(edge)  # its group may go on
    if held is not None:
        yield held, np.zeros(held.num_rows, np.int64)


def summed(key: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys there are, below ``size`` and in order, and the sum of each one's values."""
    if size <= 1 << 22:
        sums = np.bincount(key, values, size)
        some = np.flatnonzero(np.bincount(key, minlength=size) > 0)
        return some, sums[some]
    some, at = np.unique(key, return_inverse=True)
    return some, np.bincount(at, values)


class Pool:
    """The k best scores of each question so far. Chunks that come in order need no look at their ids, as of equal scores the first counts; if not ``in_order``, that of the smaller id does."""

    def __init__(self, k: int, most: int = 1 << 20, above: float | None = 0.0, in_order: bool = True):
        self.k, self.most, self.above, self.in_order = k, most, -np.inf if above is None else above, in_order
        self.numbers, self.scores, self.chunks = np.zeros(0, np.int64), np.zeros(0), None
        self.least = np.full(0, -np.inf)

    def add(self, rows: pa.RecordBatch, codes: np.ndarray) -> None:
        """rows: (chunk_idx, part, asked), whole chunks; codes: equal for equal chunks."""
        if not rows.num_rows or self.k <= 0:
            return
        lists = rows.column(2)
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
        numbers, weights = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        _, first, place = np.unique(codes, return_index=True, return_inverse=True)
        self.put(rows.column(0).take(pa.array(first)), place[row], numbers, weights * rows.column(1).to_numpy()[row])

    def put(self, ids: pa.Array, place: np.ndarray, numbers: np.ndarray, own: np.ndarray) -> None:
        """ids: chunks, all of whose shares are here; place, numbers, own: where among them the chunk of a share is, its question, and what it adds to their score."""
        width = int(numbers.max(initial=0)) + 1
        some, scores = summed(place * width + numbers, own, len(ids) * width)
        if width > len(self.least):
            self.least = np.r_[self.least, np.full(width - len(self.least), -np.inf)]
        close = np.round(scores, DIGITS), self.least[some % width]
        good = (scores > self.above) & (np.greater(*close) if self.in_order else np.greater_equal(*close))
        some, scores = some[good], scores[good]
        chunks = ids.take(pa.array(some // width))
        self.numbers, self.scores = np.r_[self.numbers, some % width], np.r_[self.scores, scores]
        self.chunks = chunks if self.chunks is None else pa.concat_arrays([self.chunks, chunks])
        if len(self.numbers) > self.most:
            self.prune()
            self.most = max(self.most, 2 * len(self.numbers))

    def prune(self) -> None:
        turn = np.arange(len(self.numbers)) if self.in_order else pc.rank(self.chunks, null_placement="at_start", tiebreaker="first").to_numpy()
        order = np.lexsort((turn, -np.round(self.scores, DIGITS), self.numbers))
        numbers = self.numbers[order]
        starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else np.zeros(0, np.int64)
        place = np.arange(len(numbers)) - np.repeat(starts, np.diff(np.r_[starts, len(numbers)]))
        last = order[place == self.k - 1]
        self.least[self.numbers[last]] = np.round(self.scores[last], DIGITS)
        kept = np.sort(order[place < self.k])  # in order of arrival
        self.numbers, self.scores, self.chunks = self.numbers[kept], self.scores[kept], self.chunks.take(pa.array(kept))

    def batches(self):
        if self.chunks is not None:
            self.prune()
            yield pa.record_batch([pa.array(self.numbers, pa.int32()), self.chunks, pa.array(self.scores)], names=["number", "chunk_idx", "score"])


def okapi(chunks: DataFrame, queries: DataFrame, k: int = 20, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """BM25 as the usual library computes it: classic idf, negative ones replaced by ``epsilon`` times the mean idf of all terms; where no chunk scores above 0 for a question, all that hold a term of it are ranked.

    The mean needs the frequencies of all terms, which ``all_frequencies`` counts within tasks; only occurrences of the
    questions' terms are dealt by chunk.
    """
    wanted = query_terms(queries)
    small = are_few(wanted)  # then the terms and the weights are few as well
    shared = F.broadcast if small else lambda df: df
    terms = wanted.select("term").distinct().union(wanted.sparkSession.range(1).select(F.lit(WHOLE)))
    tf = counted_terms(chunks, shared(terms))
    of_all, _ = statistics(tf)
    rated = all_frequencies(chunks).crossJoin(F.broadcast(of_all)).withColumn("idf", okapi_idf(F.col("n_chunks"), F.col("df")))
    floor = rated.agg((F.avg("idf") * epsilon).alias("floor"))
    weights = shared(wanted).join(rated, "term").crossJoin(F.broadcast(floor))
    weights = weights.select("query_id", "term", (F.col("times") * F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))).alias("weight"), "avg_len")
    part = part_of(F.col("tf"), F.col("chunk_len"), F.col("avg_len"), k1, b)
    if small:
        asked = numbered(queries)
        listed = weights.join(F.broadcast(asked), "query_id").groupBy("term", "avg_len").agg(F.collect_list(F.struct("number", "weight")).alias("asked"))
        rows = in_turn(tf, "chunk_idx").join(F.broadcast(listed), "term").select("chunk_idx", part.alias("part"), "asked", "turn__")
        scored = best_of_tasks(rows, asked, k, above=None)
    else:
        scored = tf.join(weights, "term").groupBy("chunk_idx", "query_id").agg(F.sum(F.col("weight") * part).alias("score"))
    found = top_k(scored, k).withColumn("best", F.max("score").over(Window.partitionBy("query_id")))  # k rows a question
    return found.where("score > 0 OR best <= 0").select("query_id", "chunk_idx", "score", "rank")


def all_frequencies(chunks: DataFrame) -> DataFrame:
    """(term, df) of all terms, as ``statistics`` counts them. A chunk of one row gives each of its words once, and tasks add them up before anything is shuffled; rows whose id repeats are told apart by id and length first."""
    words = chunks.select("chunk_idx", T.tokens(searchable(chunks)).alias("words"))
    # outer explodes: inner ones make Spark infer a filter that tokenises every text a second time
    once = lambda df: df.select(F.explode_outer(F.array_distinct("words")).alias("term"))
    again = chunks.groupBy("chunk_idx").agg(F.count("*").alias("n")).where("n > 1").select(F.col("chunk_idx").alias("again__"))
    if again.isEmpty():
        terms = once(words)
    else:
        again = few(again)
        same = F.col("chunk_idx").eqNullSafe(F.col("again__"))
        several = words.join(again, same, "left_semi").select("chunk_idx", F.size("words").alias("chunk_len"), F.explode_outer("words").alias("term")).distinct()
        terms = once(words.join(again, same, "left_anti")).union(several.select("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).where("term IS NOT NULL")


# --- vector search ---


def hashed_embedding(text: Column) -> Column:
    """The stand-in for a model: 64 pseudo-random components of length 1, from the text's MD5."""
    return X.hashed_values(text)


def embed(df: DataFrame, text: Column, out: str = "embedding", model=None, batch: int = 25, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Adds a vector column. model: a function of list[str] to a list of vectors, run in Arrow batches.

    A batch that fails is tried ``tries`` times in all, after ``wait``, 2 * ``wait``, ... seconds, then its texts one by one;
    texts that still fail get hashed vectors, and so do all without a model. Equal texts of an Arrow batch are asked for once.
    """
    hashed = X.normalize(F.col(f"{out}__raw"))
    df = df.withColumn(f"{out}__raw", hashed_embedding(text))
    if model is None:
        return df.withColumn(out, hashed).drop(f"{out}__raw")

    def tried(texts: list[str]) -> list:
        for attempt in range(tries):
            try:
                made = [list(map(float, v)) for v in model(texts)]
                if len(made) != len(texts):
                    raise ValueError(f"{len(made)} vectors for {len(texts)} texts")
                return made
            except Exception as error:
                warnings.warn(f"embedding failed: {error!r}", stacklevel=2)
                if attempt + 1 < tries:
                    time.sleep(wait * 2**attempt)
        return [None] if len(texts) == 1 else [v for t in texts for v in tried([t])]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            once = list(dict.fromkeys(texts))
            made = dict(zip(once, [v for at in range(0, len(once), batch) for v in tried(once[at : at + batch])], strict=True))
            yield pd.Series([made[t] for t in texts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(f"{out}__model", F.pandas_udf(run, "array<double>")(text)).withColumn(out, F.coalesce(f"{out}__model", hashed)).drop(f"{out}__raw", f"{out}__model")


def embed_cached(df: DataFrame, text: Column, cache: DataFrame, out: str = "embedding", model=None, **options) -> tuple[DataFrame, DataFrame]:
    """(``df`` with vectors, new entries of the cache): only texts that ``cache`` (text_hash, embedding) lacks reach the model, each once."""
    keyed = df.withColumn("text__hash", F.sha2(text, 256))
    missing = keyed.where(F.col("text__hash").isNotNull()).groupBy("text__hash").agg(F.first(text).alias("text__asked")).join(cache.select(F.col("text_hash").alias("text__hash")), "text__hash", "left_anti")
    made = cut(embed(missing, F.col("text__asked"), "text__vector", model, **options).select(F.col("text__hash").alias("text_hash"), F.col("text__vector").alias("embedding")))
    known = cache.select(F.col("text_hash").alias("text__hash"), F.col("embedding").alias(out)).unionByName(made.toDF("text__hash", out)).dropDuplicates(["text__hash"])
    return keyed.join(known, "text__hash", "left").drop("text__hash"), made


def available(name: str | None, factories: dict):
    """What ``factories[name]()`` makes, an embedding model or a reranker; None, with a warning, if that fails: callers then use hashed vectors or keep the order."""
    if not name:
        return None
    try:
        return factories[name]()
    except Exception as error:
        warnings.warn(f"{name} is not available: {error!r}", stacklevel=2)
        return None


def vectors_of(column: pa.Array, width: int) -> np.ndarray:
    """A row a vector; shorter ones get zeros, longer ones lose what is beyond ``width``."""
    sizes, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), max(width, sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out[:, :width]


ID_TYPES = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows next to zero stay."""
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.where(size < 1e-12, m, m / np.where(size < 1e-12, 1, size))


def dense(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 4096, normalized: bool = True, most_bytes: int = 1 << 26) -> DataFrame:
    """The k nearest of ``vectors`` (chunk_idx, embedding) for ``queries`` (query_id, embedding), by cosine, or by inner product if not ``normalized``.

    Exact: every pair is scored, ``block`` questions against part of an Arrow batch of vectors as one matrix product.
    Questions are dealt to parts of about ``most_bytes`` by a hash of their ids, and one part at a time is sent to all
    tasks, as one Arrow table; only sets larger than that read the vectors again (``vector_index`` keeps them, and needn't).
    Each task keeps k rows a question, so that no more than that is ever shuffled. Negative scores are kept; null vectors
    take no part.
    """
    spark = vectors.sparkSession
    kind = dict(queries.dtypes)["query_id"]
    schema = f"query_id {kind}, chunk_idx long, score double"
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL")

    def scores(held: pa.Table, width: int) -> DataFrame:
        matrix = vectors_of(held.column(1).combine_chunks(), width)
        ids = held.column(0).to_pylist()
        shared = spark.sparkContext.broadcast(unit(matrix) if normalized else matrix)

        def run(batches):
            q = shared.value
            parts = [slice(at, at + block) for at in range(0, len(q), block)]
            best, items = [np.zeros((len(q[p]), 0)) for p in parts], [np.zeros((len(q[p]), 0), np.int64) for p in parts]
            step = min(4096, max(16, (1 << 22) // min(len(q), block)))  # scores held at once are bounded
            known = (b.filter(b.column(1).is_valid()) for b in batches)  # a filter in Spark would compute the vectors a second time
            for batch in (whole.slice(at, step) for whole in known for at in range(0, whole.num_rows, step)):
                v = vectors_of(batch.column(1), q.shape[1])
                v, own = unit(v) if normalized else v, batch.column(0).to_numpy()
                for n, p in enumerate(parts):
                    best[n], items[n] = bettered(best[n], items[n], q[p] @ v.T, own, k)
            for n, p in enumerate(parts):
                width = best[n].shape[1]
                yield pa.record_batch([pa.array([i for i in ids[p] for _ in range(width)], ID_TYPES[kind]), pa.array(items[n].ravel()), pa.array(best[n].ravel())], names=["query_id", "chunk_idx", "score"])

        return vectors.select(F.col("chunk_idx").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, schema)

    told = asked.agg(F.sum(8 * F.size("embedding").cast("long") + 64).alias("bytes"), F.max(F.size("embedding")).alias("width")).first()
    if told.bytes is None:
        return top_k(spark.createDataFrame([], schema), k).select("query_id", "chunk_idx", "score", "rank")
    n = -(-told.bytes // most_bytes)
    part = F.pmod(F.xxhash64("query_id"), F.lit(n))
    tables = (asked.where(part == at).toArrow() if n > 1 else asked.toArrow() for at in range(n))
    whole = reduce(DataFrame.unionByName, [scores(t, told.width) for t in tables if t.num_rows])
    return top_k(whole, k).select("query_id", "chunk_idx", "score", "rank")


def bettered(best: np.ndarray, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of ``best`` with their ``items`` and further ``scores`` of ``ids``, a row a question; equal scores in order of their ids."""
    if best.shape[1] == k:  # only what is among the best k of some question, or as good
        some = (np.round(scores, DIGITS) >= np.round(best[:, -1:], DIGITS)).any(axis=0)
        scores, ids = scores[:, some], ids[some]
        if not len(ids):
            return best, items
    best, items = np.concatenate([best, scores], axis=1), np.concatenate([items, np.broadcast_to(ids, scores.shape)], axis=1)
    order = np.lexsort((items, -np.round(best, DIGITS)), axis=1)[:, :k]
    return np.take_along_axis(best, order, 1), np.take_along_axis(items, order, 1)


def embedded_queries(queries: DataFrame, model=None) -> DataFrame:
    return embed(queries, F.col("query"), model=model)


# --- compositions ---


def hybrid(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, bm25_k: int = 20, dense_k: int = 20, rrf_k: int = 60, model=None) -> DataFrame:
    """Keyword and vector search, fused by reciprocal rank."""
    return top_k(fuse([bm25(chunks, queries, bm25_k), dense(vectors, embedded_queries(queries, model), dense_k)], rrf_k), k).select("query_id", "chunk_idx", "score", "rank")


def parents(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, child_k: int = 20, parent_k: int = 5, rrf_k: int = 60, model=None) -> DataFrame:
    """Hybrid search over child chunks, then the first of each parent: (query_id, parent_id, child_rank, score, chunk_idx, rank, content of the parent)."""
    pool = max(child_k, parent_k)
    found = hybrid(chunks, vectors, queries, pool, pool, pool, rrf_k, model)
    own = ["chunk_idx", F.coalesce(F.nullif(F.col("parent_id").cast("string"), F.lit("")), F.col("chunk_idx").cast("string")).alias("parent_id")]
    return first_per_parent(found.join(chunks.select(*own), "chunk_idx"), parent_k)


def multi_query(variants: DataFrame, search, k: int = 10) -> DataFrame:
    """variants: (query_id, variant_no, query). search: queries, k -> ranking. All variants are searched in one pass and fused by question."""
    keyed = variants.where(F.trim("query") != "").select(F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant_no").cast("string")).alias("query_id"), "query")
    found = search(keyed, max(2 * k, 20)).withColumn("query_id", F.substring_index("query_id", "#", -2)).withColumn("query_id", F.regexp_replace("query_id", "#[^#]*$", ""))
    return top_k(fuse([found]), k).select("query_id", "chunk_idx", "score", "rank")


def lookup(ranking: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of a ranking; positions that don't exist drop out."""
    return ranking.join(chunks, "chunk_idx")


# --- filters ---


def matches_filter(metadata: Column, wanted: Column) -> Column:
    """Whether map ``metadata`` has every entry of map ``wanted``; a missing key equals a wanted null. An empty or null filter matches all."""
    return F.coalesce(F.forall(F.map_entries(wanted), lambda e: F.try_element_at(metadata, e["key"]).eqNullSafe(e["value"])), F.lit(True))


def matches_any(value: Column, wanted: Column) -> Column:
    """Equality or membership: ``wanted`` is a list of acceptable values."""
    return F.array_contains(wanted, value)


def filter_chunks(chunks: DataFrame, wanted: dict) -> DataFrame:
    """Rows whose columns have all wanted values: equal, or in a wanted list, or a list that holds the wanted value; None matches null."""
    for key, value in wanted.items():
        if key not in chunks.columns:
            chunks = chunks.where(F.lit(value is None))
        elif isinstance(value, (list, tuple, set)):
            chunks = chunks.where(F.col(key).isin(*value))
        elif dict(chunks.dtypes)[key].startswith("array"):
            chunks = chunks.where(F.array_contains(key, value))
        else:
            chunks = chunks.where(F.col(key).eqNullSafe(F.lit(value)))
    return chunks


def meets(columns: dict[str, str], wanted: Column) -> Column:
    """Whether a row has every entry of map<string,string> ``wanted``, as ``filter_chunks`` compares; columns: name -> type."""

    def entry(e):
        own = [F.when(e["key"] == c, F.coalesce(F.array_contains(F.col(c).cast("array<string>"), e["value"]), F.lit(False)) if kind.startswith("array") else F.col(c).cast("string").eqNullSafe(e["value"])) for c, kind in columns.items()]
        return F.coalesce(*own, e["value"].isNull())

    return F.coalesce(F.forall(F.map_entries(wanted), entry), F.lit(True))


#: Filters for which ``filtered`` makes a search of its own.
MOST_FILTERS = 16


def filtered(chunks: DataFrame, queries: DataFrame, filters: Column, search) -> DataFrame:
    """search(chunks, queries) for each distinct filter map of ``queries``, on the chunks it keeps: statistics are those of the subset. More than MOST_FILTERS are refused; ``bm25_filtered`` takes any number."""
    keyed = queries.withColumn("filter", filters)
    found = keyed.select(F.to_json("filter").alias("key"), "filter").dropDuplicates(["key"]).orderBy("key").limit(MOST_FILTERS + 1).collect()
    if len(found) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} different filters")
    parts = [search(filter_chunks(chunks, r["filter"] or {}), keyed.where(F.to_json("filter").eqNullSafe(F.lit(r.key))).drop("filter")) for r in found]
    return reduce(DataFrame.unionByName, parts) if parts else search(chunks, queries.limit(0))


def kept_by_filters(chunks: DataFrame, filters: DataFrame) -> DataFrame:
    """(filter__key, chunk__row) of the chunks, named by ``chunk__row``, that meet every entry of ``filters`` (filter__key, filter__map), as ``filter_chunks`` compares.

    An inverted index: a chunk has an entry (column, value) for each value it has, a filter one for each it wants, and a
    filter keeps the chunks that share as many entries with it as it has. The entry of a key that no column has is met
    by null alone; filters without entries keep all chunks.
    """
    columns = {c: kind for c, kind in chunks.dtypes if c not in ("content", "retrieval_content", "chunk__row")}
    values = [F.when(F.col(c).isNotNull(), F.col(c).cast("array<string>")).otherwise(F.array().cast("array<string>")) if kind.startswith("array") else F.array(F.col(c).cast("string")) for c, kind in columns.items()]
    entry = lambda c: lambda x: F.struct(F.lit(c).alias("key"), x.alias("value"))
    has = F.flatten(F.array(*[F.transform(F.array_distinct(v), entry(c)) for c, v in zip(columns, values, strict=True)]))
    wanted = filters.select("filter__key", F.explode(F.map_entries("filter__map")).alias("e")).select("filter__key", "e.*")
    known, lists = F.col("key").isin(*columns), [c for c, kind in columns.items() if kind.startswith("array")]
    never = (~known & F.col("value").isNotNull()) | (F.col("key").isin(*lists) & F.col("value").isNull())
    wanted = wanted.withColumn("never", never).withColumn("free", ~known & F.col("value").isNull())
    needs = wanted.groupBy("filter__key").agg(F.count(F.when(~F.col("free"), 1)).alias("needs"), F.max("never").alias("never"))
    some = few(wanted.where("NOT free").join(needs.where("NOT never").select("filter__key"), "filter__key").select("filter__key", "key", F.coalesce("value", F.lit("")).alias("value"), F.isnull("value").alias("none")))
    entries = chunks.select("chunk__row", F.explode(has).alias("e")).select("chunk__row", "e.key", F.coalesce("e.value", F.lit("")).alias("value"), F.isnull("e.value").alias("none"))
    met = entries.join(some, ["key", "value", "none"]).groupBy("filter__key", "chunk__row").agg(F.count("*").alias("met"))
    kept = met.join(few(needs.where("NOT never")), "filter__key").where("met = needs").select("filter__key", "chunk__row")
    free = filters.join(needs.where("needs > 0 OR never"), "filter__key", "left_anti").select("filter__key")
    if free.isEmpty():
        return kept
    return kept.union(chunks.select("chunk__row").crossJoin(few(free)).select("filter__key", "chunk__row"))  # all of these pairs are the answer


def bm25_filtered(chunks: DataFrame, queries: DataFrame, filters: Column, k: int = 20, **options) -> DataFrame:
    """``filtered`` with ``bm25`` in one pass: a chunk is dealt to the filters that keep it, and statistics are kept a filter."""
    keyed = queries.withColumn("filter__key", F.coalesce(F.to_json(filters), F.lit("{}"))).withColumn("filter__map", filters)
    distinct = keyed.groupBy("filter__key").agg(F.first("filter__map").alias("filter__map"))
    # what filters ask for decides: chunks that agree in it are one row of the index
    columns = [c for c in chunks.columns if c not in ("content", "retrieval_content")]
    asked = sorted(r[0] for r in distinct.select(F.explode(F.map_keys("filter__map")).alias("k")).where(F.col("k").isin(*columns)).distinct().collect())  # a row a column
    rows = chunks.withColumn("chunk__row", F.to_json(F.struct(*asked)) if asked else F.lit("{}"))
    found = kept_by_filters(rows.groupBy("chunk__row").agg(*[F.first(c).alias(c) for c in asked], F.count("*").alias("chunk__count")).drop("chunk__count"), distinct)
    kept = rows.join(few(found), "chunk__row").drop("chunk__row")
    return bm25(kept, keyed.drop("filter__map"), k, by="filter__key", **options)


# --- the store ---


def add_documents(store: DataFrame, new: DataFrame) -> DataFrame:
    """Ids may repeat."""
    return store.unionByName(new, allowMissingColumns=True)


def delete_document(store: DataFrame, doc_id) -> DataFrame:
    return store.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id)))


def without_vectors(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """What a search returns of the store's rows."""
    return rows.drop(vector_col)


def filter_by_audience(chunks: DataFrame, audience: str) -> DataFrame:
    """Rows for this audience alone; rows for all are left out."""
    return filter_chunks(chunks, {"audience": audience})


def size_of(store: DataFrame) -> int:
    return store.count()


def get_chunk(chunks: DataFrame, index: int) -> DataFrame:
    """The chunk at a position; no row if there is none."""
    return chunks.where(F.col("chunk_idx") == index)


def missing_from_cache(texts: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_hash, text): distinct texts that ``cache`` (text_hash, embedding) doesn't have."""
    keyed = texts.select(F.sha2(F.col(text_col), 256).alias("text_hash"), F.col(text_col).alias("text")).groupBy("text_hash").agg(F.first("text").alias("text"))
    return keyed.join(cache, "text_hash", "left_anti")
