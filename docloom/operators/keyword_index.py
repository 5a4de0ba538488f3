"""A keyword index that is kept between searches: postings in blocks, with bounds that let most blocks be left unread.

Chunks of similar length are dealt to windows of about ``WINDOW`` chunks. A block holds the postings of one term in one
window, and beside them what bounds their scores whatever the statistics of later days are: the greatest frequency and
the smallest length. Blocks lie in a ``sources.store.Store``, in folders by a hash of their term; each batch of chunks adds
blocks of its own windows.

A search reads the bounds of its terms first (other terms' folders are not read). The sum of a question's bounds in a
window is the most that any of its chunks can score there. The most promising windows are scored, which gives each
question a score that its k-th best chunk has at least; then the windows whose bound reaches it are scored, and no others.
Scores and ranks are those of ``retrieval.bm25``.

Defined results: as ``retrieval.bm25``; ids may repeat within a batch (their rows are one chunk), not between batches;
batches without chunks add nothing; an empty index finds nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import Store
from ..storage import cut, parts_for
from . import retrieval as R
from .ranking import DIGITS, top_k

#: Chunks of a window, folders of terms.
WINDOW, BUCKETS = 64, 64


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class KeywordIndex:
    def __init__(self, spark: SparkSession, path: str, k1: float = 1.5, b: float = 0.75, window: int = WINDOW):
        self.store = Store(spark, path, key="term", name="blocks", by=("bucket",))
        self.spark, self.k1, self.b, self.window = spark, k1, b, window

    def add(self, chunks: DataFrame) -> int:
        """More chunks (chunk_idx, content, retrieval_content?). Texts are dealt by window, so that a task makes whole blocks; these alone are dealt again, by folder."""
        text, parts = R.searchable(chunks), parts_for(chunks)
        step = F.floor(F.log2(F.size("words") + 1) * 4).cast("int")
        told = chunks.select("chunk_idx", text.alias("text"), T.tokens(text).alias("words")).select("chunk_idx", "text", step.alias("step"))
        sizes = told.groupBy("step").agg(F.ceil(F.count("*") / self.window).alias("windows"))  # a row a step of lengths
        which = F.xxhash64(F.lit(uuid.uuid4().hex), "step", F.pmod(F.xxhash64("chunk_idx"), F.col("windows")))
        # an outer join, as an outer explode: an inner one makes Spark infer a filter that finds the words a second time
        dealt = told.join(F.broadcast(sizes), "step", "left").select("chunk_idx", "text", which.alias("window")).repartition(parts, "window").sortWithinPartitions("window")

        def run(batches):
            for rows, codes in R.whole_groups(batches):
                for some in pieces(codes, np.diff(rows.column(2).offsets.to_numpy()) + 1):
                    yield made(rows.slice(some.start, some.stop - some.start), codes[some])

        kind = dict(chunks.dtypes)["chunk_idx"]
        schema = f"term string, window long, n long, most long, least int, n_whole long, total long, postings array<struct<chunk_idx: {kind}, chunk_len: int, tf: int>>"
        blocks = dealt.select("window", "chunk_idx", T.tokens(F.col("text")).alias("words")).mapInArrow(run, schema)
        files = F.pmod("window", F.lit(max(8, -(-parts // BUCKETS))))  # of a folder
        blocks = blocks.withColumn("bucket", bucket(F.col("term"))).repartition(parts, "bucket", files).sortWithinPartitions("bucket", "term", "window")
        return self.store.add(blocks)

    def blocks(self, wanted: DataFrame) -> DataFrame:
        """The blocks of ``wanted`` (term), of which a few thousand name the folders that are read."""
        rows = self.store.read()
        if not rows.columns or "bucket" not in rows.columns:
            return self.spark.createDataFrame([], "term string, window long, n long, most long, least int, n_whole long, total long, postings array<struct<chunk_idx: long, chunk_len: int, tf: int>>, bucket int")
        buckets = [r[0] for r in wanted.select(bucket(F.col("term"))).distinct().collect()]  # BUCKETS at most
        return rows.where(F.col("bucket").isin(*buckets)).join(R.few(wanted), "term", "left_semi")

    def weights(self, wanted: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, term, weight) of ``wanted`` (query_id, term, times), and one row (n_chunks, avg_len)."""
        n = F.sum("n_whole")
        of_all = blocks.where(F.col("term") == R.WHOLE).agg(n.alias("n_chunks"), F.coalesce(F.sum("total") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("avg_len"))
        df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        made = wanted.join(R.few(df), "term").crossJoin(F.broadcast(of_all))
        return made.select("query_id", "term", (F.col("times") * R.idf(F.col("n_chunks"), F.col("df"))).alias("weight")), of_all

    def plan(self, wanted: DataFrame, k: int) -> dict:
        """What a search for ``wanted`` (query_id, term, times), of few questions, starts from: blocks, bounds, and the windows of the first round."""
        terms = wanted.select("term").distinct().union(self.spark.range(1).select(F.lit(R.WHOLE)))
        blocks, parts = self.blocks(terms), parts_for(self.store.read())
        # dealt by window and in their order, as which they stay
        heads = cut(blocks.select("term", "window", "n", "most", "least", "n_whole", "total").repartition(parts, "window").sortWithinPartitions("window"))
        weights, of_all = self.weights(wanted, heads)
        weights, of_all = cut(weights), cut(of_all)
        asked = cut(R.numbered(weights))
        listed = weights.join(F.broadcast(asked), "query_id").groupBy("term").agg(F.collect_list(F.struct("number", "weight")).alias("asked"))
        plan = {"blocks": blocks, "parts": parts, "heads": heads, "weights": weights, "of_all": of_all, "asked": asked, "listed": cut(listed)}
        # k windows: a rare word may stand in one chunk of each
        best = max(4, k)
        first = cut(top_k(R.best_of_tasks(self.bounds(plan).withColumnRenamed("window", "chunk_idx"), asked, best), best))
        return plan | {"first": self.limits(plan, first, best)}

    def bounds(self, plan: dict) -> DataFrame:
        """(window, part, asked): what blocks of the questions' terms can add to a score, a window's one after another."""
        met = plan["heads"].join(F.broadcast(plan["listed"]), "term").crossJoin(F.broadcast(plan["of_all"]))
        return met.select("window", R.part_of(F.col("most"), F.col("least"), F.col("avg_len"), self.k1, self.b).alias("part"), "asked")

    def limits(self, plan: dict, found: DataFrame, k: int) -> np.ndarray:
        """For each question, by number, its k-th best score in ``found`` (query_id, score, rank); 0 for fewer. Questions are few."""
        least = found.where(F.col("rank") == k).join(F.broadcast(plan["asked"]), "query_id").select("number", F.round("score", DIGITS).alias("least"))
        rows, n = least.collect(), plan["asked"].count()
        out = np.zeros(n)
        out[[r["number"] for r in rows]] = [r["least"] for r in rows]
        return out

    def reached(self, plan: dict, limits: np.ndarray) -> DataFrame:
        """(number, window): questions whose bound in a window reaches their limit."""

        def run(batches):
            for rows, codes in R.whole_groups(batches):
                block, numbers, weights = opened(rows.column(2))
                _, first, place = np.unique(codes, return_index=True, return_inverse=True)
                some = open_pairs(place[block], numbers, weights * rows.column(1).to_numpy()[block], len(first), limits)
                yield pa.record_batch([pa.array(some % len(limits), pa.int32()), rows.column(0).take(pa.array(first[some // len(limits)]))], names=["number", "window"])

        return self.bounds(plan).mapInArrow(run, "number int, window long")

    def scored(self, plan: dict, limits: np.ndarray, k: int) -> DataFrame:
        """(query_id, chunk_idx, score): a task's best of the windows whose bounds reach the questions' limits. Only blocks of windows that some question reaches are dealt out."""
        windows = R.few(cut(self.reached(plan, limits).select("window").distinct()))
        read = plan["blocks"].select("term", "window", "most", "least", "postings").join(windows, "window", "left_semi")
        rows = R.in_turn(read.repartition(plan["parts"], "window"), "window").join(F.broadcast(plan["listed"]), "term").crossJoin(F.broadcast(plan["of_all"]))
        made = R.part_of(F.col("most"), F.col("least"), F.col("avg_len"), self.k1, self.b)
        rows = rows.select("window", made.alias("part"), "asked", "postings", F.greatest("avg_len", F.lit(1e-12)).alias("avg_len"), "turn__")
        k1, b, kind = self.k1, self.b, dict(plan["blocks"].select(F.col("postings")[0]["chunk_idx"].alias("id")).dtypes)["id"]

        def run(batches):
            pool = R.Pool(k, in_order=False)
            for rows, codes in R.whole_groups(batches) if k > 0 else ():
                block, numbers, weights = opened(rows.column(2))
                places, place = np.unique(codes, return_inverse=True)
                key = place[block] * len(limits) + numbers
                good = np.isin(key, open_pairs(place[block], numbers, weights * rows.column(1).to_numpy()[block], len(places), limits))
                block, numbers, weights = block[good], numbers[good], weights[good]
                starts = rows.column(3).offsets.to_numpy()
                starts, sizes, held = starts[:-1] - starts[0], np.diff(starts), rows.column(3).flatten()
                tf, chunk_len = held.field(2).to_numpy().astype(float), held.field(1).to_numpy()
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * chunk_len / rows.column(4)[0].as_py()))  # as ``part_of``
                for some in pieces(place[block], sizes[block]):
                    n = sizes[block[some]]
                    at = np.arange(n.sum()) + np.repeat(starts[block[some]] - (np.cumsum(n) - n), n)
                    used, own = np.unique(at, return_inverse=True)
                    ids = held.field(0).take(pa.array(used)).dictionary_encode(null_encoding="encode")
                    pool.put(ids.dictionary, ids.indices.to_numpy()[own].astype(np.int64), np.repeat(numbers[some], n), np.repeat(weights[some], n) * part[at])
            yield from pool.batches()

        found = rows.mapInArrow(run, f"number int, chunk_idx {kind}, score double")
        return found.join(F.broadcast(plan["asked"]), "number").select("query_id", "chunk_idx", "score")

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """(query_id, chunk_idx, score, rank). Questions that are more than few take turns."""
        wanted = cut(R.query_terms(queries))
        n = max(1, -(-wanted.count() // R.FEW))
        turns = [wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == at) for at in range(n)] if n > 1 else [wanted]
        plans = [self.plan(cut(w) if n > 1 else w, k) for w in turns]
        return reduce(DataFrame.unionByName, [top_k(self.scored(p, self.second(p, k), k), k) for p in plans]).select("query_id", "chunk_idx", "score", "rank")

    def second(self, plan: dict, k: int) -> np.ndarray:
        """The limits that the first round gives."""
        return self.limits(plan, cut(top_k(self.scored(plan, plan["first"], k), k)), k)

    def shares(self, queries: DataFrame, k: int = 20) -> dict:
        """Postings of the questions' terms, counted a question, and how many of them a search scores."""
        plan = self.plan(cut(R.query_terms(queries)), k)
        scored = self.reached(plan, plan["first"]).union(self.reached(plan, self.second(plan, k))).distinct()
        pairs = plan["heads"].select("term", "window", "n").join(R.few(plan["weights"].join(F.broadcast(plan["asked"]), "query_id").select("number", "term")), "term")
        told = pairs.join(scored.withColumn("read", F.lit(1)), ["number", "window"], "left")
        r = told.agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.coalesce("read", F.lit(0))).alias("scored")).first()
        return {"postings": r["all"] or 0, "scored": r["scored"] or 0}


def made(rows: pa.RecordBatch, codes: np.ndarray) -> pa.RecordBatch:
    """The blocks of whole windows, of rows (window, chunk_idx, words); codes: equal for equal windows. Rows of one id and length are one chunk, which has a posting of WHOLE that is counted alone."""
    lists = rows.column(2)
    words, lens = lists.flatten().dictionary_encode(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    ids = rows.column(1).dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    _, first, chunk = np.unique(ids * (lens.max(initial=0) + 1) + lens, return_index=True, return_inverse=True)
    _, start, place = np.unique(codes, return_index=True, return_inverse=True)
    row = np.r_[np.arange(len(lens)), np.repeat(np.arange(len(lens)), lens)]
    term = np.r_[np.zeros(len(lens), np.int64), words.indices.to_numpy().astype(np.int64) + 1]
    n_terms, n_chunks = len(words.dictionary) + 1, len(first)
    key, tf = np.unique((place[row] * n_terms + term) * n_chunks + chunk[row], return_counts=True)
    key, chunk = np.divmod(key, n_chunks)
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    window, term = np.divmod(key[edges], n_terms)
    n, own, size = np.diff(np.r_[edges, len(key)]), term == 0, lens[first][chunk]
    kept = np.repeat(~own, n)
    postings = pa.StructArray.from_arrays([rows.column(1).take(pa.array(first[chunk[kept]])), pa.array(size[kept], pa.int32()), pa.array(tf[kept], pa.int32())], ["chunk_idx", "chunk_len", "tf"])
    columns = {
        "term": pa.concat_arrays([pa.array([R.WHOLE], words.dictionary.type), words.dictionary]).take(pa.array(term)), "window": rows.column(0).take(pa.array(start[window])), "n": pa.array(n, pa.int64()),
        "most": pa.array(np.maximum.reduceat(tf, edges), pa.int64()), "least": pa.array(np.minimum.reduceat(size, edges), pa.int32()), "n_whole": pa.array(np.where(own, np.add.reduceat(tf, edges), 0), pa.int64()),
        "total": pa.array(np.where(own, np.add.reduceat(tf * size, edges), 0), pa.int64()), "postings": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(own, 0, n))], pa.int32()), postings),
    }
    return pa.record_batch(list(columns.values()), names=list(columns))


def opened(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, weight) of rows of lists of questions."""
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()


def open_pairs(place: np.ndarray, numbers: np.ndarray, own: np.ndarray, n: int, limits: np.ndarray) -> np.ndarray:
    """place * len(limits) + number, in order, of the pairs of one of ``n`` windows and a question whose bound, the sum of ``own``, reaches the question's limit, or misses it by what the order of additions may change."""
    some, bound = R.summed(place * len(limits) + numbers, own, n * len(limits))
    return some[bound * (1 + 1e-9) + 1e-9 >= limits[some % len(limits)]]


def pieces(place: np.ndarray, sizes: np.ndarray, most: int = 1 << 20):
    """Slices of rows of whole windows, whose ``place`` rises, of about ``most`` postings at most, or of one window."""
    edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    before = np.r_[0, np.cumsum(sizes)]
    at = 0
    while at < len(edges):
        to = max(at + 1, int(np.searchsorted(before[edges], before[edges[at]] + most, "right")) - 1)
        yield slice(edges[at], edges[to] if to < len(edges) else len(place))
        at = to
