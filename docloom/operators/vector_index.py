"""A vector index that is kept between searches: clusters with radii, searched exactly.

Each batch of vectors is dealt to the nearest of at most ``pivots`` of its own vectors, drawn by a hash of their ids; which
ones decides how much a search can skip, not what it finds. A cluster is stored with its centre and radius in a
``sources.store.Store``, in folders by cluster. No vector of a cluster scores more for a question than the centre does, plus
the question's length times the radius.

A search holds its questions as rows. The clusters of the greatest bounds are scored first, by matrix products; that gives
each question a score that its k-th best vector has at least. Then clusters whose bound reaches it are scored, and no
others. Scores and ranks are those of ``retrieval.dense``.

Defined results: null vectors take no part; shorter vectors get zeros, longer ones lose what is beyond ``width``; equal
vectors and repeated ids count each; an empty index finds nothing. Centres of all clusters, ``pivots`` a batch, are sent to
all tasks; ``Store.compact`` leaves them as they are, a new index of all vectors has fewer.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import Store
from ..storage import cut
from .ranking import DIGITS, top_k
from .retrieval import ID_TYPES, are_few, bettered, few, unit, vectors_of

BUCKETS, FIRST, TOGETHER = 64, 2, 4096
#: Room for the rounding of bounds, relative to the lengths that they are made of.
ROOM = 1e-9


def packed(rows: np.ndarray) -> pa.Array:
    """A list of numbers a row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def shape(column: pa.Array, width: int, normalized: bool) -> np.ndarray:
    made = vectors_of(column, width).astype(np.float64)
    return unit(made) if normalized else made


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, width: int = 64, normalized: bool = True, pivots: int = 1024):
        self.spark, self.width, self.normalized, self.pivots = spark, width, normalized, pivots
        self.shaped = partial(shape, width=width, normalized=normalized)
        self.store = Store(spark, f"{path}/vectors", key="chunk_idx", name="clusters", by=("bucket",))
        self.centres = Store(spark, f"{path}/centres", key="cluster", name="centres")

    def known(self, rows: DataFrame, name: str) -> DataFrame:
        """(name, embedding) of what has a vector."""
        return rows.select(name, F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL")

    def add(self, vectors: DataFrame) -> int:
        """More vectors (chunk_idx, embedding)."""
        rows = self.known(vectors.withColumn("chunk_idx", F.col("chunk_idx").cast("long")), "chunk_idx")
        chosen = rows.orderBy(F.xxhash64("chunk_idx"), "chunk_idx").limit(self.pivots).select("embedding").toArrow()  # ``pivots`` rows
        if not chosen.num_rows:
            return self.store.snapshot()[0]
        shaped, token = self.shaped, uuid.uuid4().hex
        pivots = self.spark.sparkContext.broadcast(self.shaped(chosen.column(0).combine_chunks()))

        def deal(batches):
            p = pivots.value
            squares = (p * p).sum(axis=1)
            for batch in (b.slice(at, TOGETHER) for b in batches for at in range(0, b.num_rows, TOGETHER)):
                v = shaped(batch.column(1))
                nearest = (squares[None, :] - 2 * v @ p.T).argmin(axis=1)
                yield pa.record_batch([batch.column(0), pa.array(nearest), pa.array(np.sqrt(((v - p[nearest]) ** 2).sum(axis=1))), packed(v)], names=["chunk_idx", "pivot", "distance", "embedding"])

        dealt = rows.mapInArrow(deal, "chunk_idx long, pivot long, distance double, embedding array<double>")
        dealt = dealt.withColumn("cluster", F.xxhash64(F.lit(token), "pivot")).withColumn("bucket", F.pmod("cluster", F.lit(BUCKETS)).cast("int"))
        version = self.store.add(dealt.select("cluster", "chunk_idx", "embedding", "distance", "pivot", "bucket").repartition("bucket", F.pmod(F.xxhash64("chunk_idx"), F.lit(8))).sortWithinPartitions("bucket", "cluster"))
        # centres are published last: vectors without one are not seen
        held = self.store.read().where(F.col("cluster") == F.xxhash64(F.lit(token), "pivot"))
        sizes = held.groupBy("cluster", "pivot").agg(F.max("distance").alias("radius"), F.count("*").alias("n"))
        own = pa.table({"pivot": pa.array(np.arange(len(pivots.value))), "centre": packed(pivots.value)})
        self.centres.add(sizes.join(F.broadcast(self.spark.createDataFrame(own)), "pivot").select("cluster", "centre", "radius", "n"))
        return version

    def questions(self, queries: DataFrame) -> DataFrame:
        return cut(self.known(queries, "query_id"))

    def reached(self, asked: DataFrame, centres, most: int | None = None) -> DataFrame:
        """(query_id, cluster): the ``most`` clusters of the greatest bounds, or all whose bound reaches the question's ``least``."""
        shaped, kind = self.shaped, dict(asked.dtypes)["query_id"]

        def run(batches):
            ids, c, radius = centres.value
            for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
                q = shaped(batch.column(1))
                size = np.sqrt((q * q).sum(axis=1))[:, None]
                bound = q @ c.T + size * radius[None, :] + ROOM * size * (np.sqrt((c * c).sum(axis=1)) + radius)[None, :]
                if most is None:
                    row, at = np.nonzero(bound >= batch.column(2).fill_null(-np.inf).to_numpy()[:, None] - 10.0**-DIGITS)
                else:
                    at = np.argsort(-bound, axis=1, kind="stable")[:, :most]
                    row, at = np.repeat(np.arange(len(q)), at.shape[1]), at.ravel()
                yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(ids[at])], names=["query_id", "cluster"])

        return asked.mapInArrow(run, f"query_id {kind}, cluster long")

    def scored(self, asked: DataFrame, some: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_idx, score): of the pairs ``some`` (query_id, cluster) the k best of a cluster's part; a cell holds a part of the questions that a cluster is asked by, and takes its vectors one after another."""
        kind = dict(asked.dtypes)["query_id"]
        part = F.floor((F.row_number().over(Window.partitionBy("cluster").orderBy("query_id")) - 1) / TOGETHER).cast("int")
        first = some.withColumn("part", part).join(few(asked.select("query_id", "embedding")), "query_id")
        parts = first.groupBy("cluster").agg(F.collect_set("part").alias("parts"))
        first = first.select("cluster", "part", F.lit(0).alias("kind"), "query_id", F.lit(None).cast("long").alias("chunk_idx"), "embedding")
        buckets = [r[0] for r in some.select(F.pmod("cluster", F.lit(BUCKETS)).cast("int")).distinct().collect()]  # BUCKETS at most
        held = self.store.read().where(F.col("bucket").isin(*buckets)).join(few(parts), "cluster")
        later = held.select("cluster", F.explode("parts").alias("part"), F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("query_id"), "chunk_idx", "embedding")
        shaped = self.shaped

        def run(batches):
            cell, ids, q, best, items = None, [], [], None, None

            def done():
                if best is not None:
                    width = best.shape[1]
                    yield pa.record_batch([pa.array([i for i in ids for _ in range(width)], ID_TYPES[kind]), pa.array(items.ravel()), pa.array(best.ravel())], names=["query_id", "chunk_idx", "score"])

            for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
                key = np.stack([batch.column(j).to_numpy().astype(np.int64) for j in range(3)])
                edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
                for a, b in zip(edges, edges[1:], strict=False):
                    now, rows = tuple(key[:2, a]), batch.slice(a, b - a)
                    if now != cell:
                        yield from done()
                        cell, ids, q, best, items = now, [], [], None, None
                    m = shaped(rows.column(5))
                    if not key[2, a]:
                        ids, q = ids + rows.column(3).to_pylist(), [*q, m]
                        continue
                    if best is None:
                        whole = np.concatenate(q)
                        best, items = np.zeros((len(whole), 0)), np.zeros((len(whole), 0), np.int64)
                    best, items = bettered(best, items, whole @ m.T, rows.column(4).to_numpy(), k)
            yield from done()

        dealt = first.union(later).repartition("cluster", "part").sortWithinPartitions("cluster", "part", "kind")
        return dealt.mapInArrow(run, f"query_id {kind}, chunk_idx long, score double")

    def rounds(self, queries: DataFrame, k: int):
        """The questions, the pairs of the first round, what they give, and the pairs of the second."""
        asked = self.questions(queries)
        table = self.centres.read().toArrow() if self.centres.versions() else None  # ``pivots`` rows a batch
        if table is None or k <= 0 or not table.num_rows:
            return None
        held = (table.column("cluster").to_numpy(), vectors_of(table.column("centre").combine_chunks(), self.width), table.column("radius").to_numpy())
        centres = self.spark.sparkContext.broadcast(held)
        first = cut(self.reached(asked, centres, FIRST))
        found = cut(self.scored(asked, first, k))
        least = top_k(found, k).where(F.col("rank") == k).select("query_id", F.round("score", DIGITS).alias("least"))
        second = self.reached(asked.join(few(least), "query_id", "left"), centres)
        return asked, first, found, cut(second.join(F.broadcast(first) if are_few(first) else first, ["query_id", "cluster"], "left_anti"))

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """(query_id, chunk_idx, score, rank) for queries (query_id, embedding)."""
        made = self.rounds(queries, k)
        if made is None:
            return self.spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, chunk_idx long, score double, rank int")
        asked, _, found, second = made
        return top_k(found.unionByName(self.scored(asked, second, k)), k).select("query_id", "chunk_idx", "score", "rank")

    def shares(self, queries: DataFrame, k: int = 20) -> dict:
        """Pairs of a question and a vector, and how many of them a search scores."""
        asked, first, _, second = self.rounds(queries, k)
        sizes = self.centres.read().select("cluster", "n")
        return {"pairs": asked.count() * (sizes.agg(F.sum("n")).first()[0] or 0), "scored": first.union(second).join(few(sizes), "cluster").agg(F.sum("n")).first()[0] or 0}
