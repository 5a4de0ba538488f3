"""Exact top-k inner products by a dual-tree search over cover trees.

Candidates and queries are cut into blocks of bounded size and every block gets a cover tree, stored once in the shared
folder. Every block of queries meets every block of candidates in some task: blocks of queries are broadcast if they are
few enough, and otherwise the pairs of blocks are dealt out. A pair of nodes is pruned if no inner product between them
can reach the worst k-th score of the query node's group: the product of the centres plus what the covering radii allow.
Near the leaves, each query's own k-th score counts. The most promising nodes come first, so that these scores rise early.
Blocks' results are merged by rank.

A tree can only prune where vectors cluster. Vectors that are random in many dimensions are all about equally far from
each other: then every vector is a child of the root, every query looks at each of them, and the search costs what
comparing all pairs costs.

Defined results: vectors that are null, or hold a null or non-finite component, take no part, nor do rows without an id;
rows stay apart even if they agree; rows of the query's own id are no candidates of it, and several query rows of an id
share one list; a shorter vector is padded with zeros; ties go to the smaller id; with fewer than k candidates all are
returned; an empty table gives an empty result; other columns are not looked at. Scores are exact below 2**53, and modulo
2**64 beyond.
"""

from __future__ import annotations

import math
import pickle
from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEAF = 16
#: Nodes that are expanded before scores are looked at again; queries in one group; points that are placed at once.
STEP, GROUP, PLACED = 64, 32, 512


@dataclass
class Node:
    at: int  # the row of the centre
    center: np.ndarray
    norm: float
    radius: float  # largest distance of a point below from the centre
    rows: np.ndarray  # all points below
    children: list[Node] = field(default_factory=list)
    kids: tuple[np.ndarray, np.ndarray] | None = None  # centres' rows and radii of the children


def net(points: np.ndarray, squares: np.ndarray, rows: np.ndarray, reach: float) -> list[np.ndarray]:
    """``rows`` in parts: each holds rows within ``reach`` of its first, and the first ones are further apart than that. The first row is the first of the first part."""
    centers, owner, limit = rows[:1], np.zeros(len(rows), np.int64), reach * reach
    for low in range(0, len(rows), PLACED):
        part = rows[low : low + PLACED]
        far = squares[part][:, None] + squares[centers][None, :] - 2 * points[part] @ points[centers].T
        own, least = far.argmin(axis=1), far.min(axis=1)
        loose = np.flatnonzero(least > limit)
        while len(loose):
            c = part[loose[0]]
            gap = ((points[part[loose]] - points[c]) ** 2).sum(axis=1)
            near = gap <= limit
            own[loose[near]] = len(centers)
            centers = np.append(centers, c)
            loose = loose[~near]
        owner[low : low + len(part)] = own
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    parts = np.split(rows[order], cuts)
    return [np.concatenate([[c], p[p != c]]) for c, p in zip(centers, parts, strict=True)]


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """Children cover balls of half their parent's radius, with centres further apart than that; the parent's centre is the first child's. A node of LEAF points or fewer, or of equal ones, has no children."""
    squares = (points * points).sum(axis=1)

    def node(rows: np.ndarray) -> Node:
        center = points[rows[0]]
        far = ((points[rows] - center) ** 2).sum(axis=1).max() if len(rows) > 1 else 0.0
        return Node(int(rows[0]), center, float(np.sqrt(center @ center)), float(np.sqrt(far)), rows)

    root = node(np.arange(len(points)) if rows is None else rows)
    todo = [root]
    while todo:
        n = todo.pop()
        if len(n.rows) <= LEAF or n.radius == 0:
            continue
        n.children = [node(r) for r in net(points, squares, n.rows, n.radius / 2)]
        n.kids = np.array([c.at for c in n.children]), np.array([c.radius for c in n.children])
        todo += n.children
    return root


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, in floating point where that is exact."""
    if np.abs(a).max(initial=0) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


NONE = np.iinfo(np.int64).min


class Search:
    """The best k candidates of each query, over all trees it is shown. ``pairs`` counts inner products of vectors, ``bounds`` those of centres."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, tree: Node, k: int):
        self.ids, self.vectors, self.tree, self.k = ids, vectors, tree, k
        self.points = vectors.astype(np.float64)
        self.norms = np.sqrt((self.points * self.points).sum(axis=1))
        self.scores = np.full((len(ids), k), NONE, np.int64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        self.pairs = self.bounds = 0

    def hopeless(self, bound: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether no product of at most ``bound`` (by query or for all of them) matters to ``rows``; an equal score may still win by its id."""
        return bound + np.abs(bound) * 1e-9 + 1e-6 < self.scores[rows, -1]

    def show(self, ids: np.ndarray, vectors: np.ndarray, tree: Node) -> None:
        points = vectors.astype(np.float64)
        norms = np.sqrt((points * points).sum(axis=1))
        stack = [(self.tree, [tree])]
        while stack:
            q, nodes = stack.pop()
            self.bounds += len(nodes)
            at, radii = np.array([n.at for n in nodes]), np.array([n.radius for n in nodes])
            bound = points[at] @ q.center + q.norm * radii + norms[at] * q.radius + q.radius * radii
            worst = self.scores[q.rows, -1].min()
            kept = np.flatnonzero(bound + np.abs(bound) * 1e-9 + 1e-6 >= worst)
            nodes = [nodes[k] for k in kept]
            if not nodes:
                continue
            wide = [n for n in nodes if n.children and n.radius > q.radius]
            if q.children and wide:  # the wider side goes down
                narrow = [n for n in nodes if not (n.children and n.radius > q.radius)]
                stack.append((q, narrow + [c for n in wide for c in n.children]))
                continue
            small = [c for c in q.children if not c.children]
            stack += [(c, nodes) for c in q.children if c.children]
            rows = np.concatenate([c.rows for c in small]) if small else q.rows if not q.children else q.rows[:0]
            for low in range(0, len(rows), GROUP):
                self.group(rows[low : low + GROUP], nodes, ids, vectors, points, norms)

    def group(self, rows: np.ndarray, nodes: list[Node], ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, norms: np.ndarray) -> None:
        """A small group of queries against ``nodes`` and what is below them: each query's own bound counts."""

        def bounded(at: np.ndarray, radii: np.ndarray) -> np.ndarray:
            self.bounds += len(rows) * len(at)
            return self.points[rows] @ points[at].T + self.norms[rows][:, None] * radii[None, :]

        stack = [(nodes, bounded(np.array([n.at for n in nodes]), np.array([n.radius for n in nodes])))]
        while stack:
            held, bound = stack.pop()
            alive = np.flatnonzero(~self.hopeless(bound.T, rows).all(axis=1))
            alive = alive[np.argsort(-bound[:, alive].max(axis=0), kind="stable")]
            if len(alive) > STEP:
                stack.append(([held[k] for k in alive[STEP:]], bound[:, alive[STEP:]]))
                alive = alive[:STEP]
            leaves = [held[k].rows for k in alive if not held[k].children]
            inner = [held[k] for k in alive if held[k].children]
            if inner:
                at, radii = (np.concatenate(x) for x in zip(*(n.kids for n in inner), strict=True))
                stack.append(([c for n in inner for c in n.children], bounded(at, radii)))
            if leaves:
                self.compare(rows, ids, vectors, np.concatenate(leaves))

    def compare(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, others: np.ndarray) -> None:
        for low in range(0, len(others), 4096):
            own = others[low : low + 4096]
            scores = products(self.vectors[rows], vectors[own])
            self.pairs += scores.size
            mask = (ids[own][None, :] == self.ids[rows][:, None]) | (scores < self.scores[rows, -1:])
            some = ~mask.all(axis=1)
            if not some.any():
                continue
            scores, mask, into = scores[some], mask[some], rows[some]
            keep = ~mask.all(axis=0)
            s = np.concatenate([self.scores[into], np.where(mask, NONE, scores)[:, keep]], axis=1)
            i = np.concatenate([self.found[into], np.where(mask, np.iinfo(np.int64).max, ids[own][None, :])[:, keep]], axis=1)
            order = np.lexsort((i, -s.astype(np.float64) if np.abs(s[s != NONE]).max(initial=0) < 2**53 else ~s), axis=1)[:, : self.k]
            self.scores[into], self.found[into] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def packed(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    return pickle.dumps((ids, vectors, cover_tree(vectors.astype(np.float64))), protocol=5)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), values.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def integer_vectors(rows: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<long>) of the valid rows."""
    x = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null").where(~F.exists("x", bad))
    return valid.select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


#: Searches that a task holds at once, and bytes of query blocks that are broadcast.
HELD, MOST = 8, 64 << 20


def blocks(vectors: DataFrame, n: int, width: int, block: int, name: str) -> DataFrame:
    """(``name``): trees over ``block`` rows or fewer each. Rows are dealt out evenly, whatever their ids, and a task holds one block at a time."""

    def index(batches):
        ids, points, held = [], [], 0
        for b in batches:
            for low in range(0, b.num_rows, block):
                part = b.slice(low, block)
                if held and held + part.num_rows > block:
                    yield pa.record_batch([pa.array([packed(np.concatenate(ids), np.concatenate(points))], pa.binary())], names=[name])
                    ids, points, held = [], [], 0
                ids.append(part.column(0).to_numpy())
                points.append(matrix(part.column(1), width))
                held += part.num_rows
        if held:
            yield pa.record_batch([pa.array([packed(np.concatenate(ids), np.concatenate(points))], pa.binary())], names=[name])

    return cut(vectors.repartition(max(1, math.ceil(n / block))).mapInArrow(index, f"{name} binary"))


def top_k(rows: DataFrame, is_query, k: int = 10, scale: int = 1024, block: int = 8192, query_block: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``is_query`` (a Column of vec_id) picks, the k best others."""
    vectors = cut(integer_vectors(rows, scale, id_col, vector_col))
    asked = F.coalesce(is_query(F.col("vec_id")), F.lit(False))
    size = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.sum(asked.cast("long")), F.lit(0))).first()
    n, width, n_queries = size[0], max(1, size[1]), size[2]
    trees = blocks(vectors, n, width, block, "tree")
    queries = blocks(vectors.where(asked), n_queries, width, query_block, "queries")
    queries = F.broadcast(queries) if 8 * width * n_queries <= MOST else queries

    def run(batches):
        held: OrderedDict[int, Search] = OrderedDict()

        def told(search: Search):
            row, col = np.nonzero(search.scores != NONE)
            return pa.record_batch([pa.array(search.ids[row]), pa.array(search.found[row, col]), pa.array(search.scores[row, col])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for tree, query in zip(batch.column(0), batch.column(1), strict=True):
                blob = query.as_py()
                if (key := hash(blob)) not in held:
                    if len(held) == HELD:
                        yield told(held.popitem(last=False)[1])
                    held[key] = Search(*pickle.loads(blob), k)
                held[key].show(*pickle.loads(tree.as_py()))
        for search in held.values():
            yield told(search)

    found = trees.crossJoin(queries).mapInArrow(run, "query_id long, vec_id long, score long")  # of blocks, not of rows
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
