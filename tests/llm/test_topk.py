import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import topk as K


def brute(rows, every, k):
    """Every valid row is a candidate of all queries of other ids, however often its id comes."""
    ok = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(1024 * float(np.float32(c))) for c in v]))
    lists = {}
    for q, a in ok:
        if q % every == 0:
            lists.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in ok if c != q)
    return sorted((q, n, c, -s) for q, found in lists.items() for n, (s, c) in enumerate(sorted(found)[:k], 1))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")


def made(seed, n=400, dim=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, dim))
    rows = [(i, (centers[i % 5] + 0.05 * rng.normal(size=dim)).tolist()) for i in range(n)]
    same = rows[3][1]
    return [(i, same if i % 4 == 0 else v) for i, v in rows]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("block", "queries"), [(30, 7), (8192, 8192)])
def test_as_brute_force(spark, seed, block, queries):
    rows = made(seed) + [(1000, None), (1010, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1020, [float("nan")] * 6), (1030, [float("inf")] * 6), (None, [1.0] * 6), (1040, [1.0, 2.0]), (1040, [0.5, 2.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in K.top_k(frame(spark, rows), lambda i: i % 10 == 0, 10, block=block, query_block=queries).collect())
    assert got == brute(rows, 10, 10)


def test_few_rows(spark):
    assert K.top_k(frame(spark, []).limit(0), lambda i: i % 2 == 0).count() == 0
    assert K.top_k(frame(spark, [(2, [1.0])]), lambda i: i % 2 == 0).count() == 0
    assert [tuple(r)[:3] for r in K.top_k(frame(spark, [(2, [1.0]), (1, [-1.0])]), lambda i: i % 2 == 0).collect()] == [(2, 1, 1)]
    assert K.top_k(frame(spark, [(1, [1.0])]), lambda i: F.lit(False)).count() == 0


def test_repeated_ids_as_sql(spark, tmp_path):
    """The registered SQL on rows that share ids, queries among them, and on rows that agree."""
    import duckdb

    from docloom.llm.queries import OP5_SQL, op5_topk

    rng = np.random.default_rng(8)
    rows = [(int(i), rng.normal(size=4).tolist()) for i in [0, 0, 100, 100, 100, 7, 7, 7, *range(8, 40), 200]]
    rows += [rows[2], rows[5], (None, [1.0] * 4), (300, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({OP5_SQL})").fetchall())
    assert sorted(tuple(r) for r in op5_topk(spark, str(tmp_path)).collect()) == want and len(want) == 30


def test_one_id_of_all_rows_is_dealt_out(spark):
    rng = np.random.default_rng(9)
    rows = [(5, v.tolist()) for v in rng.normal(size=(900, 3))] + [(10, [1.0, 0.0, 0.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in K.top_k(frame(spark, rows), lambda i: i % 10 == 0, 10, block=64).collect())
    assert got == brute(rows, 10, 10)


def test_trees_cover():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(300, 3)), np.repeat(rng.normal(size=(1, 3)), 200, axis=0), 0.01 * rng.normal(size=(300, 3))])
    tree, todo = K.cover_tree(points), []
    todo.append(tree)
    assert tree.children
    while todo:
        n = todo.pop()
        assert np.sqrt(((points[n.rows] - n.center) ** 2).sum(axis=1)).max() <= n.radius + 1e-12
        if n.children:
            assert sorted(np.concatenate([c.rows for c in n.children]).tolist()) == sorted(n.rows.tolist())
            centers = np.array([c.center for c in n.children])
            far = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2)) + 1e9 * np.eye(len(centers))
            assert all(c.radius <= n.radius / 2 for c in n.children) and far.min() > n.radius / 2
            assert np.array_equal(n.children[0].center, n.center)
            todo += n.children


def test_pruning_saves_work():
    rng = np.random.default_rng(4)
    v = np.floor(1024 * np.concatenate([rng.normal(size=(1, 8)) + 0.01 * rng.normal(size=(500, 8)) for _ in range(20)])).astype(np.int64)
    ids = np.arange(len(v))
    q = ids[::50]
    s = K.Search(q, v[q], K.cover_tree(v[q].astype(float)), 5)
    s.show(ids, v, K.cover_tree(v.astype(float)))
    assert s.pairs < 0.7 * len(q) * len(v)
    assert s.pairs + s.bounds < 0.3 * len(q) * len(v)  # a twentieth of the vectors share a cluster


def test_random_directions_can_not_be_pruned():
    """What the README says of the test tables: each vector is a node of its own, and each is looked at; results are right all the same."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 64))
    v = np.floor(1024 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    ids = np.arange(len(v))
    tree = K.cover_tree(v.astype(float))
    assert len(tree.children) > 1400
    s = K.Search(ids[::50], v[::50], K.cover_tree(v[::50].astype(float)), 10)
    s.show(ids, v, tree)
    assert 0.9 < s.bounds / (30 * 1500) < 1.2 and s.pairs < 0.6 * 30 * 1500
    for q, own in zip(ids[::50], s.found, strict=True):
        scores = v @ v[q]
        assert own.tolist() == sorted((c for c in range(1500) if c != q), key=lambda c: (-scores[c], c))[:10]


def test_large_integers_stay_exact():
    rng = random.Random(1)
    a = np.array([[rng.randint(-(2**28), 2**28) for _ in range(4)] for _ in range(5)])
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in a] for p in a]
    assert K.products(a, a).tolist() == want
