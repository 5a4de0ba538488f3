"""The kept vector index against the search of all pairs."""

import numpy as np
import pytest

from docloom.operators import retrieval as R
from docloom.operators.vector_index import VectorIndex


def shown(df):
    return sorted((r.query_id, r["rank"], r.chunk_idx, round(r.score, 7)) for r in df.collect())


def frame(spark, rows, name="chunk_idx", start=0):
    return spark.createDataFrame([(start + k, None if v is None else [float(x) for x in v]) for k, v in enumerate(rows)], f"{name} long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("normalized", [True, False])
def test_as_dense(spark, tmp_path, normalized):
    """By batch; with nulls, equal vectors, zeros, and short and long ones."""
    rng = np.random.default_rng(1)
    index = VectorIndex(spark, str(tmp_path / "index"), width=8, normalized=normalized, pivots=12)
    parts = [frame(spark, [*rng.normal(size=(150, 8)), None, np.zeros(8)]), frame(spark, [*np.repeat(rng.normal(size=(20, 8)), 3, axis=0), np.ones(3), np.ones(11)], start=1000)]
    asked = frame(spark, [*rng.normal(size=(9, 8)), None, np.zeros(8)], "query_id")
    assert index.search(asked, 5).count() == 0
    index.add(parts[0].limit(0))
    for n in (1, 2):
        index.add(parts[n - 1])
        whole = parts[0] if n == 1 else parts[0].union(parts[1])
        for k in (1, 6):
            assert shown(index.search(asked, k)) == shown(R.dense(whole, asked, k, normalized=normalized))
    assert index.search(asked.limit(0), 3).count() == 0


def test_clusters_are_skipped(spark, tmp_path):
    """On vectors in clusters most are never scored."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    rows = np.repeat(centres, 60, axis=0) + rng.normal(size=(1800, 16)) * 0.05
    index = VectorIndex(spark, str(tmp_path / "index"), width=16, pivots=100)
    index.add(frame(spark, rows))
    asked = frame(spark, rows[::90], "query_id")
    shares = index.shares(asked, 10)
    assert shares["pairs"] == 1800 * 20 and shares["scored"] < 0.25 * shares["pairs"]
    assert shown(index.search(asked, 10)) == shown(R.dense(frame(spark, rows), asked, 10))
