import zlib

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import queries, toxicity as X


def test_held_out_rule(spark):
    rows = spark.range(200).select("id", X.held_out(F.col("id")).alias("h"), X.held_out(F.lit(None).cast("long")).alias("n")).collect()
    assert [r.h for r in rows] == [zlib.crc32(str(r.id).encode()) % 4 == 2 for r in rows] and not any(r.n for r in rows)


def test_accuracy_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.op8_toxicity(spark, folder).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    clean = [r for r in rows if not r.toxic]
    assert len(toxic) > 80
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_features_do_not_depend_on_neighbours():
    texts = ["héllo wörld", "", None, "x" * 3_000_000, "a\nb\tc " * 30, "short", "", "e"]
    rng = np.random.default_rng(1)
    for filled in (60_000, 3 << X.BITS):
        table = np.zeros(3 << X.BITS, np.uint16)
        table[rng.permutation(len(table))[:filled]] = rng.integers(1, 500, filled)
        model = X.Model(table, 0.01 * rng.normal(size=500), 0.1)
        assert np.allclose(model.score(texts), np.concatenate([model.score([t]) for t in texts]))
        assert model.score([None])[0] == model.score([""])[0]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "q", 0.5) for i, t in rows], "doc_id long, text string, toxic string, score double")


def test_learns_words(spark):
    rows = [(k, ("you idiot " if k % 3 == 0 else "you friend ") + f"word{k} and more text") for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(0, 1), (9999, 1), (5, None)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = X.train(docs, labels)
    got = {r.doc_id: r.predicted for r in X.score(docs, model).collect()}
    assert got == {k: int(k % 3 == 0) for k in range(300)}
    kept = X.clean_documents(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [k for k in range(300) if k % 3]
    again = X.train(docs.repartition(7), labels)
    assert np.array_equal(again.table, model.table) and np.allclose(again.weights, model.weights)


def plain_features(text):
    """Hash of every n-gram, one after another; zeros stand on either side."""
    points = [0] * 8 + [32 if 9 <= ord(c) <= 13 else ord(c) for c in (text or "").lower()] + [0] * 8
    out, full = [], 1 << 32
    for at in range(len(points) - 8 + 1):
        for k, size in enumerate((4, 6, 8)):
            h = 0
            for c in points[at : at + size]:
                h = (h * X.STEP + c) % full
            h = (h ^ h >> 15) * X.MIX[k] % full
            out.append((h >> 32 - X.BITS) + (k << X.BITS))
    return out


def plain_scores(rows, labelled, n_features, min_count, alpha, l2, rounds):
    """Naive Bayes ratios and a logistic model on dense arrays, by dictionaries and loops."""
    from collections import Counter

    counted = {i: Counter(plain_features(t)) for i, t in rows}
    seen = {0: Counter(), 1: Counter()}
    for i, y in labelled.items():
        seen[y].update(counted[i].keys())
    n = {y: sum(x == y for x in labelled.values()) for y in (0, 1)}
    rated = []
    for f in sorted(set(seen[0]) | set(seen[1])):
        total = seen[0][f] + seen[1][f]
        ratio = np.log((seen[1][f] + alpha) / (n[1] + 2 * alpha)) - np.log((seen[0][f] + alpha) / (n[0] + 2 * alpha))
        if total >= min_count and ratio != 0:
            rated.append((-abs(ratio) * np.sqrt(total), f, ratio))
    chosen = sorted(rated)[:n_features]
    matrix = lambda ids: np.array([[np.log1p(counted[i][f]) * r for _, f, r in chosen] for i in ids])
    x, y = matrix(labelled), np.array([float(v) for v in labelled.values()])
    w, b = np.zeros(len(chosen)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for k in range(1, rounds + 1):
        miss = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        g = np.append(x.T @ miss + l2 * w, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    ids = [i for i, _ in rows]
    return dict(zip(ids, 1 / (1 + np.exp(-(matrix(ids) @ w + b))), strict=True))


def test_scores_as_a_plain_classifier(spark):
    """Characters of several bytes and beyond the first 65,536, white space, capitals, empty and null texts."""
    words = ["naïve", "straße", "schön", "Ärger", "😀ok", "dumm", "idiote", "ÉCOLE", "der", "les", "tab\there", "line\nend"]
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(rng.choice(words, rng.integers(3, 20))) + (" du Idiot!" if k % 3 == 0 else "")) for k in range(60)] + [(60, None), (61, "")]
    labelled = {k: int(k % 3 == 0) for k in range(40)}
    options = {"n_features": 200, "min_count": 4, "alpha": 0.5, "l2": 1e-3, "rounds": 60}
    model = X.train(frame(spark, rows), spark.createDataFrame(list(labelled.items()), "doc_id long, toxic int"), **options)
    want = plain_scores(rows, labelled, **options)
    got = {r.doc_id: r.score for r in X.score(frame(spark, rows), model).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    assert len({round(x, 3) for x in want.values()}) > 10


def test_repeated_rows_and_clashing_names(spark):
    rows = [(k % 20, ("bad " if k % 2 else "good ") + f"text number {k % 20}") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(20)] * 2, "doc_id long, toxic int, text string")
    got = X.score(frame(spark, rows), X.train(frame(spark, rows), labels)).collect()
    assert len(got) == 40 and all(r.predicted == r.doc_id % 2 for r in got)


def test_nothing_is_rejected_without_both_labels(spark):
    docs = frame(spark, [(1, "a"), (2, None), (None, "b")])
    for labels in ([], [(1, 0)], [(1, 1)], [(77, 1)]):
        model = X.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert X.clean_documents(docs, model).count() == 3


def test_without_labels(spark):
    docs = frame(spark, [(1, "a"), (2, None), (None, "b")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.train(docs, none)
    assert {r.score for r in X.score(docs, model).collect()} == {0.5}
    one = X.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in X.score(docs, one).collect()} == {round(1 / 3, 6)}
    assert X.score(docs.limit(0), one).count() == 0
