import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, cell int, src string, key string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "y", "z", len(t or "")) for i, t, s in rows], SCHEMA)


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Water-filling by rounds: whatever is above three sizes stops there, the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in done]
        share = {s: (total - sum(done.values())) * weight[s] / sum(weight[x] for x in left) for s in left} if left else {}
        above = [s for s in left if share[s] > 3 * sizes[s]]
        if not above:
            return done | share
        done |= {s: 3 * sizes[s] for s in above}


def brute(rows):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want, out = targets(sizes), []
    for s, size in sizes.items():
        budget = int(want[s] + 1e-9)
        epochs, rest = (budget // size, budget % size) if size else (0, 0)
        own = sorted((hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:15], -1 if i is None else i, count(t)) for i, t, x in rows if x == s)
        before = 0
        for _, i, n in own:
            out.append((i, n, size, round(want[s], 6), epochs * n + max(0, min(n, rest - before))))
            before += n
    return sorted(out)


def made(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 900]))), rng.choice(["hot"] * 4 + ["a", "b", "ü", None])) for i in range(n)]


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


@pytest.mark.parametrize("rows", [made(300), made(40, 2), [(1, None, "a"), (2, "", None), (3, "x\ty\n", "a")], [(5, "a b", "s"), (5, "a b", "s"), (5, "c", "s"), (None, "q r", "s")], [(1, None, None)]])
def test_as_brute_force(spark, rows):
    assert got(M.mix(frame(spark, rows), cell_bits=4)) == sorted((-1 if x[0] is None else x[0], *x[1:]) for x in brute(rows))


def test_rows_without_ids_are_dealt_out(spark):
    """Many of them, of several sizes, in the order of their sizes; and no cell holds them all."""
    rng = random.Random(5)
    rows = [(None, " ".join(rng.choices("abcdef", k=rng.choice([0, 2, 3, 3, 3, 7]))), "s") for _ in range(400)] + made(100, 6) + [(900 + k, "x " * k, "s") for k in range(30)]
    assert got(M.mix(frame(spark, rows), cell_bits=2)) == sorted((-1 if x[0] is None else x[0], *x[1:]) for x in brute(rows))
    assert got(M.mix(frame(spark, rows), cell_bits=2)) == got(M.mix(frame(spark, rows).repartition(7), cell_bits=2))


def test_a_very_long_text(spark):
    rows = [(1, "word " * 600_000, "a"), (2, "w", "a"), (3, "x y", "b")]
    out = {r.doc_id: r for r in M.mix(frame(spark, rows)).collect()}
    assert out[1].size == 600_000 and sum(r.taken for r in out.values()) == sum({r.source_size: int(r.target + 1e-9) for r in out.values()}.values())
    assert sum(count(r.text) for r in M.mixed_documents(frame(spark, rows)).collect()) == sum(r.taken for r in out.values())


def test_budgets_hold(spark):
    rows = M.mix(frame(spark, made(300))).collect()
    for size in {r.source_size for r in rows}:
        own = [r for r in rows if r.source_size == size]
        assert sum(r.taken for r in own) == int(own[0].target + 1e-9)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)


def test_no_rows(spark):
    assert M.mix(frame(spark, []).limit(0)).count() == 0
    assert M.mixed_documents(frame(spark, []).limit(0)).count() == 0


def test_documents_come_as_often_as_taken(spark):
    rows = [(i, t and t.replace("w", f"w{i}\t", 3), s) for i, t, s in made(60, 3)]
    docs = frame(spark, rows)
    out = M.mixed_documents(docs, cell_bits=4)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + count(r.text)
        assert r.n_chars == len(r.text) and dict((i, t) for i, t, _ in rows)[r.doc_id].startswith(r.text)
    assert words == {r.doc_id: r.taken for r in M.mix(docs, cell_bits=4).collect() if r.taken}


def test_given_weights(spark):
    docs = frame(spark, [(i, "w " * 10, "ab"[i % 2]) for i in range(20)])
    shares = M.mix(docs, weigh=lambda s: s.withColumn("weight", F.when(F.col("src") == "sa", 3).otherwise(1))).groupBy("source_size", "target").count().collect()
    assert sorted(r.target for r in shares) == [50.0, 150.0]
