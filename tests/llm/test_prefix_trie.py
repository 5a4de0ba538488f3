import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from docloom.llm import prefix_trie as P

SCHEMA = "conv_id long, turn int, role string, text string, d long, `range` string, rep string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)


def brute(rows, block=100, most=5):
    """Every prefix in full, one after another."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(t)] for c, t in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        made[c] = own.get(c - int(np.fmod(c, block)), [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    out = []
    for path, members in nodes.items():
        below, todo = [], [path]
        while todo:
            below.append(todo.pop())
            todo += children[below[-1]]
        ended = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(path))
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), len(children[path]), sum(not children[x] for x in below), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed=1):
    rng, rows = random.Random(seed), []
    said = ["", "a", "ä b", "hello", "the same long text " * 5, None]
    for c in [*range(60), *range(100, 130), *range(250, 260), 300, 399, -5, -100, -105, 10**15, 10**15 + 1]:
        n = rng.choice([1, 2, 3, 4, 6, 9])
        for t in range(n):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(said)))
    for c in (41, 45, 99, 199):
        rows += [(c, t, "user", "many turns") for t in range(70)]
    return [*rows, *rows[:9], (None, 1, "user", "x"), (None, None, None, None), (77, 1, None, "word " * 20_000), (78, 1, "", "word " * 20_000)]


def test_as_brute_force(spark):
    rows = corpus()
    assert got(P.trie(frame(spark, rows), parts=3)) == brute(rows)


def test_without_rebuilding(spark):
    """Other ids, and conversations as they are."""
    rows = [r for r in corpus(3) if r[0] is None or r[0] < 45]
    assert got(P.trie(frame(spark, rows), most=0)) == brute(rows, most=0)


@pytest.mark.parametrize("bits", [1, 4])
def test_collisions_are_split(spark, bits):
    """Hashes of a few bits collide all the time; the nodes stay the same."""
    rows = [(c, t, "user", f"{(c * c + t * (c % 4)) % 5}") for c in range(24) for t in range(1 + c % 4)]
    assert got(P.trie(frame(spark, rows), bits=bits)) == brute(rows)


def test_a_conversation_over_many_ranges(spark):
    """Its turns are numbered and summed in several tasks."""
    rows = [(7, t, "user", f"turn {t % 3}") for t in range(3000)] + [(8, t, "user", f"turn {t % 3}") for t in range(2500)] + [(5, 1, "user", "x")]
    turns = frame(spark, rows)
    scans = P.stored(P.scanned(turns.select("conv_id", "turn", "role", "text"), 2, 64, 6))
    starts = P.range_starts(scans, 2)
    assert {r.conv_id for r in starts.collect()} == {7, 8} and starts.where("offset > 0").count() >= 3
    whole = P.numbered(scans, starts, 2).where("conv_id = 7").orderBy("k").collect()
    assert [r.k for r in whole] == list(range(1, 3001))
    for w in range(2):
        sums = np.cumsum(np.array([P.turn_hash("user", f"turn {t % 3}", w, 64) * pow(int(P.base_of(w)), t + 1, 1 << 64) % (1 << 64) for t in range(3000)], np.uint64))
        assert [r[f"p{w}"] for r in whole] == sums.view(np.int64).tolist()
    assert got(P.trie(turns, most=0, parts=6).where("depth > 2498 AND depth < 2503 OR depth < 2")) == [r for r in brute_long(rows) if 2498 < r[1] < 2503 or r[1] < 2]


def brute_long(rows):
    """Of three conversations of which the second is the first's beginning."""
    sizes = [len(f"turn {t % 3}") for t in range(3000)]
    digest = lambda *ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    out = [(5, 0, None, 3, 2, 2, sum(sizes[:2500]), digest()), (5, 1, 5, 1, 0, 1, 0, digest(5))]
    for d in range(1, 3001):
        out.append((7, d, 5 if d == 1 else 7, 2 if d <= 2500 else 1, d < 3000, 1, sum(sizes[d - 1 : 2500]), digest(*([8] if d == 2500 else [7] if d == 3000 else []))))
    return sorted(out, key=repr)


def test_sums_above_in_cells(spark):
    nodes = spark.createDataFrame([(c, d, c * d) for c in (1, 2) for d in range(1, 50)], "conv_id long, d long, own long")
    for cell in (4, 4096):
        assert {(r.conv_id, r.d): r.above for r in P.sums_above(nodes, cell).collect()} == {(c, d): sum(c * x for x in range(1, d)) for c in (1, 2) for d in range(1, 50)}


def test_odd_tables(spark):
    assert P.trie(frame(spark, [(1, 1, "a", "b")]).where("false")).collect() == []
    assert P.trie(frame(spark, [(None, 1, "a", "b")])).collect() == []
    for rows in ([(1, 1, "a", "b")], [(i, 0, None, None) for i in range(5)], [(100, 1, "a", "b"), (101, 1, "a", "b")]):
        assert got(P.trie(frame(spark, rows))) == brute(rows)
