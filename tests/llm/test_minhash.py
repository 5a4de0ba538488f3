import random

import numpy as np
import pytest

from docloom.llm import minhash as M

SCHEMA = "doc_id long, text string, digest string, node long, n int, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA).repartition(3)


def plain_set(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in text.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    return {" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


def brute(rows, percent=80):
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)), i == least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def varied(rng, text, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in text]


WORDS = [f"w{k}" for k in range(2000)]


def corpus(seed=5):
    """Groups of near copies, a star whose copies are linked to their origin alone, a chain, a passage that many share, and odd texts."""
    rng, rows = random.Random(seed), []
    add = lambda words: rows.append((len(rows) * 7 % 997, " ".join(words)))
    for _ in range(10):
        base = [rng.choice(WORDS) for _ in range(rng.randint(120, 300))]
        for _ in range(rng.randint(1, 8)):
            add(varied(rng, base, rng.choice([0, 0.005, 0.02, 0.05])))
    base = [rng.choice(WORDS) for _ in range(200)]
    add(base)
    for k in range(40):
        at = 4 * k + 10
        add([*base[:at], *[rng.choice(WORDS) for _ in range(18)], *base[at + 18 :]])
    for k in range(30):  # each near the next
        add((base * 2)[100:][10 * k : 10 * k + 150] + [f"x{j}" for j in range(10 * k, 10 * k + 150)])
    shared = [rng.choice(WORDS) for _ in range(150)]
    for _ in range(40):
        add(shared + [rng.choice(WORDS) for _ in range(rng.randint(40, 150))])
    return [*rows, (2000, None), (2001, ""), (2002, " \n\t"), (2003, "One"), (2004, "oNE"), (2005, "a b"), (2006, "b a"), (2007, "É x y z"), (2008, "é x y z"), rows[0], rows[0], (None, rows[1][1]), (None, "alone of all"), (None, None)]


def test_words_are_read_in_pieces():
    text = "Aé b\tC\n" * 5000 + "end"
    assert (M.word_hashes(text, 100) == M.word_hashes(text)).all() and len(M.word_hashes(text)) == 15001
    assert len(M.shingle_set("x " * 100_000, 4)) == 1 and len(M.word_hashes("y" * 3_000_000)) == 1


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        matched = []
        for _ in range(60):
            items = rng.integers(0, 1 << 64, 1000, dtype=np.uint64)
            common = int(1000 * 2 * share / (1 + share)) // 2 * 2
            a, b = np.unique(items[:1000]), np.unique(np.r_[items[:common], rng.integers(0, 1 << 64, 1000 - common, dtype=np.uint64)])
            matched.append((M.signature(a) == M.signature(b)).mean())
        assert abs(np.mean(matched) - share) < 0.03


@pytest.mark.parametrize(("crowd", "crowd_bytes"), [(4096, 1 << 25), (5, 1 << 25), (4096, 3000)])
def test_as_brute_force(spark, crowd, crowd_bytes):
    """Also with long lists as one group, and with groups in rounds over all tasks."""
    rows = corpus()
    assert got(M.groups(frame(spark, rows), crowd=crowd, crowd_bytes=crowd_bytes)) == brute(rows)


def test_crowds_link_across_clusters(spark):
    """Two clusters whose centres are not linked, joined by members alone; pivots come one at a time, and in many parts."""
    rng = random.Random(2)
    base = [rng.choice(WORDS) for _ in range(300)]
    rows = [(k, " ".join(base[3 * k : 3 * k + 180])) for k in range(36)] + [(100 + k, " ".join(varied(rng, base[:180], 0.01))) for k in range(10)] + [(300, "q " + " ".join(rng.choice(WORDS) for _ in range(60)))]
    nodes = spark.createDataFrame([(k, bytearray(M.signature(M.shingle_set(t, 4)).tobytes()), bytearray(M.shingle_set(t, 4).tobytes())) for k, (_, t) in enumerate(rows)], "node long, sig binary, items binary")
    crowds = nodes.selectExpr("0L AS g", "node")
    links = M.crowd_links(M.cut(crowds), M.cut(nodes), M.cut(nodes), 80, pivots=1)
    least = {r.u: r.root for r in M.components(links).collect()}
    want = brute(rows)
    assert sorted((i, rows[least.get(k, k)][0]) for k, (i, _) in enumerate(rows)) == sorted((i, c) for i, _, c, _ in want)


def test_cells_compare_all(spark):
    rng = random.Random(4)
    base = [rng.choice(WORDS) for _ in range(200)]
    texts = [" ".join(varied(rng, base, 0.03)) for _ in range(60)]
    sets = M.cut(spark.createDataFrame([(k, bytearray(M.shingle_set(t, 4).tobytes())) for k, t in enumerate(texts)], "node long, items binary"))
    crowds, chosen = sets.selectExpr("1L AS g", "node"), spark.createDataFrame([(1, k) for k in range(0, 60, 7)], "g long, pivot long")
    plain = [plain_set(t) for t in texts]
    alike = lambda a, b: len(plain[a] & plain[b]) / len(plain[a] | plain[b])
    for options in ({}, {"held_bytes": 2000, "cell_nodes": 7}):
        rows = M.compared(crowds, chosen, sets, 80, 60, **options).collect()
        close = {(r.node, p) for r in rows for p in r.close}
        assert close == {(a, b) for a in range(60) for b in range(0, 60, 7) if a != b and 0.6 <= alike(a, b) < 0.8}
        linked = {r.node for r in rows if r.linked is not None}
        assert {a for a in range(60) if any(a != b and alike(a, b) >= 0.8 for b in range(0, 60, 7))} <= linked
        assert all(alike(r.node, r.linked) >= 0.8 or {r.node, r.linked} <= set(range(0, 60, 7)) for r in rows if r.linked is not None)


def test_postings_are_prefixes(spark):
    """What shares too little is posted nowhere; nodes of equal signatures post the same entries."""
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 64, 300, dtype=np.uint64) for _ in range(20)]
    sets += [np.r_[sets[0][:290], rng.integers(0, 1 << 64, 10, dtype=np.uint64)]]
    nodes = spark.createDataFrame([(k, bytearray(M.signature(s).tobytes())) for k, s in enumerate(sets)], "node long, sig binary")
    posted = M.postings(nodes).collect()
    assert {r.node for r in posted} == {0, 20} and len(posted) <= 2 * (M.COORDINATES - M.MATCHES + 1)
    assert {(r.u, r.v) for r in M.candidates(nodes).collect()} == {(20, 0)}


def test_odd_tables(spark):
    empty = frame(spark, [(1, "a")]).where("false")
    assert M.groups(empty).collect() == [] and M.groups(empty).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = [(None, None), (3, None), (3, ""), (1, "just one text here"), (1, "just one text here")]
    assert got(M.groups(frame(spark, rows))) == brute(rows)
    assert sorted(r.doc_id for r in M.one_of_each(frame(spark, [(2, "a b c d e"), (1, "A b c d e"), (9, None)])).collect()) == [1, 9]
