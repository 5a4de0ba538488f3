import random

import numpy as np
import pytest
import xxhash

from docloom.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, root long, first_id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def plainly(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def grouped(prints, bits=3):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= bits:
                root[find(a)] = find(b)
    return [find(k) for k in range(len(prints))]


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.randint(150, 400))]
        for _ in range(rng.randint(1, 25)):
            copy = list(text)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 3 % 1001 + 1, " ".join(copy)))
    return [*rows, (5000, None), (5001, ""), (5002, " \n"), (5003, "One"), (5004, "oNE"), (5005, "a b"), (5006, "É x y"), (5007, "é x y"), rows[0], rows[0]]


def test_fingerprints(spark):
    texts = [t for _, t in corpus()] + ["word " * 200_000]
    for t in texts[:-1]:
        assert S.fingerprint(t) == plainly(t)
    assert S.fingerprint(texts[-1]) == S.fingerprint("word word word")


def test_groups_as_brute_force(spark):
    rows = corpus()
    prints = [plainly(t) for _, t in rows]
    roots = grouped(prints)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    want = sorted((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots, strict=True))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in S.groups(frame(spark, rows)).collect()) == want


def test_a_chain_is_one_group(spark):
    prints = [(1 << (2 * k)) - 1 for k in range(30)]  # each two bits from the next
    edges = S.links(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").repartition(3))
    assert {r.root for r in S.components(edges).collect()} == {0}


@pytest.mark.parametrize("full", [8, 4096])
def test_forest_connects_what_all_links_connect(monkeypatch, full):
    monkeypatch.setattr(S, "FULL", full)
    rng = np.random.default_rng(full)
    for _ in range(20):
        base = rng.integers(0, 1 << 12, 1, dtype=np.uint64)
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 24, (60, 4), dtype=np.uint64), axis=1) & rng.integers(0, 1 << 24, 60, dtype=np.uint64)
        prints = np.unique(base ^ flips)
        index = {int(p): k for k, p in enumerate(prints)}
        roots = list(range(len(prints)))

        def find(k, roots=roots):
            while roots[k] != k:
                k = roots[k]
            return k

        for a, b in S.forest(prints, list(range(24)), 3):
            for x, y in zip(a, b, strict=True):
                roots[find(index[int(x)])] = find(index[int(y)])
        want = grouped([int(p) for p in prints])
        mine = [find(k) for k in range(len(prints))]
        assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_blocks_cover_all_pairs():
    rng, masks = random.Random(1), [m & ((1 << 64) - 1) for m in S.block_masks()]
    assert len(masks) == 20
    for _ in range(2000):
        flip = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not flip & m for m in masks)


def test_a_large_group_of_near_copies_gives_few_links(spark):
    rng = random.Random(9)
    prints = {0}
    while len(prints) < 600:
        prints.add(sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    edges = S.links(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long"))
    assert edges.count() < 20 * 600
    assert {r.root for r in S.components(edges).collect()} == {min(p - (1 << 64) if p >> 63 else p for p in prints)}


@pytest.mark.parametrize(("hot", "seen"), [(30, 1), (40, 2), (200, 1)])
def test_hot_buckets_are_cut_without_losing_links(spark, hot, seen):
    """Fingerprints that share all but a few bits, and others: the same groups as by all pairs."""
    rng = random.Random(hot)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(20, 44), rng.randint(0, 9))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    frame_of = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").repartition(5)
    rooted = {r.u: r.root for r in S.components(S.links(frame_of, hot=hot, seen=seen)).collect()}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    mine, want = [rooted.get(p, p) for p in signed], grouped(prints)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want)) > 20


def test_free_bits():
    masks = S.block_masks()
    for which in (0, 7, 19):
        free = S.free_bits(which, masks, 3)
        assert len(free) in (31, 32, 33) and all(not masks[which] >> b & 1 for b in free)
        for part in range(4):
            deep = S.free_bits(S.deeper(which, part, masks, 3), masks, 3)
            assert deep == [b for b in free if b not in free[part::4]]
            again = S.free_bits(S.deeper(S.deeper(which, part, masks, 3), 2, masks, 3), masks, 3)
            assert again == [b for b in deep if b not in deep[2::4]]


def test_one_of_each_keeps_rows_not_ids(spark):
    """Different texts without ids or of one id all stay; a copy goes even if another row of its id stays."""
    docs = frame(spark, [(None, "aa bb cc dd ee"), (None, "ff gg hh ii jj"), (None, "kk ll mm nn oo"), (5, "pp qq rr ss tt"), (5, "uu vv ww xx yy"), (3, "some words that are here"), (9, "some words that are here"), (9, "zz yy xx ww vv uu")])
    for one_of in (S.one_of_each, S.one_of_similar):
        kept = sorted((str(r.doc_id), r.text) for r in one_of(docs).collect())
        assert kept == sorted([("None", "aa bb cc dd ee"), ("None", "ff gg hh ii jj"), ("None", "kk ll mm nn oo"), ("5", "pp qq rr ss tt"), ("5", "uu vv ww xx yy"), ("3", "some words that are here"), ("9", "zz yy xx ww vv uu")])


def test_one_of_each(spark):
    rows = corpus()
    docs = frame(spark, rows)
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {r.component_id for r in S.groups(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert S.groups(docs.limit(0)).count() == 0 and S.one_of_each(docs.limit(0)).count() == 0


def test_null_ids(spark):
    rows = S.groups(frame(spark, [(None, "a b c d"), (4, "a b c d"), (None, "x y z w")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("4", "4"), ("None", "4"), ("None", "None")]


def jaccard_groups(texts, least=0.8):
    """Groups by 5-word Jaccard similarity, all pairs; equal to a walk over all links."""
    cut = [(t or "").encode().lower().split() for t in texts]
    sets = [{b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in cut]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and both >= least * (len(sets[a]) + len(sets[b]) - both):
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    return root


def near_corpus():
    """Copies at about 0.8 to 0.95, and pairs just below."""
    rng, rows = random.Random(11), []
    words = [f"w{k}" for k in range(3000)]
    for _ in range(30):
        text = [rng.choice(words) for _ in range(rng.randint(100, 400))]
        rows.append(text)
        for share in (0.005, 0.01, 0.02, 0.03):
            copy = list(text)
            for k in rng.sample(range(len(copy)), max(1, int(share * len(copy)))):
                copy[k] = rng.choice(words)
            rows.append(copy)
    rng.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)] + [(900, None), (901, ""), (902, "a b"), (903, "A  B")]


def test_similar_texts_leave_one(spark):
    rows = near_corpus()
    roots, least = jaccard_groups([t for _, t in rows]), {}
    for (i, _), g in zip(rows, roots, strict=True):
        least[g] = min(i, least.get(g, i))
    docs = frame(spark, rows).repartition(3)
    kept = S.one_of_similar(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert S.one_of_each(docs).count() > len(least)  # three bits don't find them
    assert S.one_of_similar(docs.limit(0)).count() == 0


def crowded(seed):
    """Near copies of one text, some of them only linked through others; texts that share a long passage but nothing else; others."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(5000)]
    base = rng.choices(words, k=300)
    passage = rng.choices(words, k=120)
    rows = []
    for k in range(90):
        copy = list(base)
        for at in rng.sample(range(300), rng.choice([1, 2, 4, 6, 9])):
            copy[at] = rng.choice(words)
        rows.append(copy)
    for k in range(60):
        rows.append(passage + rng.choices(words, k=90))
    chain = rng.choices(words, k=200)
    for k in range(25):
        chain = chain[6:] + rng.choices(words, k=6)
        rows.append(list(chain))
    rows += [rng.choices(words, k=50) for _ in range(20)]
    rng.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)] + [(500, None), (501, "")]


@pytest.mark.parametrize(("crowd", "pivots"), [(6, 2), (30, 16)])
def test_crowds_as_all_pairs(spark, monkeypatch, crowd, pivots):
    monkeypatch.setattr(S.crowd_links, "__defaults__", (S.CROWD, pivots))
    rows = crowded(crowd)
    roots, least = jaccard_groups([t for _, t in rows]), {}
    for (i, _), g in zip(rows, roots, strict=True):
        least[g] = min(i, least.get(g, i))
    assert 50 < len(least) < 140
    kept = S.one_of_similar(frame(spark, rows).repartition(3), crowd=crowd, seen=1)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_runs_stay_whole(step):
    rng = np.random.default_rng(step)
    x = np.sort(rng.integers(0, 40, 200))
    whole = S.pa.record_batch([S.pa.array(x), S.pa.array(np.arange(200))], names=["a", "b"])
    parts = [p.column(0).to_numpy() for p in S.whole_runs(whole.slice(k, step) for k in range(0, 200, step))]
    assert np.array_equal(np.concatenate(parts), x) and all(a[-1] != b[0] for a, b in zip(parts, parts[1:], strict=False))
