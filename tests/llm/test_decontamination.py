import random
import re

import pytest

from docloom.llm import decontamination as D

SCHEMA = "doc_id long, text string, item_id string, n_words int, n_chars long"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            x = words(text)
            n = min(window, len(x))
            for p in range(len(x) - n + 1) if n else ():
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == x[p : p + n]:
                        hit |= set(range(q, q + n))
                        found.add(item)
        out.append((i, len(w), len(hit), tuple(sorted(found, key=str))))
    return sorted(out)


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "x", 1, len(t or "")) for i, t in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string")


def made(seed, letters=3, n=40):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice("abcdefgh"[:letters]) for _ in range(k))
    return [(k, text(rng.randint(0, 40))) for k in range(n)], [(k, text(rng.randint(0, 14))) for k in range(12)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block", [5, 500_000])
def test_as_brute_force(spark, seed, block):
    docs, items = made(seed, 3 if seed % 2 else 8)
    docs += [(100, None), (101, "A-b! ÄÖ c"), (102, "  ")]
    items += [(50, None), (51, ""), (52, "äö"), (53, "ÄÖ C")]
    d, i = frames(spark, docs, items)
    for window in (4, 6):
        got = [(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in D.hits(d, i, window, block).collect()]
        assert sorted(got) == brute(docs, items, window)
        assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in D.hits(d, i, window, block).collect())


def test_longest_match_is_that_of_the_automaton():
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("ab") for _ in range(12))) for k in range(5)]
    a = D.build(items, 3)
    text = [rng.choice("abc").encode() for _ in range(200)]
    joined = [" " + " ".join(words(t)) + " " for _, t in items]
    for k, (_, size) in enumerate(a.walk(text), 1):
        longest = max((n for n in range(0, 13) if n <= k and any(" " + " ".join(x.decode() for x in text[k - n : k]) + " " in j for j in joined)), default=0)
        assert size == longest


def test_removal(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = " ".join(word() for _ in range(30))
    clean = " ".join(word() for _ in range(60)) + "!\n"
    docs = [(1, clean), (2, f"{clean} — {item.upper()}; {clean}"), (3, item), (4, None), (5, ""), (5, clean)]
    d, i = frames(spark, docs, [(1, item)])
    kept = {(r.doc_id, r.text): r for r in D.decontaminated(d, i).collect()}
    assert (1, clean) in kept and (5, clean) in kept and (4, None) in kept and (5, "") in kept
    assert not any(k[0] == 3 for k in kept)
    cut = next(t for k, t in kept if k == 2)
    assert cut == f"{clean} — ; {clean}" and kept[2, cut].n_chars == len(cut)
    assert D.decontaminated(d, i).columns == d.columns
    assert D.hits(D.decontaminated(d, i), i).agg({"n_hit": "sum"}).first()[0] == 0


@pytest.mark.parametrize("block", [12, 60])
def test_removal_with_several_blocks_is_as_with_one(spark, block):
    """Items in blocks of few words: what their ends leave behind is read again, and rows that agree or lack ids stay apart."""
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abc") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 9)))) for k in range(12)]
    docs = []
    for k in range(60):
        parts = [rng.choice(items)[1] if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 6))]
        docs.append((k % 9 or None, ", ".join(parts)))
    half = items[0][1].split()
    docs += [(70, f"zz {' '.join(half[:1])} {items[1][1]} {' '.join(half[1:])} zz " + "yy " * 40), (71, None), (71, None), (72, ""), docs[3], docs[3]]
    d, i = frames(spark, docs, items)
    one, several = (sorted((str(r.doc_id), str(r.text), r.n_chars) for r in D.decontaminated(d, i, 5, 0.7, b).collect()) for b in (100_000, block))
    assert several == one and 20 < len(one) < len(docs)
    assert D.decontaminated(d.limit(0), i, 5, 0.7, block).count() == 0


def test_a_very_long_text(spark):
    item = " ".join(f"w{k}" for k in range(20))
    text = "plain word " * 150_000 + item + " plain" * 100_000
    d, i = frames(spark, [(1, text)], [(5, item), (None, item)])
    r = D.hits(d, i).first()
    assert (r.n_words, r.n_hit, r.item_ids) == (400_020, 20, [5, None]) and D.decontaminated(d, i).first().n_chars == len(text) - len(item)


def test_empty_tables(spark):
    d, i = frames(spark, [(1, "a b")], [(1, "a b")])
    assert D.hits(d.limit(0), i).count() == 0
    r = D.hits(d, i.limit(0)).first()
    assert (r.n_words, r.n_hit, r.item_ids) == (2, 0, [])
    assert D.decontaminated(d, i.limit(0)).count() == 1


def test_null_ids_in_several_blocks(spark):
    """Ids come in one order, a null one as None, in one block and in many; words that end on a block's edge make no empty block."""
    words = [f"w{k} x{k} y{k}" for k in range(58)]
    items = [(None if k % 3 == 0 else k, w) for k, w in enumerate(words)]
    d, i = frames(spark, [(1, " ".join(words)), (2, "none of them")], items)
    one, several = ([r.item_ids for r in D.hits(d, i, 3, block_words=b).orderBy("doc_id").collect()] for b in (100_000, 6))
    assert one == several and one[0] == sorted({k for k, _ in items}, key=str) and one[1] == []
    assert len(list(D.blocks(i, "item_id", "text", 3, 3))) == 58
