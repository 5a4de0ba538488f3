import random
import re
from collections import Counter, defaultdict

import pytest

from docloom.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, "x", 1, "y") for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def brute(rows, least, most=2000):
    totals, counts = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                for p in range(len(words) - m + 1):
                    counts[lang][tuple(words[p : p + m])] += 1
    out = []
    for lang, of in counts.items():
        frequent = {g: f for g, f in of.items() if f >= least}
        found = []
        for g, a in frequent.items():
            if len(g) == 1 or any(len(x) > len(g) and 100 * f >= 100 * a and any(x[p : p + len(g)] == g for p in range(len(x))) for x, f in frequent.items()):
                continue
            score, _, left, right = min((1000 * a * totals[lang] // (of[g[:k]] * of[g[k:]]), k, of[g[:k]], of[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(seed=1):
    rng, rows = random.Random(seed), []
    common = ["the", "of", "New", "York", "city", "é", "Å", "x", "data-base", "\x1cs", "it's"]
    for _ in range(60):
        words = []
        for _ in range(rng.randint(0, 90)):
            words += rng.choice([["the"], ["New", "York", "city"], ["New", "York"], ["one", "two", "three", "four", "five", "six"], [rng.choice(common)], [f"w{rng.randint(0, 400)}"]])
            words[-1] += rng.choice(["", "", "", "", ".", ", ", "\n", "\t", "!?", ";:", "\x0b"])
        rows.append((" ".join(words), rng.choice(["en", "en", "de", None, ""])))
    return [*rows, (None, "en"), ("", "fr"), (" . , ", "fr"), ("a b", "fr"), rows[0], rows[0], ("go " * 300, "en"), ("stop. " * 200, "de")]


@pytest.mark.parametrize(("least", "options"), [(10, {}), (10, {"words": 50}), (3, {"words": 7, "cells": 64}), (10, {"cells": 8}), (300, {}), (10, {"most": 5})])
def test_as_brute_force(spark, least, options):
    """Also with runs of a few words, with sketches in which everything collides, and with counts of two bytes."""
    rows = corpus()
    got = C.collocations(frame(spark, rows), least=least, **options)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, options.get("most", 2000))


def test_long_texts_are_read_in_pieces():
    text = "Ab\tcd. " * 5000 + "é" * 300 + " end"
    some = list(C.words_of(text, 100))
    assert sum(some, []) == next(C.words_of(text)) and len(some) > 100
    assert sum(some, [])[:4] == [b"ab", b"cd", b".", b"ab"]


def test_sketches_never_underestimate(spark):
    """Whatever reaches the limit passes; of what doesn't, a wide sketch lets next to nothing through."""
    rng = random.Random(3)
    rows = [(" ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(3000)), "en") for _ in range(6)]
    texts = frame(spark, rows).select("lang", "text")
    merged = C.sketch(texts, 20, 2, 1 << 18)
    bits = {r.block: r.passes for r in merged.collect()}
    assert sorted(bits) == [0, 1, 2]
    grams = Counter()
    for text, _ in rows:
        words = text.split()
        grams.update((w,) for w in words)
        grams.update(zip(words, words[1:], strict=False))
    run = C.Run("en", [w.encode() for g in grams for w in (*g, ".")], 0)
    passed = Counter()
    for n, starts, hashes in run.lengths(2):
        fit = [True] * len(starts)
        for row in range(3):
            at = C.places(hashes, n, row, 1 << 18).tolist()
            fit = [f and bool(bits[row][p >> 3] >> (7 - (p & 7)) & 1) for f, p in zip(fit, at, strict=True)]
        for start, good in zip(starts, fit, strict=True):
            passed[tuple(run.vocabulary[int(run.ids[start + k])].as_py().decode() for k in range(n))] |= good
    frequent = {g for g, f in grams.items() if f >= 20}
    assert frequent and all(passed[g] for g in frequent)
    assert sum(passed[g] for g in grams if g not in frequent) <= 0.001 * len(grams)


def test_arithmetic_is_exact(spark):
    rows = [(10**13 - 1, 10**15 - 3, 10**13 + 7, 10**14 - 9), (100, 10**15, 100, 100), (3, 10, 3, 10**6), (10**9 + 7, 10**12 + 1, 10**10 + 1, 10**11 + 3)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = df.withColumn("s", C.quotient(df.a, df.n, df.l, df.r)).collect()
    assert [r.s for r in got] == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_odd_tables(spark):
    assert C.collocations(frame(spark, [("a", "en")]).where("false")).collect() == []
    assert C.collocations(frame(spark, [(None, None), ("", "en"), (" .,", "en")]), least=1).collect() == []
    rows = [("a b", None), ("A b", "und"), ("b\na", "und")]
    assert sorted(tuple(r) for r in C.collocations(frame(spark, rows), least=1).collect()) == brute(rows, 1)


def test_a_phrase_leaves_a_task_once():
    """Not once for each run of words, unless there are more phrases than are held."""
    import pyarrow as pa

    names = ["lang", "phrase", "m", "f"]
    runs = [pa.record_batch([pa.array(["en"] * 4 + ["fr"]), pa.array(["a", "b", "a b", f"rare{k}", "a"]), pa.array([1, 1, 2, 1, 1]), pa.array([k + 1, 2, 1, 1, 3])], names=names) for k in range(50)]
    empty = runs[0].slice(0, 0)
    want = Counter()
    for r in runs:
        for x in r.to_pylist():
            want[x["lang"], x["phrase"], x["m"]] += x["f"]
    for most in (1 << 19, 100, 40):
        rows = [x for b in C.added_up(iter([empty, *runs, empty]), most) for x in b.to_pylist()]
        got = Counter()
        for x in rows:
            got[x["lang"], x["phrase"], x["m"]] += x["f"]
        assert got == want and (most < 100 or len(rows) == len(want))
    assert list(C.added_up(iter([]))) == [] and list(C.added_up(iter([empty]))) == []
