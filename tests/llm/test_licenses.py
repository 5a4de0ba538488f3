import random
from difflib import SequenceMatcher

from docloom.llm import licenses as L


def common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for k, y in enumerate(b, 1):
            old, row[k] = row[k], old + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_increasing_runs():
    rng = random.Random(1)
    for _ in range(300):
        x = rng.sample(range(30), rng.randint(0, 12))
        k = L.increasing(x)
        assert all(x[a] < x[b] and a < b for a, b in zip(k, k[1:], strict=False))
        assert len(k) == common(x, sorted(x))


def test_alignments_are_common_subsequences():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= common(a, b)


def test_edited_templates_align_almost_as_well_as_can_be():
    rng = random.Random(3)
    for text in L.TEMPLATES.values():
        words = L.words_of(text)
        assert len(L.align(words, words)) == len(words)
        for _ in range(10):
            edited = [w if rng.random() > 0.08 else "zzz" for w in words if rng.random() > 0.04]
            best = common(edited, words)
            assert len(L.align(edited, words)) >= 0.85 * best - 2
            assert SequenceMatcher(None, edited, words, autojunk=False).ratio() > 0


def test_scan(spark):
    mit, filler = L.TEMPLATES["MIT"], "etwas anderes hier the of and " * 200
    edited = mit.replace("hereby ", "").replace("merge", "MERGE!").replace("Software", "Program", 2)
    rows = [
        (1, filler + mit + filler), (2, edited), (3, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (4, "my license plate, the apache helicopter"), (5, None), (6, ""), (6, ""),
        (7, "LICENSED*** UNDER%%% THE*** APACHE LICENSE,### VERSION 2.0."), (8, "license " * 5000), (9, L.TEMPLATES["GPL-3.0-line"] + "\n" + L.TEMPLATES["GPL-3.0-line"]),
    ]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, found string, coverage double")
    got = {}
    for r in L.scan(docs).collect():
        got.setdefault(r.doc_id, []).append([(x.license, round(x.coverage, 2)) for x in r.found])
    assert got[1] == [[("MIT", 1.0)]] and got[2][0][0][0] == "MIT" and 0.8 <= got[2][0][0][1] < 1
    assert got[3] == [[("CC-BY-NC-4.0-line", 1.0), ("MIT-line", 1.0)]] and got[4] == [[]] and got[5] == [[]] and got[6] == [[], []]
    assert got[7] == [[("Apache-2.0-line", 1.0)]] and got[8] == [[]] and len(got[9][0]) == 2
    r = next(r for r in L.scan(docs).collect() if r.doc_id == 1)
    assert rows[0][1][r.found[0].start : r.found[0].end] == mit[:-1]
    assert L.summary(L.scan(docs)).where("doc_id = 3").first().n_licenses == 2 and L.scan(docs.limit(0)).count() == 0


def test_no_single_word_is_needed():
    scan = L.Scanner(L.TEMPLATES, 0.8).scan
    mit = L.TEMPLATES["MIT"]
    for odd in ("sub-license", "sublicence", "sub-\nlicense"):
        found = scan("w " * 300 + mit.replace("sublicense", odd) + " x" * 300)
        assert [x["license"] for x in found] == ["MIT"] and found[0]["coverage"] > 0.98
    for name, word in (("GPL", "redistribute"), ("ISC", "hereby"), ("Unlicense", "unencumbered")):
        assert [x["license"] for x in scan(L.TEMPLATES[name].replace(word, "zzz"))] == [name]


def test_interleaved_notices_align_whole():
    words = L.TEMPLATES["MIT"].split()
    text = "before " * 500 + " ".join(f"{w} col{k} col{k}b" for k, w in enumerate(words)) + " after" * 500
    found = L.Scanner(L.TEMPLATES, 0.8).scan(text)
    assert [(x["license"], x["coverage"]) for x in found] == [("MIT", 1.0)]
    assert text[found[0]["start"] : found[0]["end"]].startswith("Permission") and text[: found[0]["end"]].endswith("Software")


def everywhere(scanner, text):
    """Every template aligned from every position of the text, without gates or seeds."""
    at = [(m.start(), m.end()) for m in L.WORD.finditer(text)]
    words, found = [text[a:b].lower() for a, b in at], []
    for name, template in scanner.templates.items():
        for p in range(-len(template), len(words)):
            low, pairs = scanner.settled(words, template, p)
            if pairs and len(pairs) >= scanner.min_coverage * len(template):
                found.append((len(pairs), len(pairs) / len(template), low + pairs[0][0], low + pairs[-1][0] + 1, name))
    return [(x[4], round(x[1], 9), at[x[2]][0], at[x[3] - 1][1]) for x in L.disjoint(found)]


def edited(rng, text, share):
    """Some words replaced, left out or followed by another."""
    out = []
    for w in text.split():
        r = rng.random()
        out += [] if r < share / 3 else ["zzz"] if r < 2 * share / 3 else [w, "qqq"] if r < share else [w]
    return " ".join(out)


def test_as_brute_force():
    """The same licenses as from every position, in all texts of filler and edited notices; the same spans and coverage in nearly all, for where an alignment is as good in two ways, the ends may differ by some words."""
    rng, scanner = random.Random(4), L.Scanner(L.TEMPLATES, 0.8)
    filler = "the of and software license copy use any to with this notice permission red in version free".split()
    short = [n for n, t in L.TEMPLATES.items() if len(L.words_of(t)) < 45]
    same = 0
    for k in range(30):
        parts = []
        for _ in range(rng.randint(1, 3)):
            parts.append(" ".join(rng.choices(filler, k=rng.randint(0, 12))))
            parts.append(edited(rng, L.TEMPLATES[rng.choice(short if k % 5 else list(L.TEMPLATES))], rng.choice([0, 0.05, 0.15, 0.3])))
        text = "\n".join(parts)
        got, want = [(x["license"], round(x["coverage"], 9), x["start"], x["end"]) for x in scanner.scan(text)], everywhere(scanner, text)
        assert [x[0] for x in got] == [x[0] for x in want], text
        assert all(a[2] < b[3] and b[2] < a[3] for a, b in zip(got, want, strict=True))
        same += got == want
    assert same >= 28


def test_recall_of_edited_notices():
    """The figures the README gives: shares of notices found whose words were edited to this extent."""
    rng, scanner = random.Random(6), L.Scanner(L.TEMPLATES, 0.8)
    for share, least in ((0.05, 0.99), (0.1, 0.97), (0.15, 0.9)):
        found = total = 0
        for name, text in L.TEMPLATES.items():
            for _ in range(12 if len(L.words_of(text)) > 12 else 0):
                made = edited(rng, text, share)
                spans = scanner.scan("so it goes on " * 20 + made + " and more of it" * 20)
                total, found = total + 1, found + any(x["license"].split("-")[0] == name.split("-")[0] for x in spans)
        assert found >= least * total, (share, found / total)


def test_many_lines_are_scanned_in_time():
    import time

    text = "\n".join(L.TEMPLATES["CC-BY-4.0-line"] for _ in range(38_000))  # 1 MB
    began = time.process_time()
    found = L.Scanner(L.TEMPLATES, 0.8).scan(text)
    assert len(found) == 38_000 and time.process_time() - began < 60


def test_ties():
    twice = {"B": "alpha beta gamma delta", "A": "alpha beta gamma delta", "C": "alpha beta gamma delta epsilon"}
    scan = L.Scanner(twice, 0.8).scan
    assert [x["license"] for x in scan("x alpha beta gamma delta y")] == ["A"]  # as long as C's match, but whole; A before B
    assert [x["license"] for x in scan("alpha beta gamma delta epsilon")] == ["C"]
