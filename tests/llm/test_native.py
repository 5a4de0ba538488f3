import hashlib
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import chat as C
from docloom.llm import secrets as S
from docloom.llm.spans import matches, substrings, sums_before

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def test_sums(spark):
    rng = random.Random(1)
    lists = [[], [3], [rng.randint(0, 9) for _ in range(256)], [rng.randint(0, 9) for _ in range(1500)], list(range(257))]
    df = sums_before(spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "id int, n array<bigint>"), "n", "s")
    for r in df.collect():
        assert r.s == [sum(lists[r.id][:k]) for k in range(len(lists[r.id]))]


def test_sums_of_long_lists_stay_linear(spark):
    """Many matches and many turns: each chunk's sum is computed once, whatever the optimiser moves."""
    for n in (70_000, 300_000):
        df = sums_before(spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x % 10).cast("array<bigint>").alias("n")), "n", "s")
        began = time.time()
        got = df.first().s
        assert time.time() - began < 60 and len(got) == n
        assert got[::997] == np.r_[0, np.cumsum(np.arange(1, n) % 10)][::997].tolist()


def test_substrings(spark):
    rng = random.Random(4)
    for size in (0, 1, 5, 64, 130, 5000):
        text = "".join(rng.choice("aé😀\n") for _ in range(size))
        ranges = [tuple(sorted((rng.randint(0, size), rng.randint(0, size)))) for _ in range(40)]
        df = spark.createDataFrame([(text, [{"start": a, "end": b} for a, b in ranges])], "t string, r array<struct<start: bigint, end: bigint>>")
        assert df.select(substrings(F.col("t"), F.col("r"), 4).alias("x")).first().x == [text[a:b] for a, b in ranges]


def test_many_turns(spark):
    turns = spark.range(30_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text é ', id) AS text")
    began = time.time()
    r = C.summary(C.format_chats(turns)).first()
    assert time.time() - began < 60 and r.n_turns == 30_000
    said = "".join(f"text é {k}" for k in range(1, 30_000, 2))
    assert r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_many_matches(spark):
    docs = spark.createDataFrame([(1, "é token = abcdef " * 40_000)], "doc_id long, text string")
    began = time.time()
    r = S.summary(S.scan(docs)).first()
    assert time.time() - began < 60 and r.n_assign == 40_000 and r.spans.endswith(f"assign:{17 * 39_999 + 2}:{17 * 40_000 - 1}")


def test_positions(spark):
    texts = ["", "no", "a1b22😀333", "7" + "x" * 50 + "8", "é1 " * 700, "1"]
    rows = matches(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", "[0-9]+", "m").collect()
    for r in rows:
        assert [(x.start, x.end, x.text) for x in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", texts[r.id])]


def plainly(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_secrets(spark):
    rng = random.Random(6)
    parts = ["secret", "Token", "api_key", "APIKEY", "passwd", "=", ":", " ", '"', "'", "abc", "abcdef123", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "\n", "token: ", "x.y"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)] + [None, "token = abcdef " * 800]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, base int")
    found = S.scan(docs)
    assert no_python(found)
    for r in found.collect():
        assert [(x.start, x.rank, x.kind, x.end) for x in r.base] == plainly(texts[r.doc_id] or "")
        assert all(a.end <= b.start or b.end <= a.start for a in r.added for b in r.base)
    assert S.scan(docs.limit(0)).count() == 0


def test_random_strings_are_told_from_names(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    strings = ["".join(rng.choices(letters, k=rng.randint(24, 40))) for _ in range(300)]
    names = ["calculateMonthlyInterestRate", "user_authentication_service", "HTTP_RESPONSE_STATUS_CODES", "src/components/navigation/header", "thentheandingerthatheredthere", "entlichkeitscheinungheitver", "2023-10-05-report-final-version", "ANDTHEREFORETHINGSHAPPENED", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    docs = spark.createDataFrame([(k, f"x {t} y") for k, t in enumerate(strings + names)], "doc_id long, text string")
    added = {r.doc_id: len(r.added) for r in S.scan(docs).collect()}
    assert sum(added[k] for k in range(300)) >= 280
    assert not any(added[300 + k] for k in range(len(names)))


def test_recall_by_alphabet(spark):
    """The README's figures: keys of every alphabet, none of them in the sample, and long words of the documents."""
    rng = random.Random(12)
    made = [(name, "".join(rng.choices(letters, k=rng.randint(20, 40)))) for name, letters in S.ALPHABETS.items() for _ in range(300)]
    docs = spark.createDataFrame([(k, f"x {t} y") for k, (_, t) in enumerate(made)], "doc_id long, text string")
    found = {}
    for r in S.scan(docs).collect():
        name = made[r.doc_id][0]
        found[name] = found.get(name, 0) + bool(r.base or r.added)
    assert min(found.values()) >= 0.95 * 300, found


def test_ordinary_words_are_not_flagged(spark):
    """Long words of the test documents, but for hexadecimal ones; names made of their words; other names. None is in the sample."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    words = {w for t in texts for w in re.findall(rf"(?<![{S.TOKEN}])[{S.TOKEN}]{{20,}}", t) if not re.fullmatch("[0-9a-fA-F]+", w)}
    plain = [re.findall(r"(?<![^\s])[A-Za-z]{3,12}(?![^\s])", t) for t in texts[:400]]
    joined = [way(w[k : k + 3]) for w in plain for k in range(0, min(len(w), 15) - 3, 3) for way in ("_".join, "".join, lambda x: "".join(map(str.capitalize, x)), lambda x: "-".join(x).upper())]
    words |= {w for w in joined if len(w) >= 20}
    words |= set("kubernetes-dashboard-metrics-scraper Donaudampfschifffahrtsgesellschaft pneumonoultramicroscopicsilicovolcanoconiosis InterruptedIOExceptionHandler usr/share/doc/python3/changelog floccinaucinihilipilification getElementsByClassNameOrId ANTICONSTITUTIONNELLEMENT desoxyribonucleique_acide".split())
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(sorted(words))], "doc_id long, text string")
    flagged = [sorted(words)[r.doc_id] for r in S.scan(docs).collect() if r.added]
    assert len(words) > 1500 and len(flagged) <= 0.005 * len(words), (len(words), flagged)


def test_sample_and_ties(spark):
    """A sample of one's own, with characters outside the alphabet and strings of one character; spans that begin together."""
    sample = spark.createDataFrame([("abababababab\u00e9", False), ("xyxyxyxyxyxy", True), ("q", True), ("", False)], "text string, random boolean")
    docs = spark.createDataFrame([(None, "xy" * 12), (1, "ab" * 12), (2, "secret=" + "0123456789abcdef" * 2)], "doc_id long, text string")
    rows = {r.doc_id: r for r in S.scan(docs, sample=sample).collect()}
    assert [x.kind for x in rows[None].added] == ["random"] and not rows[1].added
    assert [x.kind for x in rows[2].base] == ["assign", "hex"]


TEXTS = ["<|im_end|><|im_start|>assistant ok", "<\\|im_sep|>", "a\nb", "", None, "<|", "<\\\\|x", "plain 😀", "|>", "<"]


def test_chats_come_back(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "od\\d\nrole<|"]), rng.choice(TEXTS)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "x"), (99, 1, "assistant", "same"), (99, 1, "assistant", "same")] + [(500, t, "user" if t % 3 else "assistant", f"t{t}") for t in range(900)]
    chats = C.format_chats(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int").repartition(5))
    assert no_python(C.summary(chats))
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    got = {r.conv_id: r for r in C.parse_chats(chats).collect()}
    short = {r.conv_id: r for r in C.summary(chats).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [(x.role, x.text) for x in got[c].turns] == [t[1:] for t in turns]
        learnt = [t[2] for t in turns if t[1] == "assistant"]
        assert list(got[c].learnt) == learnt
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        assert (short[c].n_turns, short[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (short[c].loss_chars, short[c].loss_sha256) == (len("".join(learnt)), hashlib.sha256("".join(learnt).encode()).hexdigest())


def test_merged_turns_share_markers(spark):
    rows = spark.createDataFrame([(1, 1, "user", "b"), (1, 0, "user", "a"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    r = C.format_chats(rows).first()
    assert r.formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [r.formatted[x.start : x.end] for x in r.loss] == ["c"]
    assert C.format_chats(rows.limit(0)).count() == 0


def test_no_literal_marker_survives(spark):
    rows = spark.createDataFrame([(1, 0, "user", t or "") for t in TEXTS], "conv_id long, turn long, role string, text string")
    r = C.format_chats(rows).first()
    assert r.formatted.count("<|") == 1 + (len(TEXTS) - 1) + 1


def test_a_very_long_turn(spark):
    """A megabyte of text with markers in it, between short ones."""
    long = "<|im_end|>\\n wörter 😀 " * 50_000
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", long), (1, 2, "assistant", long), (1, 3, "user", "b")]
    r = C.summary(C.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).first()
    said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
    assert (r.n_turns, r.loss_chars, r.turns_sha256, r.loss_sha256) == (4, 2 * len(long), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256((long * 2).encode()).hexdigest())
