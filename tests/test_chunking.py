import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking as C


def column(spark, texts, c):
    return [r.c for r in spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", c.alias("c")).orderBy("id").collect()]


def windows(text, size, overlap):
    if not text:
        return []
    out, at = [], 0
    while True:
        out.append(text[at : at + size])
        if at + size >= len(text):
            return out
        at += size - overlap


def test_fixed_is_windows(spark):
    texts = [None, "", "a", "a" * 20, "a" * 21, "é😀" * 30, "word " * 200]
    for size, overlap in ((20, 5), (20, 0), (7, 6)):
        assert column(spark, texts, C.fixed(F.col("text"), size, overlap)) == [windows(t, size, overlap) for t in texts]
    with pytest.raises(ValueError):
        C.fixed(F.col("text"), 5, 5)


def test_sentences(spark):
    got = column(spark, ["A b. C d! E? F", "  ", None, "one", "x.y z. \n w"], C.by_sentences(F.col("text"), 2))
    assert got == [["A b. C d!", "E? F"], [], [], ["one"], ["x.y z. w"]]
    assert column(spark, ["A. B. C."], C.by_sentences(F.col("text"), 0)) == [["A.", "B.", "C."]]


def directly(text, size, separators, overlap=0, stripped=False):
    """The same by recursion on the text."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    usable = [k for k, s in enumerate(separators) if not s or s in text]
    if not usable or not separators[usable[0]]:
        step, out = size - overlap, []
        for at in range(0, len(text), step):
            part = text[at : at + size]
            out.append(part.strip() if stripped else part)
            if overlap and at + size >= len(text):
                break
        return [x for x in out if x.strip()]
    s, rest, groups = separators[usable[0]], separators[usable[0] + 1 :], []
    for part in (p.strip() for p in text.split(s)):
        if part and groups and len(groups[-1]) + len(s) + len(part) <= size:
            groups[-1] += s + part
        elif part:
            groups.append(part)
    return [y for g in groups for y in directly(g, size, rest, overlap, stripped)]


def test_recursive_is_recursion():
    rng = random.Random(5)
    for _ in range(600):
        text = "".join(rng.choices(["ab", "c", " ", ". ", "\n", "\n\n", "; ", "longerword" * 3], k=rng.randint(0, 60)))
        for size in (10, 25, 60):
            assert C.pieces(text, size, C.RECURSIVE) == directly(text, size, C.RECURSIVE)
            assert C.pieces(text, size, C.ADVANCED, 4, True) == directly(text, size, C.ADVANCED, 4, True)
            assert all(len(p) <= size for p in C.pieces(text, size, C.RECURSIVE))


def test_recursive_column(spark):
    assert column(spark, [None, "", "abc", "a b c d"], C.recursive(F.col("text"), 3)) == [[], [], ["abc"], ["a b", "c d"]]
    assert C.pieces("a" * 7, 3, ()) == ["aaa", "aaa", "a"]


POLICY = """# Quy chế
Mở đầu
## CHƯƠNG II: Đào tạo
### Điều 6. Học phần
Nội dung sáu
#### Khoản 1. Chung
Một
**Điều 10. Khác**
Mười
# Phụ lục
Cuối"""


def test_sections_and_ids(spark):
    docs = spark.createDataFrame([("reg_01", POLICY, "x"), ("none", "", "y"), ("null", None, "z")], "doc string, text string, no string")
    rows = {r.section_ord: r for r in C.sections(docs, "doc", "text").collect()}
    assert rows[1].path == ["Quy chế"] and rows[1].chapter is None
    assert rows[3].path == ["Quy chế", "CHƯƠNG II: Đào tạo", "Điều 6. Học phần"] and rows[3].chapter_number == "2" and rows[3].article_number == "6"
    assert rows[4].clause_number == "1" and rows[5].article_number == "10" and rows[5].clause_number is None
    assert rows[6].path == ["Phụ lục"] and rows[6].chapter is None
    ids = {r.section_ord: r.chunk_id for r in C.heading_chunks(docs, "doc", "text").collect()}
    assert ids[3] == "reg_01__chapter_2__article_6__part_1"
    assert ids[4] == "reg_01__chapter_2__article_6__clause_1__part_1"


def test_long_sections_are_split(spark):
    docs = spark.createDataFrame([("d", "# T\n" + "word " * 300)], "doc string, text string")
    rows = C.heading_chunks(docs, "doc", "text", size=300).collect()
    assert len(rows) > 4 and all(len(r.retrieval_content) <= 300 and r.retrieval_content.startswith("[SECTION]\nDocument: T\n\n") for r in rows)
    assert sorted(r.part_index for r in rows) == list(range(1, len(rows) + 1)) and {r.total_parts for r in rows} == {len(rows)}
    kids = C.parent_child_chunks(docs, "doc", "text", parent_size=600, child_size=120).collect()
    assert all(len(r.content) <= 120 and r.content in r.parent_content and r.chunk_id.startswith(r.parent_id) for r in kids)


def test_plain_sections_keep_a_loose_chapter(spark):
    docs = spark.createDataFrame([("d", "Chương mới về\ntext\nMục 3 x\nmore")], "doc string, text string")
    assert [r.path for r in C.sections(docs, "doc", "text", advanced=False).orderBy("section_ord").collect()] == [["Chương mới về"], ["Chương mới về", "Mục 3 x"]]
    assert [r.path for r in C.sections(docs, "doc", "text").orderBy("section_ord").collect()] == [[], ["Mục 3 x"]]


def test_contextual(spark):
    rows = spark.createDataFrame([("T", "C", None, " body "), ("T", None, "", "  ")], "title string, chapter string, article string, content string")
    got = C.contextual(rows).collect()
    assert [r.context_header for r in got] == ["Document: T. Chapter: C. Article: N/A. Audience: sinh viên."]
    assert got[0].retrieval_content == got[0].context_header + "\n\nbody"


def test_texts_reach_python_a_few_at_a_time(spark):
    """Long texts and what is made of them are not held 10,000 rows at a time, as in Arrow batches."""
    from docloom.functions import structure as S
    from docloom.sources import pages as P

    text = F.col("text")
    docs = spark.createDataFrame([("# a\nb",), (None,)], "text string")
    for made in (S.outline(text), S.outline(text, False), S.normalize_headings(text), C.recursive(text, 10), P.html_text(text), P.main_content(text)):
        df = docs.select(made.alias("x"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
        assert len(df.collect()) == 2
