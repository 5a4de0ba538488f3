import pytest
from pyspark.sql import functions as F

from docloom.functions import frontmatter as M
from docloom.functions import text as T
from docloom.operators import cleaning as L


def one(spark, c, text):
    return spark.createDataFrame([(text,)], "t string").select(c(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "value"),
    [("I", 1), ("iv", 4), ("XII", 12), ("MCMXCIV", 1994), ("IIX", 8), ("", None), ("A", None), (" v ", 5)],
)
def test_roman(spark, text, value):
    assert one(spark, T.roman, text) == value


@pytest.mark.parametrize(("text", "label"), [("6", "6"), ("II", "2"), ("12A", "12a"), ("12a.", "12a"), ("Phần một", "phan_mot")])
def test_number_label(spark, text, label):
    assert one(spark, T.number_label, text) == label


def test_slugs(spark):
    assert one(spark, T.slug, "Điều 6. Học phần!") == "dieu_6_hoc_phan"
    assert one(spark, T.slug, "...") == "sec" and one(spark, T.url_slug, " A  b/ć ") == "a-b" and one(spark, T.url_slug, "") == "document"
    assert one(spark, lambda c: T.slug(c, 5), "abcd efg") == "abcd"


def test_headings(spark):
    assert one(spark, T.clean_heading, "## **Điều 1** [x](y)  __z__") == "Điều 1 x z"
    assert one(spark, T.normalize_whitespace, "a  \n\n\n\n\nb\n") == "a\n\n\nb\n"
    assert one(spark, T.normalize_whitespace, " \n ") == "" and one(spark, T.normalize_whitespace, None) in ("", None)


def test_boilerplate(spark):
    text = "### Mục lục\n[Xem thêm →](/a)\nLọc:\nTrang chủ > x\nkeep [Toggle](#)this\n[[email protected]](/cdn-cgi/l/email-protection#12)"
    assert one(spark, L.remove_boilerplate, text) == "keep this\n[email protected]"


def test_repeated_headings(spark):
    text = "# **A**\n\nFPT University\n# a\n# A ##\ntext\n# A\n## A"
    df = spark.createDataFrame([(1, text, "other"), (2, None, "x"), (3, "", "y")], "id int, t string, line string")
    rows = {r.id: r for r in L.normalize_headings(df, "id", "t").collect()}
    assert rows[1].t == "# A\n\nFPT University\ntext\n# A\n## A" and rows[1].line == "other" and rows[2].t == rows[3].t == ""


def test_front_matter(spark):
    text = '---\ntitle: "A: b"\nn: 5\nflag: TRUE\nnone: ~\n# c\nn: 6\n---\nbody --- x\n'
    got = one(spark, M.anchored, text)
    assert got.metadata == {"title": "A: b", "n": "6", "flag": "true", "none": None} and got.body == "body --- x\n"
    assert one(spark, M.anchored, "no").body == "no" and one(spark, M.anchored, "").body == ""
    assert one(spark, M.prefixed, "---\na: 1\n---\n b ").body == "b"
    assert one(spark, M.strict, "x").error and one(spark, M.strict, "---\na").error and not one(spark, M.strict, "---\na: 1\n---\nb").error
    assert [one(spark, M.scalar_type, x) for x in ("1", "1.5", "'1'", "yes", "NULL", "false")] == ["int", "float", "string", "string", "null", "bool"]


def test_null_texts_do_not_fail(spark):
    df = spark.createDataFrame([(None,)], "t string")
    c = F.col("t")
    df.select(T.tokens(c), T.lines(c), T.slug(c), T.roman(c), T.number_label(c), T.clean_heading(c), T.yaml_quote(c), T.preview(c), T.url_host(c), T.url_stem(c), L.clean_markdown(c)).collect()
