import json
import pickle

import pytest
from pyspark.sql import functions as F

from docloom.operators import retrieval as R
from docloom.sources import config, files, pages
from docloom.streaming import ingest


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "B.md").write_text("---\ndoc_id: x\ntitle: T\n---\n# Body\n", encoding="utf-8")
    (tmp_path / "a.md").write_bytes(b"plain \xff text")
    (tmp_path / "c.txt").write_text("no")
    rows = files.read_corpus(spark, str(tmp_path)).orderBy("doc_ord").collect()
    assert [(r.doc_id, r.doc_ord) for r in rows] == [("a", 1), ("x", 2)] and rows[1].body == "# Body\n" and "�" in rows[0].body
    assert files.read_corpus(spark, str(tmp_path / "none")).count() == 0
    assert [r.id for r in files.read_markdown(spark, str(tmp_path)).collect()] == ["B", "a"]
    got = files.read_documents(spark, [str(tmp_path / n) for n in ("c.txt", "a.md", "gone.md", "d.csv")])
    assert sorted(r.id for r in got.collect()) == ["a", "c"]


def test_rows_need_urls(spark, tmp_path):
    (tmp_path / "u.csv").write_text("url, title \nhttp://a , x\n,y\n")
    rows = files.read_rows(spark, str(tmp_path / "u.csv")).collect()
    assert [(r.url, r.title) for r in rows] == [("http://a", "x")]
    assert [r.row_number for r in files.rows_without_url(spark, str(tmp_path / "u.csv")).collect()] == [3]
    (tmp_path / "v.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_rows(spark, str(tmp_path / "v.csv"))


def test_benchmark_files(spark, tmp_path):
    for name in ("dev", "test"):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"id": name, "query": "q", "gold_keywords": ["k"], "metadata_filter": {"audience": "student"}}]))
    both = files.read_benchmark(spark, [str(tmp_path / "dev.json"), str(tmp_path / "test.json")])
    assert sorted(r.id for r in both.collect()) == ["dev", "test"] and both.first().metadata_filter == {"audience": "student"}
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(ValueError):
        files.read_benchmark(spark, str(tmp_path / "none.json"))


def test_manifest(spark, tmp_path):
    old = spark.createDataFrame([("b", "Old"), ("a", "A")], "doc_id string, title string")
    new = spark.createDataFrame([("b", "New, \"x\"")], "doc_id string, title string")
    files.write_manifest(files.upsert_manifest(old, new), str(tmp_path / "m"))
    back = spark.read.csv(str(tmp_path / "m"), header=True, escape='"').orderBy("doc_id").collect()
    assert [(r.doc_id, r.title) for r in back] == [("a", "A"), ("b", 'New, "x"')]
    assert [r.line for r in files.manifest_table(old, ["title"]).orderBy("no").collect()] == ["| # | title |", "|---|---|", "| 1 | A |", "| 2 | Old |"]


def test_reports(spark):
    metrics = spark.createDataFrame([("q1", 1.0, 0.5), ("q2", 0.0, 0.0)], "query_id string, recall_at_1 double, recall_at_5 double")
    parsed = files.parse_report(files.report_lines(metrics))
    benchmark = spark.createDataFrame([("q1", "a"), ("q2", "b")], "query_id string, query string")
    assert [r.query for r in files.failing(parsed, benchmark).collect()] == ["b"]


HTML = '<html><head><title> A &amp; B </title><meta property="article:published_time" content="2024-01-01"></head><body><nav>menu</nav><script>x<p></script><h1>Big <b>title</b></h1><div class="Sidebar-x">noise</div><article><p>Hello<br/>there' + " word" * 60 + "<p>More</article><footer>f</footer></body></html>"


def test_pages(spark):
    df = spark.createDataFrame([("https://a.org/x/Page%201.html?q=1", HTML), ("ftp://a.org/y", HTML), ("http://b.org/", "<p>short</p>"), (None, None)], "url string, html string")
    row = df.select(pages.html_text(F.col("html")).alias("t"), pages.main_content(F.col("html")).alias("m"), pages.page_title(F.col("html")).alias("h"), pages.published_at(F.col("html")).alias("d")).first()
    assert "menu" not in row.t and "Hello\n\nthere" in row.t and "A & B" in row.t and row.h == "Big title" and row.d == "2024-01-01"
    assert "noise" not in row.m and row.m.startswith("Hello")
    docs = pages.page_documents(df.withColumn("category", F.lit("c")), extra=["category", "Bad-Key"]).collect()
    assert [d.doc_id for d in docs] == ["page-201"] and docs[0].metadata["category"] == "c" and docs[0].markdown.startswith('---\ndoc_id: "page-201"\n')
    assert df.select(pages.page_title(F.col("html")).alias("t")).collect()[2].t == "Untitled Document"


def test_config():
    made = config.load({"DOCLOOM_CHUNK_SIZE": "900", "DOCLOOM_RRF_K": "10"}, rrf_k=5, chunk_overlap=None)
    assert (made.chunk_size, made.rrf_k, made.chunk_overlap) == (900, 5, 100)


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    first = R.missing_from_cache(texts, files.read_cache(spark, path))
    assert first.count() == 2
    files.extend_cache(R.embed(first.where("text = 'a'"), F.col("text")), path)
    assert [r.text for r in R.missing_from_cache(texts, files.read_cache(spark, path)).collect()] == ["b"]


def test_stream_replaces_and_deletes(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "store", "check"))

    def feed(rows):
        spark.createDataFrame(rows, "doc_id string, content string").coalesce(1).write.mode("append").parquet(source)
        ingest.start(spark.readStream.schema("doc_id string, content string").parquet(source), store, checkpoint, size=10, overlap=0).awaitTermination()

    feed([("a", "x" * 25), ("b", "y")])
    assert ingest.current(spark, store).count() == 4
    feed([("a", "z"), ("b", None)])
    assert [(r.doc_id, r.content, len(r.embedding)) for r in ingest.current(spark, store).collect()] == [("a", "z", 64)]


def test_emptied_documents_leave_the_store(spark, tmp_path):
    """An empty text, a null one and the last version of several in a batch; then the store in one folder."""
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "store", "check"))
    schema = "doc_id string, content string, version int"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.start(spark.readStream.schema(schema).parquet(source), store, checkpoint, size=10, overlap=0).awaitTermination()

    feed([("a", "x" * 15, 1), ("b", "y", 1), ("c", "old", 1), ("c", "new", 2), ("c", None, None), (None, "no id", 1)])
    got = {(str(r.doc_id), r.content) for r in ingest.current(spark, store).collect()}
    assert ("b", "y") in got and ("c", "new") in got and ("c", "old") not in got and ("None", "no id") in got
    feed([("a", "", 2), ("b", None, 2)])
    assert {str(r.doc_id) for r in ingest.current(spark, store).collect()} == {"c", "None"}
    feed([("b", "back", 3)])
    before = sorted(map(str, ingest.current(spark, store).select("doc_id", "part_index", "content").collect()))
    ingest.compact(spark, store)
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith(("_", "."))) == ["batch=2"]
    assert sorted(map(str, ingest.current(spark, store).select("doc_id", "part_index", "content").collect())) == before
    ingest.compact(spark, store)
    feed([("c", "newer", 4), ("a", "again", 5)])
    assert {(str(r.doc_id), r.content) for r in ingest.current(spark, store).collect()} == {("a", "again"), ("b", "back"), ("c", "newer"), ("None", "no id")}


def test_robots(spark):
    """Rules by site; no rules allow all, an unknown site none."""
    rules = "User-agent: *\nDisallow: /private\n\nUser-agent: friend\nAllow: /\n"
    robots = spark.createDataFrame([("https://a.org", rules), ("https://a.org", rules), ("http://b.org:8080", ""), ("https://d.org", None)], "site string, robots string")
    urls = ["https://a.org/x", "https://A.org/private/y", "http://b.org:8080/private", "https://c.org/x", "https://d.org/x", "ftp://a.org/x", None]
    df = spark.createDataFrame([(u, k) for k, u in enumerate(urls)], "url string, robots int")
    kept = lambda agent: sorted(r.robots for r in pages.robots_allowed(df, robots, agent).collect())
    assert kept("stranger") == [0, 2] and kept("friend") == [0, 1, 2]
    assert pages.robots_allowed(df, robots).columns == df.columns


def test_content_types_and_charsets(spark):
    rows = [(1, "h\u00e9".encode(), "text/html; charset=UTF-8"), (2, "h\u00e9".encode("latin-1"), "text/plain;charset='iso-8859-1'"), (3, b"h\xff", "TEXT/HTML"), (4, b"{}", "application/json"), (5, b"x", "text/html; charset=no-such"), (6, None, "text/html"), (7, b"x", None)]
    df = spark.createDataFrame(rows, "id int, body binary, content_type string")
    assert {r.id: r.html for r in pages.decoded_bodies(df).collect()} == {1: "h\u00e9", 2: "h\u00e9", 3: "h\ufffd"}


def test_nested_front_matter(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "n.md").write_text("---\ntitle: T\ntags:\n  - a\n  - 'b: c'\nby: {name: x, age: 3}\nflag: Yes\nnone: ~\n---\nbody", encoding="utf-8")
    (tmp_path / "flat.md").write_text("---\ntitle: \"A: b\"\nn: 5\n---\nbody", encoding="utf-8")
    (tmp_path / "broken.md").write_text("---\ntitle: [a\nn: 5\n---\nbody", encoding="utf-8")
    got = {r.doc_id: r.metadata for r in files.read_corpus(spark, str(tmp_path)).collect()}
    assert json.loads(got["n"]["tags"]) == ["a", "b: c"] and json.loads(got["n"]["by"]) == {"name": "x", "age": "3"} and got["n"]["title"] == "T" and got["n"]["none"] is None
    assert got["flat"] == {"doc_id": "flat", "title": "A: b", "n": "5"} and got["broken"]["n"] == "5"


def test_written_documents_are_read_back(spark, tmp_path):
    folder = str(tmp_path / "corpus dir")
    rows = [("a-1", "title", "A: b"), ("Ä/b?#%", "title", None), ("c", "k", "v"), ("c", "k", "w")]
    docs = spark.createDataFrame(rows, "doc_id string, key string, value string")
    entries = F.array(F.struct(F.lit("doc_id").alias("key"), F.col("doc_id").alias("value")), F.struct("key", "value"))
    files.write_documents(docs.withColumn("markdown", files.markdown_document(entries, F.lit("Head"), F.lit("Body ü"))).repartition(3), folder)
    got = {r.doc_id: r for r in files.read_corpus(spark, folder).collect()}
    assert set(got) == {"a-1", "Ä/b?#%", "c"} and got["a-1"].metadata["title"] == "A: b" and got["c"].metadata["k"] == "w"
    assert all("# Head\n\nBody ü" in r.body for r in got.values())
    assert [r.id for r in files.read_markdown(spark, folder).collect()][0] == "a-1"
    more = spark.createDataFrame([("d", "text"), (None, "no name"), ("a-1", None)], "doc_id string, markdown string")
    files.write_documents(more, folder, mode="append")
    assert len(list((tmp_path / "corpus dir").glob("*.md"))) == 5 and (tmp_path / "corpus dir" / "a-1.md").read_text() == ""
    files.write_documents(more.where("doc_id = 'd'"), folder)
    assert sorted(p.name for p in (tmp_path / "corpus dir").iterdir()) == ["d.md"]


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    folder = tmp_path / "corpus"
    files.write_documents(spark.createDataFrame([("old", "old text")], "doc_id string, markdown string"), str(folder))
    bad = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("doc_id"), F.when(F.col("id") == 37, F.raise_error(F.lit("no"))).otherwise(F.lit("t")).cast("string").alias("markdown"))
    for write in (lambda: files.write_documents(bad, str(folder)), lambda: writer_that_stops(folder)):
        with pytest.raises(Exception, match="no"):
            write()
        assert [p.name for p in folder.iterdir()] == ["old.md"] and (folder / "old.md").read_text() == "old text"


def writer_that_stops(folder):
    """A task that has written some files, and a job that ends after others have been."""
    writer = files.MarkdownWriter(str(folder), True)
    done = writer.write(iter([("x", "1"), ("y", "2")]))
    assert done.names == ["x.md", "y.md"]

    def rows():
        yield "z", "3"
        raise ValueError("no")

    try:
        writer.write(rows())
    finally:
        assert not (folder / "z.md").exists()
        writer.abort([done, None])


def test_the_driver_holds_no_names_of_a_corpus(spark, tmp_path):
    """Neither what a task tells of 5,000 files nor the plan that reads them grows with their number; nor do the tasks that read."""
    folder = str(tmp_path / "corpus")
    writer = files.MarkdownWriter(folder, True)
    done = writer.write((f"d{k}", f"text {k}") for k in range(5000))
    assert len(pickle.dumps(done)) < 500 and len(done.names) == 5000
    writer.commit([done, None])
    for rows in (files.read_corpus(spark, folder), files.read_markdown(spark, folder)):
        assert rows.inputFiles() == [] and rows.count() == 5000
    assert len(pickle.dumps(files.MarkdownWriter(folder, True))) < 500
    files.write_documents(spark.createDataFrame([("d7", "new"), ("e", "e")], "doc_id string, markdown string"), folder)
    assert sorted((r.id, r.content) for r in files.read_markdown(spark, folder).collect()) == [("d7", "new"), ("e", "e")]


def test_a_folder_is_read_as_by_spark(spark, tmp_path):
    """Odd names, hidden ones, folders, links to nothing, and a path that has to be escaped."""
    folder = tmp_path / "a é +%20"
    (folder / "dir.md").mkdir(parents=True)
    for name in ("a.md", "b c.md", "%41.md", "ä+b.md", "_x.md", "_metadata.md", "_k=v.md", ".z.md", "x.MD", "n.txt", "dir.md/in.md"):
        (folder / name).write_bytes(name.encode() + b"\xff")
    (folder / "broken.md").symlink_to("/nowhere")
    for at in (str(folder), f"{folder}/", f"file://{folder}"):
        got = sorted(files.files_of(spark, at, ".md").collect())
        assert got == sorted(files.whole_files(spark, at, "*.md").collect()) and len(got) == 5
    (tmp_path / "p" / "k=1").mkdir(parents=True)
    (tmp_path / "p" / "k=1" / "in.md").write_text("in")
    assert [r.text for r in files.files_of(spark, str(tmp_path / "p"), ".md").collect()] == ["in"]


def test_names_are_compared_in_parts():
    assert sorted(files.without(map(str, range(10)), lambda: iter(["3", "9", "x"]), part=4)) == list("01245678")


def test_the_cache_reads_its_folders_alone(spark, tmp_path):
    cache = files.EmbeddingCache(spark, str(tmp_path / "cache"))
    texts = spark.createDataFrame([(f"text {k}",) for k in range(300)] + [(None,)], "text string")
    assert cache.of(texts).count() == 0
    made = texts.where("text IS NOT NULL").select(F.sha2("text", 256).alias("text_hash"), F.array(F.lit(1.0)).alias("embedding"))
    cache.extend(made)
    cache.extend(made.limit(50))
    assert cache.of(texts).count() == 300 and cache.store.read().count() == 350
    one = cache.of(texts.where("text = 'text 7'"))
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan or "PartitionFilters: [(prefix" in plan
    cache.compact()
    assert cache.store.read().count() == 300 and cache.of(texts).count() == 300 and len(cache.store.snapshot()[1]["folders"]) == 1
    vectors, new = R.embed_cached(texts, F.col("text"), cache.of(texts))
    assert new.count() == 0 and vectors.where("embedding IS NOT NULL").count() == 300
