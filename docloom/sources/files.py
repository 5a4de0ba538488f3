"""Text, Markdown, CSV and JSON in; Markdown, manifests and reports out."""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import frontmatter as M
from ..functions import text as T
from ..functions import values as V
from ..operators import evaluation as E
from ..storage import hadoop_path
from .store import Store

BENCHMARK = """id string, query string, query_vi string, gold_answer string, expected_doc string, expected_section string, expected_audience string, metadata_filter map<string,string>, query_type string,
requires_filter boolean, gold_keywords array<string>, source_doc_ids array<string>, evidence array<struct<id: string, phrases: array<string>>>, answer_criteria array<struct<id: string, all_terms: array<string>>>"""


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.url_decode(path), "([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def whole_files(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, file_name, text); bytes that aren't UTF-8 become replacement characters. Missing and unreadable files are skipped, and so is everything else the glob leaves out."""
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(paths)
    return rows.select("path", file_name(F.col("path")).alias("file_name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def files_of(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    """``whole_files`` of one folder's names of an ending. One task lists the names and all tasks read the files, so that the driver holds none of them, however many there are.

    A folder that isn't there or that pyarrow can't reach is listed by Spark, in the driver.
    """
    at, owner = hadoop_path(spark, folder)
    at = owner.makeQualified(at)
    uri, prefix = at.toUri(), f"{at.toString().rstrip('/')}/"
    place = uri.getPath() if uri.getScheme() == "file" else uri.toString()
    try:
        fs, inside = reached(place)
        there = fs.get_file_info(inside).type == FileType.Directory
    except (pa.ArrowException, OSError, ImportError):
        there = False
    if not there:
        return whole_files(spark, folder, f"*{ending}")

    def listed(_):
        names = visible(*reached(place), ending)
        while some := list(islice(names, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["name"])

    def read(batches):
        fs, inside = reached(place)
        paths, contents, held = [], [], 0
        full = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
        for name in (x for b in batches for x in b.column(0).to_pylist()):
            try:
                with fs.open_input_stream(f"{inside}/{name}", compression=None) as file:
                    content = file.read()
            except OSError:
                continue
            paths.append(prefix + name)
            contents.append(content)
            held += len(content)
            if held >= 1 << 22 or len(paths) == 1000:
                yield full()
                paths, contents, held = [], [], 0
        if paths:
            yield full()

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = spark.range(0, 1, 1, 1).mapInArrow(listed, "name string").repartition(parts, "name").mapInArrow(read, "path string, content binary")
    return rows.select("path", file_name(F.col("path")).alias("file_name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def visible(fs: FileSystem, at: str, ending: str) -> Iterator[str]:
    """Paths in a folder of the files that Spark reads there: none that it takes for hidden, and those of folders key=value too."""
    for name, folder in entries(fs, at):
        hidden = name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name
        if hidden or name.encode(errors="ignore").decode() != name:  # names that aren't UTF-8 can't be read
            continue
        if folder and "=" in name:
            yield from (f"{name}/{x}" for x in visible(fs, f"{at}/{name}", ending))
        elif not folder and name.endswith(ending):
            yield name


def entries(fs: FileSystem, at: str) -> Iterator[tuple[str, bool]]:
    """Names in a folder, and whether each is a folder's; where files are local, one at a time."""
    if isinstance(fs, LocalFileSystem):
        with os.scandir(at) as found:
            for x in found:
                yield x.name, x.is_dir()
    else:
        for x in fs.get_file_info(FileSelector(at)):
            yield x.base_name, x.type == FileType.Directory


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of a short list of paths that exist, by the file system they belong to."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    made = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return [p for p, q in zip(paths, made, strict=True) if q.getFileSystem(conf).exists(q)]


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, content) of the .md and .txt files among ``paths`` that exist; the id is the name without extension."""
    good = [p for p in existing(spark, paths) if p.lower().endswith((".md", ".txt"))]
    if not good:
        return spark.createDataFrame([], "id string, content string")
    return whole_files(spark, good).select(stem(F.col("path")).alias("id"), F.col("text").alias("content"))


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(id, content, metadata) of a folder's Markdown files, by name: front matter by its --- alone, bodies stripped."""
    rows = files_of(spark, folder, ".md").withColumn("f", M.prefixed(F.col("text"), M.parse))
    return rows.orderBy("file_name").select(stem(F.col("path")).alias("id"), T.strip(F.col("f.body")).alias("content"), F.col("f.metadata").alias("metadata"))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, doc_ord, file_name, body, metadata): a folder's Markdown files in order of their names regardless of case; the id is in the front matter, or the name. A missing folder is empty."""
    if not existing(spark, [folder]):
        return spark.createDataFrame([], "doc_id string, doc_ord int, file_name string, body string, metadata map<string,string>")
    rows = files_of(spark, folder, ".md").withColumn("f", M.anchored(F.col("text"), M.parse))
    name = F.coalesce(F.try_element_at(F.col("f.metadata"), F.lit("doc_id")), stem(F.col("path")))
    order = F.row_number().over(Window.orderBy(F.lower("file_name")))  # one row a file of one folder
    return rows.select(name.alias("doc_id"), order.alias("doc_ord"), "file_name", F.col("f.body").alias("body"), F.map_concat(F.map_filter("f.metadata", lambda k, _: k != "doc_id"), F.create_map(F.lit("doc_id"), name)).alias("metadata"))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of pages to read: header and values trimmed, rows without url left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = rows.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in rows.columns])
    if "url" not in rows.columns:
        raise ValueError("Input CSV must have a 'url' column.")
    return rows.where("url <> ''")


def rows_without_url(spark: SparkSession, path: str) -> DataFrame:
    """(row_number) of one CSV's rows that read_rows leaves out; the first row after the header is 2. A CSV with multi-line values is one task, which numbers its rows."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    url = next(c for c in rows.columns if c.strip() == "url")
    return rows.select((F.monotonically_increasing_id() + 2).alias("row_number"), F.trim(F.col(f"`{url}`")).alias("u")).where("coalesce(u, '') = ''").select("row_number")


def read_benchmark(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Questions from JSON arrays, in one schema; several files are put one after another."""
    rows = spark.read.schema(BENCHMARK).option("multiLine", "true").json(paths)
    if rows.limit(1).count() == 0:
        raise ValueError("no benchmark questions found")
    return rows


# --- out ---


def markdown_document(metadata: Column, title: Column, content: Column) -> Column:
    """Front matter with quoted values, the title as a heading, the content. metadata: array<struct<key, value>>, in order."""
    lines = F.array_join(F.transform(metadata, lambda e: F.concat(e["key"], F.lit(": "), T.yaml_quote(F.coalesce(e["value"], F.lit(""))))), "\n")
    return F.concat(F.lit("---\n"), lines, F.lit("\n---\n\n# "), title, F.lit("\n\n"), content, F.lit("\n"))


class MarkdownSink(DataSource):
    """Writes rows (name, text) as files ``<name>.md`` of one folder, which driver and executors share and pyarrow can reach.

    A task gives a file its name once it is whole, so that a task that runs again replaces its files by the same; if the job
    fails, what it has added goes. Overwriting removes what was there and is not written again, once all is written.
    Characters that a name can't hold are percent-encoded; a null name is ``unnamed``. Names that were there and names that a
    task has written lie in files of a hidden folder, which goes at the end; the driver reads them a part at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "docloom_markdown"

    def writer(self, schema, overwrite: bool) -> "MarkdownWriter":
        return MarkdownWriter(self.options["path"], overwrite)


@dataclass
class Written(WriterCommitMessage):
    """The file that lists what a task has written."""

    folder: str
    listed: str

    def each(self) -> Iterator[str]:
        return noted(self.folder, self.listed)

    @property
    def names(self) -> list[str]:
        return list(self.each())


class MarkdownWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.notes = folder, overwrite, f".{uuid.uuid4().hex}"
        fs, at = reached(folder)
        fs.create_dir(f"{at}/{self.notes}")
        with fs.open_output_stream(f"{at}/{self.notes}/before", buffer_size=1 << 16) as out:
            for name, _ in entries(fs, at):
                if name.endswith(".md"):
                    out.write(note(name))

    def before(self) -> Iterator[str]:
        return noted(self.folder, f"{self.notes}/before")

    def write(self, rows) -> Written:
        fs, at = reached(self.folder)
        done = Written(self.folder, f"{self.notes}/{uuid.uuid4().hex}")
        try:
            with fs.open_output_stream(f"{at}/{done.listed}", buffer_size=1 << 16) as listed:
                for name, text in rows:
                    file = f"{quote('unnamed' if name is None else str(name), safe=' ()[]{}=+,;@!')}.md"
                    with fs.open_output_stream(beside := f"{at}/{self.notes}/{uuid.uuid4().hex}") as out:
                        out.write((text or "").encode())
                    fs.move(beside, f"{at}/{file}")
                    listed.write(note(file))
        except BaseException:
            self.discard([done])
            raise
        return done

    def discard(self, messages: list) -> None:
        fs, at = reached(self.folder)
        for name in without(chain.from_iterable(m.each() for m in messages if m), self.before):
            if fs.get_file_info(f"{at}/{name}").type == FileType.File:
                fs.delete_file(f"{at}/{name}")

    def commit(self, messages: list) -> None:
        fs, at = reached(self.folder)
        if self.overwrite:
            for name in without(self.before(), lambda: chain.from_iterable(m.each() for m in messages if m)):
                fs.delete_file(f"{at}/{name}")
        fs.delete_dir(f"{at}/{self.notes}")

    def abort(self, messages: list) -> None:
        self.discard(messages)
        fs, at = reached(self.folder)
        fs.delete_dir(f"{at}/{self.notes}")


def note(name: str) -> bytes:
    """A name's line in a file of names."""
    return f"{json.dumps(name, ensure_ascii=False)}\n".encode()


def noted(folder: str, listed: str) -> Iterator[str]:
    """The names in a file of names, as they are read; none if there is no such file."""
    fs, at = reached(folder)
    if fs.get_file_info(f"{at}/{listed}").type == FileType.File:
        with fs.open_input_stream(f"{at}/{listed}", compression=None) as file:
            yield from map(json.loads, io.BufferedReader(file, 1 << 16))


def without(names: Iterable[str], others, part: int = 500_000) -> Iterator[str]:
    """Those of ``names`` that aren't in ``others()``, which is read again for each part of the names."""
    names = iter(names)
    while some := set(islice(names, part)):
        some.difference_update(others())
        yield from some


def reached(folder: str) -> tuple[FileSystem, str]:
    """A folder's file system and its path there; paths without a scheme are local."""
    return FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (LocalFileSystem(), folder)


def write_documents(rows: DataFrame, folder: str, content: str = "markdown", name: str = "doc_id", mode: str = "overwrite") -> None:
    """A file ``<name>.md`` a document, as ``read_corpus`` and ``read_markdown`` read them. Of several rows of a name the greatest text counts. mode: overwrite or append."""
    rows.sparkSession.dataSource.register(MarkdownSink)
    one = rows.groupBy(F.col(name).cast("string").alias("name")).agg(F.max(content).alias("text"))
    one.write.format(MarkdownSink.name()).mode(mode).save(folder)


def upsert_manifest(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """The manifest with new records in place of old ones of their id, in order of id; what is missing is ''."""
    fields = V.MANIFEST_FIELDS
    shaped = lambda df: df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in fields])
    return shaped(old).join(new.select(key), key, "left_anti").select(*fields).unionByName(shaped(new)).orderBy(key)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").csv(path, header=True, escape='"')


def manifest_table(manifest: DataFrame, columns: list[str], order: str = "doc_id") -> DataFrame:
    """(no, line): a Markdown table's rows, numbered from 1, after its two header rows."""
    no = F.row_number().over(Window.orderBy(order))  # a manifest: one row a file
    body = manifest.select(no.alias("no"), F.concat(F.lit("| "), F.concat_ws(" | ", no.cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("line"))
    head = "| " + " | ".join(["#", *columns]) + " |"
    rule = "|" + "---|" * (len(columns) + 1)
    spark = manifest.sparkSession
    return spark.range(1).select(F.posexplode(F.array(F.lit(head), F.lit(rule))).alias("no", "line")).withColumn("no", F.col("no") - 2).unionByName(body)


def report_lines(metrics: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(query_id, line) of a text report: one line a question, its metrics as name=value."""
    shown = [F.concat(F.lit(c + "="), F.col(c).cast("string")) for c in metrics.columns if c != id_col]
    return metrics.select(id_col, F.concat_ws(" ", F.concat(F.lit("["), F.col(id_col).cast("string"), F.lit("]")), *shown).alias("line"))


def parse_report(lines: DataFrame) -> DataFrame:
    """(query_id, recall_at_1, recall_at_5) of a report's lines."""
    value = lambda name: F.regexp_extract("line", name + r"=([0-9.]+)", 1).cast("double").alias(name)
    return lines.select(F.regexp_extract("line", r"^\[([^\]]*)\]", 1).alias("query_id"), value("recall_at_1"), value("recall_at_5"))


failing = E.failing


# --- the embedding cache ---


class EmbeddingCache:
    """Vectors of texts by their SHA-256, kept in a ``store.Store`` in folders by the hash's first ``digits`` of 16 values each.

    ``of`` reads only the folders of the hashes that are asked for. Writers at once may both add a hash: readers get one row
    of it, and ``compact`` leaves one.
    """

    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        self.spark, self.digits, self.store = spark, digits, Store(spark, path, key="text_hash", name="vectors", by=("prefix",))

    def extend(self, new: DataFrame) -> int:
        """More entries (text_hash, embedding)."""
        rows = new.select("text_hash", F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["text_hash"])
        return self.store.add(rows.withColumn("prefix", F.substring("text_hash", 1, self.digits)).repartition("prefix"))

    def of(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        """(text_hash, embedding) of those of ``texts`` that are known."""
        asked = texts.select(F.sha2(F.col(text_col), 256).alias("text_hash")).where("text_hash IS NOT NULL").distinct()
        if not self.store.versions():
            return self.spark.createDataFrame([], "text_hash string, embedding array<double>")
        prefixes = [r[0] for r in asked.select(F.substring("text_hash", 1, self.digits)).distinct().collect()]  # 16 ** digits at most
        held = self.store.read().where(F.col("prefix").isin(*prefixes)).select("text_hash", "embedding")
        return held.join(asked, "text_hash", "left_semi").dropDuplicates(["text_hash"])

    def compact(self) -> None:
        """One folder, with one row a hash."""
        self.store.compact(tidy=lambda rows: rows.dropDuplicates(["text_hash"]).repartition("prefix"))
        self.store.vacuum(keep=2)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(text_hash, embedding); empty if there is none yet."""
    if not existing(spark, [path]):
        return spark.createDataFrame([], "text_hash string, embedding array<double>")
    return spark.read.parquet(path)


def extend_cache(new: DataFrame, path: str) -> None:
    new.select("text_hash", "embedding").write.mode("append").parquet(path)
