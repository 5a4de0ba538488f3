"""Checks of documents and of manifests against them, as rows and arrays of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def field(metadata: Column, name: str) -> Column:
    return F.try_element_at(metadata, F.lit(name))


def issues(metadata: Column, body: Column, audiences: list[str] | None = None) -> Column:
    """array<string> of what is wrong with a document; empty if nothing is."""
    allowed = sorted(audiences or V.AUDIENCES)
    found = [F.when(F.contains(body, F.lit("�")), "Encoding issue: File contains Unicode replacement character (\\ufffd)")]
    for name in V.REQUIRED_FIELDS:
        value = field(metadata, name)
        found.append(F.when(value.isNull(), f"Missing required metadata field: '{name}'").when(T.strip(value) == "", f"Empty required metadata field: '{name}'"))
    audience = field(metadata, "audience")
    low = F.lower(T.strip(audience))
    found.append(F.when((low != "") & ~low.isin(*allowed), F.concat(F.lit("Invalid audience value: '"), audience, F.lit(f"' (expected one of: {allowed})"))))
    short = lambda size: F.when(F.coalesce(size, F.lit(0)) == 0, "Empty content: Document body contains no text").when(size < V.MIN_BODY, F.concat(F.lit("Suspiciously short document: Body has "), size.cast("string"), F.lit(f" characters (minimum: {V.MIN_BODY})")))
    found.append(T.let(F.length(T.strip(body)), short))
    return F.array_compact(F.array(*found))


CHECK = "struct<check_name: string, passed: boolean, message: string>"


def strict_checks(metadata: Column, body: Column, stem: Column, error: Column | None = None) -> Column:
    """array<struct<check_name, passed, message>> of the strict corpus rules; what depends on front matter is not checked without it."""
    check = lambda name, passed, good, bad: F.struct(F.lit(name).alias("check_name"), passed.alias("passed"), F.when(passed, good).otherwise(bad).alias("message")).cast(CHECK)
    parsed = metadata.isNotNull() if error is None else error.isNull()
    bad_mark = F.contains(F.coalesce(body, F.lit("")), F.lit("�"))
    encoding = check("Encoding", ~bad_mark, F.lit("UTF-8 valid"), F.lit("Contains Unicode replacement character (\\ufffd)"))
    syntax = check("Frontmatter Syntax", parsed, F.concat(F.lit("Parsed "), F.size(F.map_keys(metadata)).cast("string"), F.lit(" frontmatter keys")), error if error is not None else F.lit("No frontmatter"))
    lacks = F.array_join(F.array_compact(F.array(*[F.when(T.strip(F.coalesce(field(metadata, n), F.lit(""))) == "", n) for n in V.REQUIRED_FIELDS])), ", ")
    named = field(metadata, "doc_id")
    known = F.struct(lacks.alias("lacks"), F.lower(T.strip(F.coalesce(field(metadata, "audience"), F.lit("")))).alias("audience"), F.length(T.strip(F.coalesce(body, F.lit("")))).alias("size"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def rest(v):
        missing, audience, size = v["lacks"], v["audience"], v["size"]
        return F.array(
            check("Required Fields", missing == "", F.lit(f"All {len(V.REQUIRED_FIELDS)} required fields present"), text("Missing required fields: ", missing)),
            check("Audience Value", audience.isin(*V.STRICT_AUDIENCES), text("Audience '", audience, "' is valid"), F.when(audience == "", "Audience field is empty or missing").otherwise(text("Invalid audience '", audience, f"'. Must be one of: {V.STRICT_AUDIENCES}"))),
            check("doc_id Matching", F.coalesce(T.strip(named) == stem, F.lit(True)), F.when(named.isNull(), text("Implicit doc_id from stem '", stem, "'")).otherwise(text("doc_id matches stem '", stem, "'")), text("Frontmatter doc_id '", named, "' does not match filename stem '", stem, "'")),
            check("Body Content", size > V.MIN_BODY, text("Body content non-empty (", F.format_string("%,d", size), f" characters > {V.MIN_BODY})"), text("Body content too short: ", size, f" characters (must be > {V.MIN_BODY})")),
        )

    return F.when(bad_mark, F.array(encoding)).when(~parsed, F.array(encoding, syntax)).otherwise(F.concat(F.array(encoding, syntax), T.let(known, rest)))


def check_log(documents: DataFrame, target: str, metadata: str = "metadata", body: str = "body", error: str | None = None) -> DataFrame:
    """(target, check_name, passed, message, is_warning), a row a check."""
    checks = strict_checks(F.col(metadata), F.col(body), F.col(target), F.col(error) if error else None)
    # an outer generator: an inner one makes Spark infer a filter that computes the checks a second time
    return documents.select(F.col(target).alias("target"), F.inline_outer(checks)).where("check_name is not null").withColumn("is_warning", F.lit(False))


def summary(log: DataFrame, by: str | None = None) -> DataFrame:
    """Checks, passed, failed and warnings; warnings neither pass nor fail."""
    real = ~F.col("is_warning")
    grouped = log.groupBy(by) if by else log.groupBy()
    return grouped.agg(F.count_if(real).alias("checks"), F.count_if(real & F.col("passed")).alias("passed"), F.count_if(real & ~F.col("passed")).alias("failed"), F.count_if(F.col("is_warning")).alias("warnings"))


def reconcile(documents: DataFrame, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, status): missing_in_manifest, extra_in_manifest or duplicate; ids that are in both once have no row."""
    a = documents.select(key).distinct().withColumn("here", F.lit(True))
    b = manifest.where(F.trim(key) != "").select(F.trim(key).alias(key)).groupBy(key).agg(F.count("*").alias("n"))
    status = F.when(F.col("n").isNull(), "missing_in_manifest").when(F.col("here").isNull(), "extra_in_manifest").when(F.col("n") > 1, "duplicate")
    return a.join(b, key, "full").select(key, status.alias("status")).where("status is not null")


def mismatches(documents: DataFrame, manifest: DataFrame, key: str = "doc_id", fields: list[str] = V.CONSISTENT_FIELDS) -> DataFrame:
    """(key, field, manifest_value, document_value) where both have a value and they differ, white space at the ends aside."""
    both = [f for f in fields if f in documents.columns and f in manifest.columns]
    if not both:
        return documents.select(key, *[F.lit("").alias(c) for c in ("field", "manifest_value", "document_value")]).limit(0)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), T.strip(F.col(f"m.{f}").cast("string")).alias("manifest_value"), T.strip(F.col(f"d.{f}").cast("string")).alias("document_value")) for f in both])
    rows = documents.alias("d").join(manifest.alias("m"), F.col(f"d.{key}") == F.trim(F.col(f"m.{key}"))).select(F.col(f"d.{key}").alias(key), F.inline(pairs))
    return rows.where("manifest_value <> document_value")


def missing_columns(manifest: DataFrame) -> list[str]:
    return [c for c in V.REQUIRED_COLUMNS if c not in manifest.columns]


def corpus_issues(documents: DataFrame, name: str, metadata: str = "metadata", body: str = "body") -> DataFrame:
    """(name, issues), by the file's name regardless of case."""
    return documents.select(name, issues(F.col(metadata), F.col(body)).alias("issues")).orderBy(F.lower(name))


