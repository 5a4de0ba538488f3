"""Front matter of Markdown files as columns: a map of scalars, and the body."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

try:
    import yaml
except ImportError:  # then only ``key: value`` lines are read
    yaml = None

ANCHORED = r"(?s)\A---\s*\r?\n(.*?)\r?\n---\s*(?:\r?\n|\z)(.*)\z"
NO_MAP = "map<string,string>"


def scalar(value: Column) -> Column:
    """A YAML scalar as text: quotes off, null for null, none, ~ and nothing, true and false in lower case."""
    quoted = (value.startswith('"') & value.endswith('"') | value.startswith("'") & value.endswith("'")) & (F.length(value) > 1)
    low = F.lower(value)
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).when(low.isin("null", "none", "~", ""), F.lit(None)).when(low.isin("true", "false"), low).otherwise(value)


def scalar_type(value: Column) -> Column:
    """string, bool, null, int or float, of a scalar as it is written."""
    low = F.lower(T.strip(value))
    return (
        F.when(low.rlike("""^(".*"|'.*')$"""), "string").when(low.isin("true", "false"), "bool").when(low.isin("null", "none", "~", ""), "null")
        .when(low.rlike("^[+-]?[0-9]+$"), "int").when(low.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), "float").otherwise("string")
    )


def parse_lines(raw: Column, comments: bool = True) -> Column:
    """map of ``key: value`` lines; other lines, and those that begin with #, are skipped; of a repeated key the last counts."""
    kept = F.filter(F.transform(T.lines(raw), T.strip), lambda line: F.contains(line, F.lit(":")) & (~line.startswith("#") if comments else F.lit(True)))
    pair = lambda line: F.struct(T.strip(F.substring_index(line, ":", 1)).alias("k"), scalar(T.strip(F.regexp_replace(line, "^[^:]*:", ""))).alias("v"))
    pairs = F.transform(kept, pair)
    last = T.let(pairs, lambda a: F.filter(a, lambda x, k: ~F.exists(F.slice(a, k + 2, F.greatest(F.size(a) - k - 1, F.lit(0))), lambda y: y["k"] == x["k"])))
    return F.map_from_entries(last)


#: Lines that a flat reading can't take: indented ones, list items, and flow lists and maps.
NESTED = r"(?m)^(?:[ \t]+\S|-[ \t]|[^:\n]+:[ \t]*[\[{|>])"


def shown(value) -> str | None:
    """A YAML value as text: lists and maps as JSON."""
    if isinstance(value, (list, dict)):
        return json.dumps(value, ensure_ascii=False)
    return None if value.lower() in ("null", "none", "~", "") else value.lower() if value.lower() in ("true", "false") else value


def nested(raw: Column) -> Column:
    """map<string,string> of YAML with lists and maps, whose values are JSON texts; null where it isn't a YAML map, or where there is no YAML reader."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            try:
                made = yaml.load(t.as_py() or "", Loader=yaml.BaseLoader) if yaml else None
            except yaml.YAMLError:
                made = None
            out.append([(str(k), shown(v)) for k, v in made.items()] if isinstance(made, dict) else None)
        return pa.array(out, pa.map_(pa.string(), pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, NO_MAP)(raw)


def parse(raw: Column) -> Column:
    """``nested`` where the text calls for it and can be read so, else ``parse_lines``. Only front matter that calls for it goes to Python."""
    calls = raw.rlike(NESTED)
    return F.coalesce(F.when(calls, nested(F.when(calls, raw))), parse_lines(raw))


def anchored(text: Column, read=parse_lines) -> Column:
    """struct<metadata, body>: front matter between lines of ---; the body is kept as it is; without one the whole text is body. read: ``parse_lines`` or ``parse``."""
    clean = F.regexp_replace(text, "^﻿+", "")
    has = clean.rlike(ANCHORED)
    meta = F.when(has, read(F.regexp_extract(clean, ANCHORED, 1))).otherwise(F.create_map().cast(NO_MAP))
    return F.struct(meta.alias("metadata"), F.when(has, F.regexp_extract(clean, ANCHORED, 2)).otherwise(F.coalesce(clean, F.lit(""))).alias("body"))


def prefixed(text: Column, read=None) -> Column:
    """struct<metadata, body>: what stands between the first two --- of a text that begins with one; both sides stripped. read: as for ``anchored``, by default lines with comments."""
    parts = F.split(text, "---", 3)
    has = text.startswith("---") & (F.size(parts) >= 3)
    raw = T.strip(F.try_element_at(parts, F.lit(2)))
    meta = F.when(has, read(raw) if read else parse_lines(raw, comments=False)).otherwise(F.create_map().cast(NO_MAP))
    return F.struct(meta.alias("metadata"), F.when(has, T.strip(F.try_element_at(parts, F.lit(3)))).otherwise(text).alias("body"))


def strict(text: Column) -> Column:
    """struct<metadata, body, error>: error tells why there is no front matter."""
    parts = F.split(text, "---", 3)
    error = F.when(~text.startswith("---"), "front matter does not begin the file").when(F.size(parts) < 3, "front matter is not closed").when(F.size(F.map_keys(parse_lines(F.try_element_at(parts, F.lit(2))))) == 0, "front matter holds no keys")
    ok = error.isNull()
    return F.struct(F.when(ok, parse_lines(F.try_element_at(parts, F.lit(2)))).alias("metadata"), F.when(ok, F.try_element_at(parts, F.lit(3))).alias("body"), error.alias("error"))
