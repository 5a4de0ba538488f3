"""Cleaning of web and policy text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import structure as S
from ..functions import text as T
from ..functions import values as V

CALL_LINE = r"(?iu)^\s*\[(?:" + "|".join(V.CALLS_TO_ACTION) + r")\](?:\([^)]*\))?\s*$"
NOISE_LINES = [CALL_LINE, *("(?iu)" + p for p in (V.CONTENTS_LINE, V.FILTER_LINE, V.BREADCRUMB_LINE))]


def remove_boilerplate(text: Column) -> Column:
    """Without navigation lines; hidden e-mail addresses become a marker."""
    shown = F.regexp_replace(text, "(?iu)" + V.HIDDEN_EMAIL, V.SHOWN_EMAIL.replace("$", r"\$"))
    shown = F.regexp_replace(shown, "(?iu)" + V.INLINE_TOGGLE, "")
    noise = lambda line: reduce(lambda a, b: a | b, [line.rlike(p) for p in NOISE_LINES])
    return F.coalesce(F.array_join(F.filter(T.lines(shown), lambda line: ~noise(line)), "\n"), F.lit(""))  # the patterns allow for white space at both ends


def normalize_headings(df: DataFrame, key: str, text: str, out: str | None = None) -> DataFrame:
    """Adds ``out`` (or replaces ``text``): Markdown headings without emphasis; a heading that repeats the one before it, with only blank or banner lines between, goes.

    A row is read by itself; ``key`` names it to callers and may repeat or be null. Other columns are kept.
    """
    return df.withColumn(out or text, S.normalize_headings(F.col(text)))


def clean_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """Boilerplate, then headings, then white space; as ``normalize_headings``, each row by itself."""
    df = normalize_headings(df.withColumn(text, remove_boilerplate(F.col(text))), key, text)
    return df.withColumn(text, T.normalize_whitespace(F.col(text)))


def clean_markdown(text: Column) -> Column:
    """After HTML conversion: plain spaces, no spaces at line ends or starts, no image lines, one blank line at most."""
    steps = (("\\u00a0", " "), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"(?im)^\s*image\s*:?.*$", ""), (r"\n{3,}", "\n\n"))
    return T.strip(reduce(lambda c, s: F.regexp_replace(c, *s), steps, text))
