"""Positions of regular expression matches, with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256


def sums_before(df: DataFrame, lengths: str, out: str) -> DataFrame:
    """Adds ``out``: for each element of the array column ``lengths`` the sum of those before it.

    Chunks of CHUNK elements first, each with the sums within it and its total, then a list of the totals, then of the sums
    before each chunk, by groups of CHUNK chunks again. Each step is bound by a one-element ``transform`` around all that
    uses it: a column of its own would be put back into the lambdas by the optimiser, and computed again for every element.
    So an element costs CHUNK steps, whatever the list's length, up to CHUNK ** 3 elements; beyond it some more.
    """
    return df.withColumn(out, before(F.col(lengths)))


def bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def before(values: Column, depth: int = 2) -> Column:
    """The sums before each element; lists of totals are summed in chunks too, ``depth`` times."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    if not depth:
        return F.transform(values, lambda _, k: total(F.slice(values, F.lit(1), k)))
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))
    within = lambda chunk, at: F.transform(chunk, lambda _, k: at + total(F.slice(chunk, F.lit(1), k)))

    def placed(cut: Column) -> Column:
        sums = bound(F.transform(cut, total), lambda totals: before(totals, depth - 1))
        return F.flatten(F.transform(F.arrays_zip(cut.alias("chunk"), sums.alias("at")), lambda x: within(x["chunk"], x["at"])))

    return bound(chunks, placed)


def cut_up(text: Column, size: int) -> Column:
    """Parts of ``size`` code points."""
    starts = lambda n: F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return bound(F.length(text), lambda n: F.transform(starts(n), lambda k: F.substring(text, k * size + 1, F.lit(size))))


def substrings(text: Column, ranges: Column, size: int = 1024) -> Column:
    """The text of each of array<struct<start, end>>, in code points. Places in a text are found by counting from its beginning, so it is cut into large parts first, these into small ones, and a range is looked up in its own."""
    small = F.flatten(F.transform(cut_up(text, 64 * size), lambda part: cut_up(part, size)))
    first = lambda x: F.floor(x["start"] / size).cast("int")
    own = lambda parts, x: F.array_join(F.slice(parts, first(x) + 1, F.greatest(F.floor((x["end"] - 1) / size).cast("int") - first(x) + 1, F.lit(0))), "")
    return bound(small, lambda parts: F.transform(ranges, lambda x: F.substring(own(parts, x), (x["start"] % size).cast("int") + 1, (x["end"] - x["start"]).cast("int"))))


def matches(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Adds ``out``: array<struct<start, end, text>> of the leftmost non-overlapping matches of ``pattern`` in ``text``, in code points.

    What stands between the matches comes from splitting at the same pattern, and only where there is a match.
    """
    df = df.withColumn(f"{out}_m", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    df = df.withColumn(f"{out}_g", F.when(F.size(f"{out}_m") > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array().cast("array<string>")))
    pairs = F.slice(F.arrays_zip(F.col(f"{out}_m").alias("m"), F.col(f"{out}_g").alias("g")), F.lit(1), F.size(f"{out}_m"))
    df = df.withColumn(f"{out}_n", F.transform(pairs, lambda x: F.length(x["m"]) + F.length(x["g"])).cast("array<bigint>"))
    df = sums_before(df, f"{out}_n", f"{out}_s")
    found = F.transform(
        F.arrays_zip(F.col(f"{out}_m").alias("m"), F.col(f"{out}_n").alias("n"), F.col(f"{out}_s").alias("s")),
        lambda x: F.struct((x["s"] + x["n"] - F.length(x["m"])).alias("start"), (x["s"] + x["n"]).alias("end"), x["m"].alias("text")),
    )
    return df.withColumn(out, found).drop(*[f"{out}_{k}" for k in "mgns"])


def joined(spans: Column) -> Column:
    """kind:start:end of each of array<struct<kind, start, end>>, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
