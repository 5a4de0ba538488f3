"""Text functions, Column -> Column, of built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

#: Letters and digits of any script, and the underscore: what counts as a word character.
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, then) -> Column:
    """then(x) for x = ``value``, which is computed once however often x is used, also inside lambdas."""
    return F.transform(F.array(value), then)[0]


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def lines(c: Column) -> Column:
    """Lines as at \\n, \\r or \\r\\n, without an empty one after a final line end."""
    whole = F.split(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\n\z", ""), "\n", -1)
    return F.when(c != "", whole).when(c == "", F.array().cast("array<string>"))


def fold_accents(c: Column) -> Column:
    return F.translate(F.lower(c), "".join(V.ACCENTED.values()), "".join(k * len(v) for k, v in V.ACCENTED.items()))


def slug(c: Column, max_length: int = 50) -> Column:
    """snake_case without accents; 'sec' if nothing is left."""
    whole = F.btrim(F.regexp_replace(fold_accents(c), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(F.rtrim(F.substring(whole, 1, max_length), F.lit("_")), F.lit("")), F.lit("sec"))


def url_slug(c: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("document"))


def roman(c: Column) -> Column:
    """Value of a roman numeral; null for anything else. A numeral less than a later one counts negative."""
    cleaned = F.upper(strip(c))
    value = F.create_map(*[x for k, v in V.ROMAN.items() for x in (F.lit(k), F.lit(v))])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))

    def add(acc, letter):
        v = value[letter]
        smaller = v < acc["most"]
        return F.struct((acc["total"] + F.when(smaller, -v).otherwise(v)).alias("total"), F.greatest(acc["most"], v).alias("most"))

    total = F.aggregate(F.reverse(F.split(cleaned, "")), start, add, lambda acc: acc["total"])
    return F.when(cleaned.rlike("^[IVXLCDM]+$"), total)


def number_label(c: Column) -> Column:
    """Digits as they are, roman numerals as digits, '12a' in lower case, anything else as a slug of 20."""
    cleaned = strip(c)
    return F.when(cleaned.rlike("^[0-9]+$"), cleaned).otherwise(
        F.coalesce(roman(cleaned).cast("string"), F.when(cleaned.rlike("^[0-9]"), F.lower(F.regexp_extract(cleaned, "^([0-9]+[a-zA-Z]?)", 1))), slug(cleaned, 20))
    )


def one_spaced(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def clean_heading(c: Column) -> Column:
    """Without hashes, links, emphasis and runs of white space."""
    text = F.regexp_replace(strip(c), r"^#+\s*", "")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^\)]+\)", "$1")
    return one_spaced(F.regexp_replace(text, r"[*_]", ""))


def plain_heading(c: Column) -> Column:
    return one_spaced(F.regexp_replace(c, r"\*\*|__", ""))


def normalize_whitespace(c: Column, max_blank: int = 2) -> Column:
    """At most ``max_blank`` blank lines in a row, no white space at line ends; a final line end if anything is left."""
    trimmed = F.regexp_replace(F.array_join(lines(c), "\n"), r"[^\S\n]+(?=\n|$)", "")
    body = strip(F.regexp_replace(trimmed, r"\n{%d,}" % (max_blank + 2), "\n" * (max_blank + 1)))
    return let(body, lambda b: F.when(b != "", F.concat(b, F.lit("\n"))).otherwise(""))


def yaml_quote(c: Column) -> Column:
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def preview(c: Column, n: int = 200) -> Column:
    return F.replace(F.substring(c, 1, n), F.lit("\n"), F.lit(" "))


def folded(c: Column) -> Column:
    """For comparison regardless of case."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def contains_folded(text: Column, part: Column) -> Column:
    return F.contains(folded(text), folded(part))


def url_host(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def url_scheme(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("PROTOCOL")))


def url_stem(c: Column) -> Column:
    """Last part of the path without its extension."""
    name = F.regexp_extract(F.regexp_replace(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), "/+$", ""), "([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def any_in(c: Column, words: list[str]) -> Column:
    """Whether any of the words is part of ``c``."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def count_in(c: Column, words: list[str]) -> Column:
    """How many of the words are part of ``c``."""
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(w)).cast("int") for w in words])


def first_in(c: Column, table: dict[str, str]) -> Column:
    """The value of the first key, in order, that is part of ``c``; null if none is."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(k)), F.lit(v)) for k, v in table.items()])


def replaced_in_turn(c: Column, table: dict[str, str]) -> Column:
    """Every key replaced by its value, each in what the ones before have made of ``c``."""
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), table.items(), c)


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))
