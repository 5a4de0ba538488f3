"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the keys are cut into equal ranges ("cells"), each cell is
sorted by key, and word counts are summed in two levels: over the cells of a source, then within a cell. The running
total decides how often a document is taken: whole epochs of its source first, then the key order up to the budget,
where the last document is cut to the word.

No step brings a source together in one task: cells hold about 1/2**cell_bits of a source, and only their sums meet. Rows
without an id share one key; they are cut into cells of their own, by size and by a hash of their text, in the order of
their sizes. Sources themselves meet in one task, a row each: that bounds them to some hundred thousand.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its own, after all others;
null ids come in the order of an empty id's key; of rows that share an id the smaller comes first, and rows that agree in
id, source and size are interchangeable; very long texts count as any other, and the one at a budget's edge is cut at the
word; an empty table gives an empty mix; other columns are carried along and never looked at.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut

WORD = f"[^{SPACE}]+"
PIECE = f"[{SPACE}]*[^{SPACE}]+"
KEY_BITS, SALTS = 60, 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(row_id: Column, seed: str) -> Column:
    """60 bits of MD5 of seed and id, so that other engines can reproduce the order."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("")))), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Targets for (src, source_size, weight), one row a source: shares by weight, none above ``max_epochs`` sizes.

    With the sources in order of cap/weight, the level after capping the first k is (total - their caps) / weights left;
    it rises until the level that satisfies every cap and falls after it, so the level wanted is its maximum.
    The windows below run over one row a source, never over documents.
    """
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    return (
        sources.withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.col("total") - F.col("capped")).cast("double") / F.col("weight_left").cast("double")).over(everything))
        .select("src", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight").cast("double")).alias("target"))
    )


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Adds weight 1, 2, ... cycle, repeating, by code point order of the source, null last."""
    place = F.row_number().over(Window.orderBy("src")).cast("long")
    return sources.withColumn("weight", (place - 1) % cycle + 1)


def mix(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = 3, cell_bits: int = 12, seed: str = "mix", weigh=cyclic_weights) -> DataFrame:
    """The mix of ``docs``: (row struct<carry>, doc_id, size, source_size, target, taken).

    weigh: from one row a source (src, source_size) to the same with a positive ``weight``. ``src`` is 's' + source, or
    't' for null, which sorts last.
    """
    own = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(1).alias("one"))
    key = random_key(F.col(id_col), seed)
    none = F.lit(int(hashlib.md5(f"{seed}:".encode()).hexdigest()[: KEY_BITS // 4], 16)).cast("long")  # the key of rows without an id
    salted = (n_words(F.col(text_col)) + 1) * SALTS + F.pmod(F.xxhash64(F.col(text_col)), F.lit(SALTS))
    sub = F.when(F.col(id_col).isNull(), salted).when(key > none, F.lit((1 << 63) - 1)).otherwise(F.lit(0))  # in the order of (key, id, size)
    slim = docs.select(
        own.alias("row"), F.col(id_col).alias("doc_id"), F.when(F.col(source_col).isNull(), "t").otherwise(F.concat(F.lit("s"), F.col(source_col))).alias("src"),
        n_words(F.col(text_col)).alias("size"), key.alias("key"), F.shiftright(key, KEY_BITS - cell_bits).cast("int").alias("cell"), sub.cast("long").alias("sub"),
    )
    if not carry:
        slim = cut(slim)
    cells = cut(slim.groupBy("src", "cell", "sub").agg(F.sum("size").alias("cell_size")))
    budgets = (
        source_targets(weigh(cells.groupBy("src").agg(F.sum("cell_size").alias("source_size"))), max_epochs)
        .withColumn("budget", F.floor("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    before = Window.partitionBy("src").orderBy("cell", "sub").rowsBetween(Window.unboundedPreceding, 0)
    offsets = cells.withColumn("cell_start", F.sum("cell_size").over(before) - F.col("cell_size")).join(budgets, "src").drop("cell_size", "budget")
    within = Window.partitionBy("src", "cell", "sub").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("cell_start") + F.sum("size").over(within) - F.col("size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return slim.join(offsets, ["src", "cell", "sub"]).withColumn("start", start).select("row", "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"))


def mixed_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` as the mix takes them: a row for each time a document is taken, the one at the budget's edge cut to its first words."""
    found = mix(docs, carry=docs.columns, text_col=text_col, **options)
    size, taken = F.greatest(F.col("size"), F.lit(1)), F.col("taken")
    whole, rest = F.floor(taken / size).cast("int"), taken % size
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    rows = found.where(taken > 0).select("row", F.explode(copies).alias("words"))
    pieces = F.regexp_extract_all(F.col("row")[text_col], F.lit(PIECE), F.lit(0))
    text = F.when(F.col("words") == 0, F.col("row")[text_col]).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), ""))
    rows = rows.withColumn("cut_text", text)
    own = {text_col: F.col("cut_text")} | ({length_col: F.length("cut_text").cast("long")} if length_col in docs.columns else {})
    return rows.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
