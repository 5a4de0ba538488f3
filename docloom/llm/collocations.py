"""Phrases whose words keep company, by two passes over the texts.

The first pass counts every n-gram of 1 to ``longest`` words in count-min sketches, one a task, in numpy; merged, they
overestimate each count and underestimate none. What leaves a task is as wide as the limit needs: counts stop at ``least``,
which keeps what the sketch is asked, whether a count reaches it. The second pass counts exactly, but only n-grams that every
row of the merged sketch lets pass, with both of their parts of one word less; whatever is frequent is among them. Its
survivors hold every part of every candidate, so scores and the dropping of phrases inside longer ones are joins of that
one table.

Sketches grow with the texts, up to ``CELLS`` cells a row (four bytes each in a task, a bit each when they are sent to all);
beyond it more rare n-grams pass, and the second pass leaves them out by their exact counts.

Defined results: null texts are empty; a null language is ``und``; words are what stands between spaces and tabs in the
pieces that punctuation and line ends leave, ASCII letters in lower case; very long texts are read a megabyte at a time, with
the words before carried over; equal rows count each; an empty table gives no phrase; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, size_of, slices
from .prefix_trie import stored

ROWS, CELLS, LEAST_CELLS = 3, 1 << 25, 1 << 18
#: Cells of a block of the sketch, and words that are counted together.
BLOCK, WORDS = 1 << 18, 1 << 18

BREAK = b"."
TABLE = bytes(ord(BREAK) if chr(c) in ".,;:!?\n\v\f\r" else c for c in range(256))
EDGE = re.compile(rb"[\x20\x09.]")
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None, each: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, with BREAK between its pieces, ``each`` bytes at a time."""
    data, at = (text or "").encode().lower().translate(TABLE), 0
    while at < len(data):
        end = at + each
        if end < len(data):
            found = EDGE.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end].replace(BREAK, b" . ").split()
        at = end


def runs_of(batches, longest: int, words: int = WORDS) -> Iterator[tuple[str, list[bytes], int]]:
    """(language, words, carried): some ``words`` words of one language at a time, the first ``carried`` of them told before; fewer, where many languages are held."""
    held: dict[str, list[bytes]] = {}
    carried: dict[str, int] = {}
    total = 0
    for batch in (part for whole in batches for part in slices(whole)):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for some in words_of(text.as_py()):
                own = held.setdefault(lang, [])
                own += some
                if len(own) >= words:
                    yield lang, own, carried.get(lang, 0)
                    held[lang] = own[-(longest - 1) :] if longest > 1 else []
                    carried[lang] = len(held[lang])
            held.setdefault(lang, []).append(BREAK)
            total += len(text.as_py() or "") + 100
            if total >= 16 * words:
                for other, own in held.items():
                    yield other, own, carried.get(other, 0)
                held, carried, total = {}, {}, 0
    for lang, own in held.items():
        yield lang, own, carried.get(lang, 0)


class Run:
    """The n-grams of a run of words: ids of the words, and for each length the places where one ends that was not told before."""

    def __init__(self, lang: str, words: list[bytes], carried: int):
        encoded = pa.array(words, pa.binary()).dictionary_encode()
        self.vocabulary, self.ids = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
        seed = xxhash.xxh32_intdigest(lang.encode())
        hashes = np.fromiter((xxhash.xxh64_intdigest(w.as_py(), seed) for w in self.vocabulary), np.uint64, len(self.vocabulary))
        self.hashes = hashes[self.ids]
        broken = np.array([w.as_py() == BREAK for w in self.vocabulary], bool)
        self.word = ~broken[self.ids]
        self.carried = carried

    def lengths(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, starts, hashes) of the n-grams within pieces, for n of 1 to ``longest``."""
        starts, sums = np.flatnonzero(self.word), None
        for n in range(1, longest + 1):
            if n > 1:
                whole = starts + n - 1 < len(self.word)
                starts, sums = starts[whole], sums[whole]
                whole = self.word[starts + n - 1]
                starts, sums = starts[whole], sums[whole]
            sums = self.hashes[starts] if n == 1 else (sums * FACTOR + self.hashes[starts + n - 1]) * MIX
            new = starts + n - 1 >= self.carried
            yield n, starts[new], sums[new]


def places(hashes: np.ndarray, n: int, row: int, cells: int) -> np.ndarray:
    """Cells of n-grams in a row of the sketch; ``cells`` is a power of two."""
    mixed = (hashes ^ (hashes >> np.uint64(32))) * (FACTOR + np.uint64(2 * (16 * row + n)))
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * MIX) >> np.uint64(64 - int(math.log2(cells)))).astype(np.int64)


def texts_by_lang(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, text), in so many partitions that a task's sketch is small beside what it reads."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return rows.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size_of(docs) / (1 << 30))))


def cells_for(size: int) -> int:
    """Cells a row for ``size`` bytes of files: a cell for 32 of them."""
    return min(CELLS, max(LEAST_CELLS, 1 << math.ceil(math.log2(max(size, 1) / 32 + 1))))


def narrow(least: int) -> np.dtype:
    """The smallest type that holds ``least``."""
    return np.dtype(np.uint8 if least < 1 << 8 else np.uint16 if least < 1 << 16 else np.uint32)


def sketch(texts: DataFrame, least: int, longest: int, cells: int, words: int = WORDS) -> DataFrame:
    """(block, passes): the merged sketch, a bit for each cell that reaches ``least``; blocks of a row follow one another."""
    kind, size = narrow(least), min(BLOCK, cells)

    def count(batches):
        counts = np.zeros((ROWS, cells), np.uint32)
        for lang, some, carried in runs_of(batches, longest, words):
            for n, _, hashes in Run(lang, some, carried).lengths(longest):
                for row in range(ROWS):
                    np.add.at(counts[row], places(hashes, n, row, cells), np.uint32(1))
        for k, block in enumerate(counts.reshape(-1, size)):
            if block.any():
                yield pa.record_batch([pa.array([k]), pa.array([np.minimum(block, least).astype(kind).tobytes()])], names=["block", "counts"])

    def merge(batches):
        last, total = None, None
        for block, counts in ((b.column(0)[k].as_py(), b.column(1)[k]) for whole in batches for b in slices(whole) for k in range(b.num_rows)):
            if block != last:
                if last is not None:
                    yield pa.record_batch([pa.array([last]), pa.array([np.packbits(total >= least).tobytes()])], names=["block", "passes"])
                last, total = block, np.zeros(size, np.int64)
            total = np.minimum(total + np.frombuffer(counts.as_buffer(), kind), least)
        if last is not None:
            yield pa.record_batch([pa.array([last]), pa.array([np.packbits(total >= least).tobytes()])], names=["block", "passes"])

    made = texts.mapInArrow(count, "block long, counts binary")
    return made.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, passes binary")


def added_up(counts: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """``counts`` (lang, phrase, m, f) with equal phrases of a task in one row, as long as some ``most`` rows hold them: a frequent phrase leaves a task once, not once for each run of words."""

    def together(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(some).group_by(["lang", "phrase", "m"], use_threads=False).aggregate([("f", "sum")])
        return table.select(["lang", "phrase", "m", "f_sum"]).rename_columns(["lang", "phrase", "m", "f"]).combine_chunks().to_batches()[0]

    held, rows = [], 0
    for batch in (b for b in counts if b.num_rows):
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            held = [together(held)]
            rows = held[0].num_rows
            if rows > most * 3 // 4:  # few are told again
                yield held[0]
                held, rows = [], 0
    if held:
        yield together(held)


def survivors(texts: DataFrame, merged: DataFrame, least: int, longest: int, cells: int, words: int = WORDS) -> DataFrame:
    """(lang, phrase, m, f): n-grams of ``least`` occurrences or more, m words each, counted exactly."""
    size = min(BLOCK, cells)
    bits = np.zeros((ROWS * cells // size, size // 8), np.uint8)
    for r in merged.toLocalIterator():  # ROWS * CELLS bits at most
        bits[r.block] = np.frombuffer(r.passes, np.uint8)
    passes = texts.sparkSession.sparkContext.broadcast(bits.reshape(ROWS, -1))

    def count(batches):
        yield from added_up(counted(batches))

    def counted(batches):
        held = passes.value
        for lang, some, carried in runs_of(batches, longest, words):
            run = Run(lang, some, 0)
            good, rank = None, run.ids
            for n, starts, hashes in run.lengths(longest):
                for row in range(ROWS):
                    at = places(hashes, n, row, cells)
                    fit = (held[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                    starts, hashes = starts[fit], hashes[fit]
                if n > 1:  # both parts of one word less have passed
                    both = good[starts] & good[starts + 1]
                    starts = starts[both]
                good = np.zeros(len(run.ids) + 1, bool)
                good[starts] = True
                if not len(starts):
                    break
                # ranks of the n-grams among those of this run, from the ranks of their first n - 1 words
                codes = rank[starts] if n == 1 else rank[starts] * len(run.vocabulary) + run.ids[starts + n - 1]
                _, first, which = np.unique(codes, return_index=True, return_inverse=True)
                rank = np.zeros(len(run.ids), np.int64)
                rank[starts] = which
                times = np.bincount(which[starts + n - 1 >= carried], minlength=len(first))
                at = starts[first][times > 0]
                said = [pc.cast(run.vocabulary.take(pa.array(run.ids[at + k])), pa.string()) for k in range(n)]
                phrase = pc.binary_join_element_wise(*said, " ") if n > 1 else said[0]
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), phrase, pa.array(np.full(len(at), n)), pa.array(times[times > 0])], names=["lang", "phrase", "m", "f"])

    made = texts.mapInArrow(count, "lang string, phrase string, m long, f long")
    return made.groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, m, a, l, r, n, score): for each phrase of two words or more its lowest-scoring cut, floor(1000 * a * n / (l * r)); of equal ones that of the shortest first part."""
    phrases = counts.where("m > 1").withColumnRenamed("f", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m").cast("int") - 1)))
    first = F.call_function("substring_index", "phrase", F.lit(" "), "k")
    cuts = cuts.withColumn("first", first).withColumn("rest", F.substring(F.col("phrase"), F.length("first") + 2, F.length("phrase")))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    met = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang")
    cut_ = F.struct(quotient(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")
    lowest = met.groupBy("lang", "phrase", "m", "a", "n").agg(F.min(cut_).alias("c"))
    return lowest.select("lang", "phrase", "m", "a", "c.l", "c.r", "n", "c.score")


def quotient(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), in whole numbers of up to 38 digits."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    above, below = wide(wide(a, 17) * F.lit(1000), 20) * wide(n, 17), wide(left, 18) * wide(right, 18)
    return F.call_function("div", above, below)


def inside_longer(counts: DataFrame) -> DataFrame:
    """(lang, phrase): phrases that stand inside a longer one that is as frequent. A phrase that is as frequent as a longer one around it is so as each one between, so one word more is all that has to be looked at."""
    long = counts.where("m > 2")
    ends = F.array(F.call_function("substring_index", "phrase", F.lit(" "), (F.col("m") - 1).cast("int")), F.substring(F.col("phrase"), F.instr("phrase", " ") + 1, F.length("phrase")))
    around = long.select("lang", F.explode(ends).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return counts.join(around, ["lang", "phrase"]).where("100 * longer >= 100 * f").select("lang", "phrase")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000, lang_col: str = "lang", text_col: str = "text", cells: int | None = None, words: int = WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` phrases of 2 to ``longest`` words and ``least`` occurrences or more, by score, those inside longer ones of the same count left out."""
    texts, cells = texts_by_lang(docs, lang_col, text_col), cells or cells_for(size_of(docs))
    merged = cut(sketch(texts, least, longest, cells, words))
    counts = stored(survivors(texts, merged, least, longest, cells, words))
    kept = scored(counts, stored(word_totals(texts))).join(inside_longer(counts), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def word_totals(texts: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences of a language."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            totals: dict[str, int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode().translate(TABLE).replace(BREAK, b" ")
                totals[lang] = totals.get(lang, 0) + len(data.split())
            yield pa.record_batch([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["lang", "n"])

    return texts.mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
