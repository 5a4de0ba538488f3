"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the words of all items and reads each document's words once, holding the longest match that
ends at every word. A window is ``window`` consecutive words of an item (an item of fewer is one window); words inside
an occurrence are hit. Items are taken in blocks of about ``block_words`` words, so a broadcast automaton has a
bound (some 60 MB in a Python worker at 100,000 words); more blocks mean more passes over the documents, whose hits are
united.

Words: runs of ASCII digits and letters (lower-cased) and all non-ASCII characters.

Defined results: null and empty texts have no words; very long texts are read whole, word by word; items without words
occur nowhere; equal items are all reported, in order of their ids as strings; a null item id is one; without items, or
with an empty table of documents, nothing is hit; rows of ``docs`` stay apart even if they agree; other columns are carried
along and never looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, slices

FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def places(text: str) -> list[tuple[int, int]]:
    """Character ranges of the words of ``text``."""
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)]


@dataclass
class Automaton:
    """Suffix automaton of several word sequences: every path from state 0 spells a run of words of some item."""

    window: int
    next: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: dict[int, set] = field(default_factory=dict)  # state of a full window -> items that hold it
    short: dict[int, list] = field(default_factory=dict)  # state -> (length, item) of items shorter than a window that end there
    least: int = 0  # words of the shortest window

    def add(self, last: int, word: bytes) -> int:
        """The state after ``last`` and ``word``, with all suffixes added."""
        follow, link, length = self.next, self.link, self.length
        if (q := follow[last].get(word)) is not None:
            return q if length[q] == length[last] + 1 else self.split(last, word, q)
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in follow[p]:
            follow[p][word] = new
            p = link[p]
        if p >= 0:
            q = follow[p][word]
            link[new] = q if length[q] == length[p] + 1 else self.split(p, word, q)
        return new

    def split(self, p: int, word: bytes, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def walk(self, words: list[bytes]):
        """(state, length of the longest match) at each word."""
        follow, link, length = self.next, self.link, self.length
        state = size = 0
        for w in words:
            to = follow[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = follow[state].get(w)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            yield state, size

    def up(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a match."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Disjoint ranges of hit words, the items hit, and the longest match. Only runs of known words are walked: any other word ends every match."""
        known, spans, items, longest, n = self.next[0], [], set(), 0, len(words)
        flags = bytes(map(known.__contains__, words))
        at = 0
        for run in re.finditer(b"\x01{%d,}" % max(1, self.least), flags) if self.least else ():
            at = run.start()
            for k, (state, size) in enumerate(self.walk(words[at : run.end()]), at):
                if size < self.least:
                    continue
                longest, reach = max(longest, size), 0
                if size >= self.window:
                    reach = self.window
                    items |= self.items[self.up(state, self.window)]
                if self.short:
                    s = state
                    while s > 0:
                        for m, item in self.short.get(s, ()):
                            if m <= size:
                                items.add(item)
                                reach = max(reach, m)
                        s = self.link[s]
                if reach:
                    a, b = k + 1 - reach, k + 1
                    while spans and spans[-1][1] >= a:
                        a = min(a, spans.pop()[0])
                    spans.append((a, b))
        assert not spans or spans[-1][1] <= n
        return spans, items, longest


def build(items: list[tuple[object, str | None]], window: int) -> Automaton:
    made, coded = Automaton(window), [(i, words_of(t)) for i, t in items]
    for _, words in coded:
        state = 0
        for w in words:
            state = made.add(state, w)
    for item, words in coded:
        if not words:
            continue
        made.least = min(made.least or window, len(words), window)
        for k, (state, _) in enumerate(made.walk(words), 1):
            if k >= window:
                made.items.setdefault(made.up(state, window), set()).add(item)
            elif k == len(words):
                made.short.setdefault(made.up(state, k), []).append((k, item))
    return made


def blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int):
    """Automata over consecutive items; the driver holds one block of items at a time."""
    held, words, any_ = [], 0, False
    for row in items.select(F.col(id_col), F.col(text_col)).toLocalIterator():
        held.append((row[0], row[1]))
        words += len(words_of(row[1]))
        if words >= block_words:
            yield build(held, window)
            held, words, any_ = [], 0, True
    if held or not any_:
        yield build(held, window)


def hits(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = 100_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, spans, longest): a row a document; spans are (start, end) in words."""
    sc = docs.sparkSession.sparkContext
    kind = dict(items.dtypes)[item_id_col]
    schema = f"doc_id long, n_words long, n_hit long, item_ids array<{kind}>, spans array<struct<start: int, end: int>>, longest int"
    types = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("longest", pa.int32())])

    def passed(shared, keyed: bool) -> DataFrame:
        def run(batches):
            automaton = shared.value
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words = words_of(text.as_py())
                    spans, found, longest = automaton.scan(words)
                    rows.append((doc_id, len(words), sum(b - a for a, b in spans), sorted(found, key=str), [{"start": a, "end": b} for a, b in spans], longest))
                columns = [pa.array([r[k] for r in rows], types.field(k).type) for k in range(6)]
                yield pa.RecordBatch.from_arrays([*columns, batch.column(2)], schema=types.append(pa.field("text_hash", pa.int64())))

        slim = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text") if keyed else F.lit(0).cast("long"))
        return slim.mapInArrow(run, schema + ", text_hash long")

    shared = [sc.broadcast(x) for x in blocks(items, item_id_col, item_text_col, window, block_words)]
    if len(shared) == 1:
        return passed(shared[0], False).drop("text_hash")
    return united(cut(reduce(DataFrame.unionByName, [passed(x, True) for x in shared])), len(shared))


def united(parts: DataFrame, n_blocks: int) -> DataFrame:
    """One row a document of the rows of several blocks. Equal documents have equal rows: they are united once and given back as often as they came."""
    parts = parts.groupBy("doc_id", "text_hash", "n_words", "item_ids", "spans", "longest").agg(F.count("*").alias("times"))
    ordered = F.array_sort(F.flatten(F.collect_list("spans")))
    ids = F.array_distinct(F.flatten(F.collect_list("item_ids")))
    # by name, a null id as the name None: as in one block
    named = F.sort_array(F.transform(ids, lambda x: F.struct(F.coalesce(x.cast("string"), F.lit("None")).alias("name"), x.alias("id"))))
    by_name = F.transform(named, lambda x: x["id"])
    whole = parts.groupBy("doc_id", "text_hash", "n_words").agg(ordered.alias("all"), by_name.alias("item_ids"), F.max("longest").alias("longest"), (F.sum("times") / n_blocks).cast("int").alias("times"))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def merge(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))
        return F.when(F.coalesce(last["end"], F.lit(-1)) >= x["start"], longer).otherwise(F.concat(acc, F.array(x)))

    whole = whole.withColumn("spans", F.aggregate("all", empty, merge))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    rows = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), "item_ids", "spans", "longest")


def marked(words: list[bytes], spans: list[tuple[int, int]]) -> bytearray:
    out = bytearray(len(words))
    for start, end in spans:
        out[start:end] = b"\x01" * (end - start)
    return out


def cut_out(text: str, hit: bytearray) -> str:
    """``text`` without the marked words and what stands between adjacent ones."""
    at, kept, done = places(text), [], 0
    for run in re.finditer(b"\x01+", bytes(hit)):
        kept.append(text[done : at[run.start()][0]])
        done = at[run.end() - 1][1]
    return "".join([*kept, text[done:]])


def without_spans(text: str, automaton: Automaton, max_coverage: float) -> str | None:
    """``text`` without the hit words and what stands between them, again until none is left; None if more than ``max_coverage`` of its words are hit at any time."""
    while True:
        words = words_of(text)
        hit = marked(words, automaton.scan(words)[0])
        if not any(hit):
            return text
        if sum(hit) > max_coverage * len(words):
            return None
        text = cut_out(text, hit)


def replaced_texts(docs: DataFrame, shared: list, max_coverage: float, text_col: str) -> DataFrame:
    """(key, other, new): what becomes of each text that is hit, null if it goes; key and other are hashes of the text as it was.

    A pass over the texts for each block of items, so that a task holds one automaton; each gives the ranges of its hits
    alone. Their union is cut out, and what is left of these texts is read again until nothing is hit.
    """

    def passed(texts: DataFrame, automaton) -> DataFrame:
        def run(batches):
            for batch in (part for whole in batches for part in slices(whole, 2)):
                found = [automaton.value.scan(words_of(t.as_py()))[0] for t in batch.column(2)]
                some = [k for k, x in enumerate(found) if x]
                spans = pa.array([[{"start": a, "end": b} for a, b in found[k]] for k in some], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.record_batch([batch.column(0).take(pa.array(some, pa.int64())), batch.column(1).take(pa.array(some, pa.int64())), spans], names=["key", "other", "spans"])

        return texts.mapInArrow(run, "key long, other long, spans array<struct<start: int, end: int>>")

    def cleaned(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            new = []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = words_of(text)
                hit = marked(words, [(x["start"], x["end"]) for x in spans])
                new.append(None if sum(hit) > max_coverage * len(words) else cut_out(text, hit))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(new, pa.string())], names=["key", "other", "text"])

    hashed = [F.xxhash64(F.col(text_col)).alias("key"), F.xxhash64(F.lit("other"), F.col(text_col)).alias("other")]
    texts = docs.where(F.col(text_col).isNotNull()).select(*hashed, F.col(text_col).alias("text"))
    done: list[DataFrame] = []
    while True:
        found = cut(reduce(DataFrame.unionByName, [passed(texts, x).dropDuplicates(["key", "other"]) for x in shared]))
        hits = found.groupBy("key", "other").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        if found.isEmpty():
            return reduce(DataFrame.unionByName, done) if done else texts.select("key", "other", F.col("text").alias("new")).limit(0)
        again = texts.join(hits, ["key", "other"]).dropDuplicates(["key", "other"]).select("key", "other", "text", "spans")
        made = cut(again.mapInArrow(cleaned, "key long, other long, text string"))
        if done:  # texts that were changed before: their last state counts
            done[0] = cut(done[0].join(made.select("key", "other"), ["key", "other"], "left_anti").unionByName(made.withColumnRenamed("text", "new")))
        else:
            done = [made.withColumnRenamed("text", "new")]
        texts = made.where("text is not null")


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.8, block_words: int = 100_000, text_col: str = "text", length_col: str | None = "n_chars", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with hit spans removed from the texts; documents of which more than ``max_coverage`` is hit go.

    Texts without a hit stay as they are. A task holds the automaton of one block of items: with one block the texts are
    read once, with more once a block, and only texts that are hit are ever shuffled.
    """
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast(x) for x in blocks(items, item_id_col, item_text_col, window, block_words)]
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(length_col) if length_col in docs.columns else None
    if len(shared) > 1:
        new = replaced_texts(docs, shared, max_coverage, text_col).select(F.col("key").alias("key__hit"), F.col("other").alias("other__hit"), F.col("new").alias("text__new"))
        own = (F.xxhash64(F.col(text_col)) == F.col("key__hit")) & (F.xxhash64(F.lit("other"), F.col(text_col)) == F.col("other__hit"))
        joined = docs.join(new, own, "left").where("key__hit is null or text__new is not null")
        hit = F.col("key__hit").isNotNull()
        changed = {text_col: F.when(hit, F.col("text__new")).otherwise(F.col(text_col))}
        if size_at is not None:
            changed[length_col] = F.when(hit, F.length("text__new").cast(docs.schema[size_at].dataType)).otherwise(F.col(length_col))
        return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])

    def run(batches):
        automaton = shared[0].value
        for batch in (part for whole in batches for part in slices(whole, at)):
            old = batch.column(at).to_pylist()
            new = [t and without_spans(t, automaton, max_coverage) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size_at is not None:
                sizes = [n if a == b else len(b or "") for n, a, b in zip(columns[size_at].to_pylist(), old, new, strict=True)]
                columns[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
            keep = pa.array([a is None or b is not None for a, b in zip(old, new, strict=True)])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)

    return docs.mapInArrow(run, docs.schema)
