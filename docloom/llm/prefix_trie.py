"""The trie of all conversations' prefixes, found by rolling fingerprints instead of turn after turn.

Turns are numbered by a scan over ranges of (conversation, turn), so a conversation of very many turns is dealt to many
tasks. The same numpy scan gives each prefix a polynomial fingerprint modulo 2**64, the sum of a turn's hash times an odd
base to the power of its number; sums of ranges are put together by what each range adds, a row a range. As the
fingerprints are sums, those of rebuilt conversations (first turns of one, the rest of another) come from a few of them.

Prefixes of one depth and fingerprint are candidates for one node. Each candidate group is held against its
representative, the member of the least id: the fingerprint one level up and the turn itself have to agree, role and
text, so that by induction all turns do. If any group breaks, hashes collided: every group is then split by one more
fingerprint, of another base and seed, and held again, until all hold. So the result never depends on a hash.

Parents roll up without walking the tree: a node's subtree is what its members' own nodes make up, a node being its
representative's own. Sums of own nodes a conversation, added up a node, less what lies above the node, are those of the
subtree.

Defined results: a null conversation id is no conversation; null roles and texts are empty; turns are in order of (turn,
role, text), nulls first, and equal rows stay; an empty text is a turn; very long texts are hashed whole; an empty table
gives no node, not even the root; other columns are not looked at. Ids that end at a node are hashed in one stream, in
order, as SHA-256 demands: what is held in memory is the state of the hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_dir, parts_for, slices

#: Rows that are sent to all tasks; more of them are joined.
FEW = 300_000
#: Turns of a conversation whose running sums one task takes.
CELL = 4096


def base_of(seed: int) -> np.uint64:
    """An odd base; it has an inverse modulo 2**64."""
    return np.uint64(xxhash.xxh64_intdigest(b"base", seed) | 5)


def powers(base: np.uint64, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2**64; negative exponents are powers of the inverse."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up = np.power(base, np.maximum(exponents, 0).astype(np.uint64))
    return up * np.power(inverse, np.maximum(-exponents, 0).astype(np.uint64))


def turn_hash(role: str, text: str, seed: int, bits: int) -> int:
    return xxhash.xxh64_intdigest(f"{len(role)}:{role}{text}".encode(), seed) & ((1 << bits) - 1)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that only columns in use are read."""
    df.write.parquet(at := fresh_dir(df.sparkSession, "trie"))
    return df.sparkSession.read.parquet(at)


def shared(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def longs(name: str, width: int) -> list[str]:
    return [f"{name}{w}" for w in range(width)]


def typed(*names: str) -> str:
    return ", ".join(f"{n} long" for n in names)


# --- turns and their fingerprints ---


def scanned(turns: DataFrame, width: int, bits: int, parts: int) -> DataFrame:
    """(range, conv_id, j, h..., p..., chars, role, text): in each range of the sorted turns the number of a turn of its conversation, from 1, its hashes, and the sums of hash times base ** j so far."""
    h, p = longs("h", width), longs("p", width)

    def run(batches):
        here, last, count, sums = TaskContext.get().partitionId(), None, 0, np.zeros(width, np.uint64)
        for batch in (part for whole in batches for part in slices(whole, 2)):
            conv, n = batch.column(0).to_numpy(), batch.num_rows
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
            goes_on = conv[0] == last
            j = np.arange(n) - starts[run_of] + 1
            j[run_of == 0] += count if goes_on else 0
            said = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            columns, totals = [], []
            for w in range(width):
                code = np.array([turn_hash(role, text, w, bits) for role, text in said], np.uint64)
                run_sum = np.cumsum(code * powers(base_of(w), j), dtype=np.uint64)
                before = np.r_[np.zeros(1, np.uint64), run_sum][starts][run_of]
                total = run_sum - before
                if goes_on:
                    total[run_of == 0] += sums[w]
                columns.append((code.view(np.int64), total.view(np.int64)))
                totals.append(total[-1])
            last, count, sums = conv[-1], int(j[-1]), np.array(totals, np.uint64)
            chars = pa.array([len(text) for _, text in said], pa.int64())
            yield pa.record_batch([pa.array(np.full(n, here)), batch.column(0), pa.array(j), *[pa.array(c) for c, _ in columns], *[pa.array(t) for _, t in columns], chars, batch.column(1), batch.column(2)], names=["range", "conv_id", "j", *h, *p, "chars", "role", "text"])

    dealt = turns.repartitionByRange(parts, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(run, f"{typed('range', 'conv_id', 'j', *h, *p, 'chars')}, role string, text string")


def range_starts(scans: DataFrame, width: int) -> DataFrame:
    """(range, conv_id, offset, q...): for conversations in several ranges, turns and sums before each. A conversation has a row a range here, a range at most two such conversations."""
    p, q = longs("p", width), longs("q", width)
    last = scans.groupBy("conv_id", "range").agg(F.max(F.struct("j", *p)).alias("s"))
    several = last.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("range", "s.*"))).alias("r")).where(F.size("r") > 1)

    def run(batches):
        for batch in batches:
            rows = []
            for conv, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                offset, sums = 0, [0] * width
                for r in ranges:
                    rows.append((r["range"], conv, offset, *[s - (1 << 64) if s >> 63 else s for s in sums]))
                    sums = [(s + r[f"p{w}"] * pow(int(base_of(w)), offset, 1 << 64)) % (1 << 64) for w, s in enumerate(sums)]
                    offset += r["j"]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * (3 + width), names=["range", "conv_id", "offset", *q])

    return several.mapInArrow(run, typed("range", "conv_id", "offset", *q))


def numbered(scans: DataFrame, starts: DataFrame, width: int) -> DataFrame:
    """(conv_id, k, h..., p..., chars): a turn's number in its whole conversation, from 1, and the fingerprint of the turns up to it."""
    h, p, q = longs("h", width), longs("p", width), longs("q", width)

    def run(batches):
        for batch in batches:
            column = {n: batch.column(n).to_numpy() for n in batch.schema.names}
            whole = [column[f"q{w}"].view(np.uint64) + column[f"p{w}"].view(np.uint64) * powers(base_of(w), column["offset"]) for w in range(width)]
            yield pa.record_batch([pa.array(x) for x in (column["conv_id"], column["j"] + column["offset"], *[column[n] for n in h], *[x.view(np.int64) for x in whole], column["chars"])], names=["conv_id", "k", *h, *p, "chars"])

    rows = scans.select("range", "conv_id", "j", *h, *p, "chars").join(shared(starts), ["range", "conv_id"], "left")
    return rows.select("conv_id", "j", *h, *p, "chars", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("offset", *q)]).mapInArrow(run, typed("conv_id", "k", *h, *p, "chars"))


# --- rebuilt conversations ---


def heads(conv_id: Column, most: int) -> Column:
    """How many first turns a conversation gets from another."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (most + 1)).cast("int")


def rebuilt(turns: DataFrame, width: int, block: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Of conversations that begin with the first turns of the first one of their ``block`` of ids, none if ``most`` is 0: (conv_id, d, f..., up..., chars, from_id, from_k, end), a row a prefix, from its last turn; and (conv_id) of those without turns.

    f and up are the fingerprints of the prefix and of the one before it; from_id and from_k tell the turn it is.
    """
    h, p, f, up = (longs(x, width) for x in ("h", "p", "f", "up"))
    first = F.when(F.col("k") <= most, F.struct("k", *h, *p, "chars"))
    info = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(first)).alias("own")).withColumn("heads", heads(F.col("conv_id"), most)).withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    info = stored(info)
    bases = info.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("first"))
    info = info.join(bases, "base", "left").withColumn("first", F.slice(F.coalesce("first", F.array().cast(info.schema["own"].dataType)), F.lit(1), F.col("heads")))
    length = F.size("first") + F.greatest(F.col("n") - F.col("heads"), F.lit(0))
    zero = F.lit(0).cast("long")
    sum_at = lambda a, k: [F.coalesce(F.when(k > 0, F.try_element_at(a, k)[c]), zero) for c in p]
    info = stored(info.select("conv_id", "heads", "base", "first", length.cast("long").alias("length"), (F.size("first") - F.col("heads")).cast("long").alias("shift"), *[x.alias(f"b{w}") for w, x in enumerate(sum_at("first", F.size("first")))], *[x.alias(f"o{w}") for w, x in enumerate(sum_at("own", F.col("heads")))]))
    b, o = longs("b", width), longs("o", width)
    given = info.select("conv_id", "base", "length", F.explode("first").alias("t")).select("conv_id", F.col("t.k").alias("d"), F.col("base").alias("from_id"), F.col("t.k").alias("from_k"), F.col("t.chars").alias("chars"), "length", zero.alias("shift"), *[zero.alias(x) for x in (*b, *o)], *[F.col(f"t.{x}").alias(x) for x in (*h, *p)])
    kept = turns.join(info.drop("first", "base"), "conv_id").where("k > heads").select("conv_id", (F.col("k") + F.col("shift")).alias("d"), F.col("conv_id").alias("from_id"), F.col("k").alias("from_k"), "chars", "length", "shift", *b, *o, *h, *p)

    def run(batches):
        for batch in batches:
            x = {n: batch.column(n).to_numpy() for n in batch.schema.names}
            of = lambda n: x[n].view(np.uint64)
            sums = [of(f"b{w}") + powers(base_of(w), x["shift"]) * (of(f"p{w}") - of(f"o{w}")) for w in range(width)]
            before = [s - powers(base_of(w), x["d"]) * of(f"h{w}") for w, s in enumerate(sums)]
            made = [x["conv_id"], x["d"], *[s.view(np.int64) for s in (*sums, *before)], x["chars"], x["from_id"], x["from_k"], x["d"] == x["length"]]
            yield pa.record_batch([pa.array(m) for m in made], names=["conv_id", "d", *f, *up, "chars", "from_id", "from_k", "end"])

    rows = given.union(kept).mapInArrow(run, f"{typed('conv_id', 'd', *f, *up, 'chars', 'from_id', 'from_k')}, end boolean")
    return rows, info.where("length = 0").select("conv_id")


# --- nodes ---


def broken(rows: DataFrame, nodes: DataFrame, texts: DataFrame, width: int) -> bool:
    """Whether some group's members are not its representative, turn by turn."""
    key = ["d", *longs("f", width)]
    apart = nodes.where("up_differs")
    if not apart.isEmpty():
        return True
    several = nodes.where("n_convs > 1").select(*key, F.col("rep.from_id").alias("rep_id"), F.col("rep.from_k").alias("rep_k"))
    pairs = rows.select(*key, "from_id", "from_k").join(several, key).where("from_id <> rep_id OR from_k <> rep_k").select("from_id", "from_k", "rep_id", "rep_k").distinct()
    # equal turns of one representative are one row before they meet it
    told = texts.join(pairs, (F.col("conv_id") == F.col("from_id")) & (F.col("k") == F.col("from_k"))).select("rep_id", "rep_k", F.col("role").alias("own_role"), F.col("text").alias("own_text")).distinct()
    held = told.join(texts, (F.col("conv_id") == F.col("rep_id")) & (F.col("k") == F.col("rep_k")))
    return not held.where("own_role <> role OR own_text <> text").isEmpty()


def sums_above(nodes: DataFrame, cell: int = CELL) -> DataFrame:
    """``nodes`` with ``above``: of its representative's own nodes, the sum of ``own`` at lower depths; in cells of depths and then over cells, so that no conversation meets in one task."""
    marked = nodes.withColumn("cell", F.floor(F.col("d") / cell))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    cells = marked.groupBy("conv_id", "cell").agg(F.sum("own").alias("whole"))
    cells = cells.select("conv_id", "cell", F.coalesce(F.sum("whole").over(before("conv_id", "cell")), F.lit(0)).alias("cells_above"))
    within = marked.withColumn("within", F.coalesce(F.sum("own").over(before("conv_id", "cell", "d")), F.lit(0)))
    return within.join(cells, ["conv_id", "cell"]).withColumn("above", F.col("within") + F.col("cells_above")).drop("cell", "within", "cells_above")


def ends(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key..., ends_sha256): the digest of the ids of the conversations that end at a node."""

    def run(batches):
        last, state = None, None
        for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            made = []
            for *now, conv in zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)], strict=True):
                if now != last:
                    if last is not None:
                        made.append((*last, state.hexdigest()))
                    last, state = now, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield from given(made)
        if last is not None:
            yield from given([(*last, state.hexdigest())])

    def given(made):
        if made:
            *keys, digests = zip(*made, strict=True)
            yield pa.record_batch([*[pa.array(k, pa.int64()) for k in keys], pa.array(digests)], names=[*key, "ends_sha256"])

    dealt = rows.select(*key, "conv_id").repartition(*key).sortWithinPartitions(*key, "conv_id")
    return dealt.mapInArrow(run, f"{typed(*key)}, ends_sha256 string")


def trie(conversations: DataFrame, block: int = 100, most: int = 5, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bits: int = 64, parts: int | None = None) -> DataFrame:
    """The nodes of the trie of the conversations as ``rebuilt`` makes them; ``most=0`` takes them as they are.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a node's name is the least
    id of its members, with its depth; saved_tokens are the characters of last texts that members repeat, over the subtree.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).where("conv_id IS NOT NULL")
    width = 0
    while True:
        width += 1
        key, up = ["d", *longs("f", width)], longs("up", width)
        scans = stored(scanned(turns, width, bits, parts or parts_for(conversations)))
        starts = cut(range_starts(scans, width))
        rows, silent = rebuilt(stored(numbered(scans, starts, width)), width, block, most)
        rows = stored(rows)
        differs = F.min(F.struct(*up, "chars")) != F.max(F.struct(*up, "chars"))
        nodes = stored(rows.groupBy(*key).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.min(u).alias(u) for u in up], F.min("chars").alias("chars"), F.min_by(F.struct("from_id", "from_k"), "conv_id").alias("rep"), differs.alias("up_differs")))
        texts = scans.join(shared(starts.select("range", "conv_id", "offset")), ["range", "conv_id"], "left").select("conv_id", (F.col("j") + F.coalesce("offset", F.lit(0))).alias("k"), "role", "text")
        if not broken(rows, nodes, texts, width):
            return rolled_up(rows, nodes, silent, key, up)


def rolled_up(rows: DataFrame, nodes: DataFrame, silent: DataFrame, key: list[str], up: list[str]) -> DataFrame:
    """Counts and sums of each node's children, leaves and subtree, and the root."""
    parent = lambda alias: [(F.col("d") - 1).alias("d"), *[F.col(u).alias(k) for u, k in zip(up, key[1:], strict=True)], *alias]
    children = nodes.where("d > 1").select(*parent([])).groupBy(*key).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("own", (F.col("n_convs") - 1) * F.col("chars")))
    alone, several = nodes.where("n_convs = 1"), nodes.where("n_convs > 1")
    # what a conversation's own nodes add to those of its prefixes
    given = nodes.groupBy("conv_id").agg(F.sum("own").alias("own_sum"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("own_leaves")).where("own_sum > 0 OR own_leaves > 0")
    met = rows.select("conv_id", *key).join(several.select(*key), key, "left_semi").join(given, "conv_id")
    sums = met.groupBy(*key).agg(F.sum("own_sum").alias("below"), F.sum("own_leaves").alias("n_leaves"))
    several = sums_above(several).join(sums, key, "left").withColumn("saved", F.coalesce("below", F.lit(0)) - F.col("above"))
    counted = alone.select(*key, *up, "conv_id", "n_convs", "n_children", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"))
    counted = counted.union(several.select(*key, *up, "conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)), "saved"))
    # the root: one row of sums, its children need no join
    every = rows.where("d = 1").select("conv_id").union(silent).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    total = nodes.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("saved"), F.count(F.when(F.col("n_children") == 0, 1)).alias("n_leaves"), F.count(F.when(F.col("d") == 1, 1)).alias("n_children"))
    root = cut(every.crossJoin(F.broadcast(total)).withColumn("n_leaves", F.greatest("n_leaves", F.lit(1))))
    of_root = F.broadcast(root.select(F.col("conv_id").alias("parent_conv_id")))
    above = nodes.join(children.select(*key), key, "left_semi").select(*[F.col(k).alias(f"{k}__up") for k in key], F.col("conv_id").alias("parent_conv_id"))
    same = [F.col("d") - 1 == F.col("d__up"), *[F.col(u) == F.col(f"{k}__up") for u, k in zip(up, key[1:], strict=True)]]
    deep = counted.where("d > 1").join(above, same)
    shown = ["conv_id", "d", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", *key[1:]]
    zeros = [F.lit(0).cast("long").alias(k) for k in key[1:]]
    none = F.lit(None).cast("long").alias("parent_conv_id")
    made = deep.select(*shown).union(counted.where("d = 1").crossJoin(of_root).select(*shown)).union(root.withColumn("d", F.lit(0).cast("long")).select("conv_id", "d", none, "n_convs", "n_children", "n_leaves", "saved", *zeros))
    ended = ends(rows.where("end").select("conv_id", *key).union(silent.select("conv_id", F.lit(0).cast("long").alias("d"), *zeros)), key)
    found = made.join(ended, key, "left")
    return found.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
