"""Near-duplicates by SimHash.

A fingerprint is the bitwise majority over XXH64 hashes of word shingles. Two fingerprints link at ``max_bits``
differing bits or fewer. 64 bits are cut into six blocks; two fingerprints that differ in three bits agree in at least
three blocks, so each of the 20 choices of three blocks is a bucket key of about 32 bits: candidates per fingerprint
stay few even at 10**9 fingerprints. Equal fingerprints are one row before any bucket is formed, so exact copies cost
nothing more; within a bucket only a spanning forest of the links is kept, never all pairs. Groups are the connected
components of the links, found by alternating large-star and small-star rounds.

Buckets of very many distinct fingerprints are cut further, across tasks.

Defined results: null and empty texts have fingerprint 0; texts shorter than a shingle are one shingle; very long texts
are read whole, 65,536 shingles at a time; equal rows share a group; of equally good representatives the least id, then
the least text hash, stays; a null id never names a group that has another id; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_and_text, parts_for

SEED = 42
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Fingerprints of a bucket that are compared all with all; larger buckets are cut by further bits first.
FULL = 4096


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    counts, total = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, total, 1 << 16):
        part = words[at : min(at + (1 << 16), total) + shingle - 1]
        hashes = np.array([digest(b" ".join(x), SEED) for x in zip(*(part[k:] for k in range(shingle)), strict=False)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(hashes[:, k], minlength=256) @ BITS_OF_BYTE
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp): the text's XXH64 as Spark computes it, and the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(prints)], names=["doc_id", "key", "fp"])

    return id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, fp long")


def block_masks(max_bits: int = 3, blocks: int = 6) -> list[int]:
    """Masks of every choice of ``blocks - max_bits`` of the blocks of a fingerprint, as signed longs."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(single[k] for k in chosen) for chosen in combinations(range(blocks), blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(prints: np.ndarray, free: list[int], max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (from, to) that join distinct fingerprints exactly as all links of ``max_bits`` or fewer do.

    free: the bits in which they may differ. A large set is first cut by the pigeonhole rule on these bits, as long as
    that makes the parts smaller; the parts' links together hold every link.
    """
    if len(prints) < 2:
        return []
    if len(prints) > FULL and len(free) > max_bits + 1:
        found, quarter = [], max_bits + 1
        for k in range(quarter):
            own = free[k::quarter]
            mask = np.uint64(sum(1 << b for b in own))
            order = np.argsort(prints & mask, kind="stable")
            rows = prints[order]
            starts = np.flatnonzero(np.r_[True, np.diff(rows & mask) != 0])
            if len(starts) == 1:
                return forest(prints, [b for b in free if b not in own], max_bits)
            for a, b in zip(starts, np.r_[starts[1:], len(rows)], strict=False):
                found += forest(rows[a:b], [x for x in free if x not in own], max_bits)
        return found
    found, left = [], prints
    while len(left) > 1:
        seed, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = (np.bitwise_count(front[:64, None] ^ left[None, :]) <= max_bits).any(axis=0)
            new, left = left[near], left[~near]
            front = np.concatenate([front[64:], new])
            if len(new):
                found.append((new, np.full(len(new), seed, np.uint64)))
    return found


def bucket_links(which: np.ndarray, key: np.ndarray, prints: np.ndarray, masks: list[int], max_bits: int, few: int = 8):
    """Links within whole buckets; rows are sorted by (which, key)."""
    same = (which[1:] == which[:-1]) & (key[1:] == key[:-1])
    starts = np.flatnonzero(np.r_[True, ~same])
    sizes = np.diff(np.r_[starts, len(key)])
    group = np.repeat(np.arange(len(starts)), sizes)
    found = []
    small = np.flatnonzero((sizes <= few)[group] & (sizes > 1)[group])
    g, p = group[small], prints[small]
    for d in range(1, few):
        near = (g[d:] == g[:-d]) & (np.bitwise_count(p[d:] ^ p[:-d]) <= max_bits)
        found.append((p[d:][near], p[:-d][near]))
    for k in np.flatnonzero(sizes > few):
        found += forest(prints[starts[k] : starts[k] + sizes[k]], free_bits(int(which[starts[k]]), masks, max_bits), max_bits)
    return [np.concatenate(x) for x in zip(*found, strict=False)] if found else [np.zeros(0, np.uint64)] * 2


#: Fingerprints of a bucket that one task takes; larger buckets are cut across tasks. One in SEEN is counted to find them.
HOT, SEEN = 1 << 18, 16


def free_bits(which: int, masks: list[int], max_bits: int) -> list[int]:
    """The bits in which fingerprints of a bucket may differ. which: a choice of blocks, then for each cut of a large bucket the part of the free bits that agrees."""
    path = []
    while which >= len(masks):
        which -= len(masks)
        path.append(which % (max_bits + 1))
        which //= max_bits + 1
    mask = masks[which] & ((1 << 64) - 1)
    free = [b for b in range(64) if not mask >> b & 1]
    for k in reversed(path):
        own = set(free[k :: max_bits + 1])
        free = [b for b in free if b not in own]
    return free


def deeper(which: int, part: int, masks: list[int], max_bits: int) -> int:
    return len(masks) + which * (max_bits + 1) + part


def cut_hot(buckets: DataFrame, masks: list[int], max_bits: int, hot: int, seen: int) -> DataFrame:
    """``buckets`` (which, key, fp) with those of about ``hot`` fingerprints or more cut by the pigeonhole rule on the bits that are left: two fingerprints at ``max_bits`` agree in one of max_bits + 1 parts of them. A sample of the fingerprints tells which are large; that decides where the work is done, not what is found."""
    whole = buckets
    while True:
        counted = whole.where(F.pmod(F.xxhash64("fp"), F.lit(seen)) == 0).groupBy("which", "key").count().where(F.col("count") * seen >= hot)
        large = cut(counted.select(F.col("which").alias("which__hot"), F.col("key").alias("key__hot")))
        kinds = [r[0] for r in large.select("which__hot").distinct().collect()]  # a few paths
        parts = {w: free_bits(w, masks, max_bits) for w in kinds}
        parts = {w: [free[k :: max_bits + 1] for k in range(max_bits + 1)] for w, free in parts.items() if len(free) > max_bits + 1}
        large = large.where(F.col("which__hot").isin(*parts)) if parts else large.limit(0)
        if not parts:
            return whole
        same = (F.col("which") == F.col("which__hot")) & (F.col("key") == F.col("key__hot"))
        cold = whole.join(large, same, "left_anti")
        choice = None
        for w, own in parts.items():
            made = F.array(*[F.struct(F.lit(deeper(w, k, masks, max_bits)).cast("long").alias("which"), F.xxhash64("key", F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in bits))).cast("long"))).alias("key")) for k, bits in enumerate(own)])
            choice = F.when(F.col("which") == w, made) if choice is None else choice.when(F.col("which") == w, made)
        split = whole.join(large, same, "left_semi").select("fp", F.explode(choice).alias("b")).select("b.which", "b.key", "fp")
        whole = cut(cold.unionByName(split))


def signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def links(prints: DataFrame, max_bits: int = 3, hot: int = HOT, seen: int = SEEN) -> DataFrame:
    """(u, v), u > v: links between distinct fingerprints of ``prints`` (fp), enough to connect all that are connected."""
    masks = block_masks(max_bits)

    def run(batches):
        for rows in whole_runs(batches, 2):
            which, key, fp = (rows.column(k).to_numpy() for k in range(3))
            a, b = bucket_links(which, key, fp.view(np.uint64), masks, max_bits)
            a, b = a.view(np.int64), b.view(np.int64)
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    keys = F.array(*[F.struct(F.lit(k).cast("long").alias("which"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(masks)])
    buckets = prints.select("fp", F.explode(keys).alias("b")).select("b.which", "b.key", "fp")
    n = prints.count()
    buckets = cut_hot(buckets, masks, max_bits, hot, seen) if n >= hot else buckets
    parts = parts_for(prints, 17 * len(masks) * n, 64 << 20)
    dealt = buckets.repartition(parts, "which", "key").sortWithinPartitions("which", "key")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root): for every node of ``edges`` (u > v) that isn't the least of its component, the least.

    Each round hangs neighbours on ever smaller nodes; it ends when a round changes nothing. Only per-node minima are
    grouped, and Spark can split the joins of a node with very many links.
    """
    seen = None
    edges = cut(edges)
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if state == seen:
            return edges.withColumnRenamed("v", "root")
        seen = state
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v"), F.col("m"))).distinct())


def rooted_prints(docs: DataFrame, shingle: int, max_bits: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, fp) of each row, and (fp, first_id, root) of each distinct fingerprint."""
    marked = cut(fingerprints(docs, shingle, id_col, text_col))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct.select("fp"), max_bits))
    return marked, distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 lower-case hex digits, and the least id of the document's group."""
    marked, rooted = rooted_prints(docs, shingle, max_bits, id_col, text_col)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Rows of ids and hashes that are sent to all tasks; more of them are joined.
FEW = 300_000


def kept_rows(docs: DataFrame, rooted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of ``rooted`` (doc_id, key, root), key being xxhash64 of the text: that of the least id, then key.

    Texts are not shuffled as long as the rows that go are few.
    """
    counted = cut(rooted.groupBy("root", "doc_id", "key").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("first")
    marked = counted.join(cut(counted.groupBy("root").agg(first)), "root")  # from a table, so that Spark can split a large group
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    named = [F.col("doc_id").alias("doc_id__kept"), F.col("key").alias("key__kept")]
    repeated, gone = cut(marked.where(stays & (F.col("n") > 1)).select(*named)), cut(marked.where(~stays).select(*named))
    own = F.col(id_col).cast("long").eqNullSafe(F.col("doc_id__kept")) & (F.xxhash64(text_col) == F.col("key__kept"))
    shared = lambda df: F.broadcast(df) if df.count() <= FEW else df
    single = docs.join(shared(gone.union(repeated)), own, "left_anti")
    return single.unionByName(docs.join(shared(repeated), own, "left_semi").dropDuplicates([id_col, text_col]))


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle; a shorter text is one shingle, one without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, total = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    parts = (words[at : at + (1 << 16) + shingle - 1] for at in range(0, total, 1 << 16))
    return np.concatenate([np.array([digest(b" ".join(part[k : k + shingle]), SEED) for k in range(max(1, len(part) - shingle + 1))], np.uint64) for part in parts])


#: Bucket keys of the similarity join: bands of four minima each, beside the blocks of the fingerprint. Two texts at
#: similarity 0.8 share no band with a chance of (1 - 0.8**4)**20, about 1 in 38,000; more similar ones less.
BANDS, MINIMA = 20, 4
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * MINIMA, dtype=np.uint64, endpoint=False) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def bucket_keys(hashes: np.ndarray, distinct: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Keys under which similar texts meet; none without words. hashes: of all shingles; distinct: the same, each once."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    counts = np.zeros(64, np.int64)
    for k, column in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
        counts[8 * k : 8 * k + 8] += np.bincount(column, minlength=256) @ BITS_OF_BYTE
    fp = np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]
    bands = minima(distinct, FACTORS)
    keys = np.concatenate([fp & masks, bands])
    keys = (keys ^ (np.arange(1, len(keys) + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))) * MIX
    return keys ^ (keys >> np.uint64(32))


def similar_links(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the distinct sets of a bucket exactly as all pairs of ``similarity`` (Jaccard) or more do."""
    found, sizes = [], np.array([len(x) for x in sets])
    left, seen = np.arange(1, len(sets)), [0]
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    while len(left):
        at = seen.pop() if seen else None
        if at is None:
            at, left = left[0], left[1:]
        alive = np.zeros(len(sets), bool)
        alive[left] = True
        if alive[owner].sum() < len(owner):
            values, owner = values[alive[owner]], owner[alive[owner]]
        own = sets[at]
        place = np.minimum(np.searchsorted(own, values), len(own) - 1)
        both = np.bincount(owner[own[place] == values], minlength=len(sets))[left]
        near = both >= similarity * (sizes[left] + sizes[at] - both) - 1e-9
        found += [(int(nodes[k]), int(nodes[at])) for k in left[near]]
        seen += left[near].tolist()
        left = left[~near]
    return found


def whole_runs(batches, columns: int = 1):
    """Tables that hold whole runs of rows that agree in the first ``columns``; rows are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = [batch.column(k).to_numpy() for k in range(columns)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in x], axis=0))
        last = int(change[-1]) + 1 if len(change) else 0
        same = bool(held) and all(held[-1].column(k)[0].as_py() == x[k][0] for k in range(columns))
        if held and (last or not same):
            yield pa.Table.from_batches([*held, batch.slice(0, last)] if same else held).combine_chunks()
            held = []
            if not same and last:
                yield pa.Table.from_batches([batch.slice(0, last)])
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def minima(distinct: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Keys of bands of MINIMA least products with ``factors``, one after another."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), 2048):
        least = np.minimum(least, (factors[:, None] * distinct[None, at : at + 2048]).min(axis=1))
    bands = np.zeros(len(factors) // MINIMA, np.uint64)
    for column in least.reshape(-1, MINIMA).T:
        bands = (bands ^ column ^ (column >> np.uint64(29))) * MIX
    return bands


#: Distinct sets of a bucket that one task compares; of larger ones, sets that are compared with all others in a round.
CROWD, PIVOTS = 8192, 16


def crowd_links(crowds: DataFrame, sets: DataFrame, similarity: float, crowd: int = CROWD, pivots: int = PIVOTS) -> DataFrame:
    """Links (u, v) that join the sets of large buckets as all pairs of ``similarity`` or more do; no bucket meets in one task.

    crowds: (b, node); sets: (node, items). A round compares some sets of each bucket, its pivots, with all of the bucket,
    pair by pair. A set that is linked to a pivot needs no comparison with others that are; one that isn't, and is no pivot,
    is still open. Buckets with open sets are dealt out by further bands of minima, with all their sets: what comes below
    ``crowd`` is compared in a task, the rest goes into another round. Two texts at 0.8 part at a level with a chance of 1
    in 38,000, as in the bands before.
    """
    spark = crowds.sparkSession
    pair = "u long, v long"

    def compare(batches):
        for batch in batches:
            nodes, others = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                least, most = min(len(a), len(b)), max(len(a), len(b))
                if least < similarity * most - 1e-9:
                    near.append(False)
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            near = np.array(near, bool)
            yield pa.record_batch([pa.array(np.maximum(nodes, others)[near]), pa.array(np.minimum(nodes, others)[near])], names=["u", "v"])

    def bands(level: int):
        factors = np.random.default_rng([SEED, level]).integers(0, 1 << 64, BANDS * MINIMA, dtype=np.uint64, endpoint=False) | np.uint64(1)

        def run(batches):
            for batch in batches:
                made = [minima(np.frombuffer(x.as_buffer(), np.uint64), factors).view(np.int64) for x in batch.column(1)]
                yield pa.record_batch([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "bands"])

        return run

    found, level = [], 0
    state = cut(crowds.select("b", "node", F.lit(True).alias("open")))
    while not state.isEmpty():
        level += 1
        order = Window.partitionBy("b").orderBy(F.xxhash64("node"))
        chosen = cut(state.where("open").select("b", F.col("node").alias("pivot"), F.row_number().over(order).alias("n")).where(F.col("n") <= pivots).drop("n"))
        few = chosen.count() <= 100_000  # then they, and the distinct sets among them, are few enough to be sent to all
        shared = F.broadcast if few else lambda df: df
        pairs = state.join(shared(chosen), "b").where("node <> pivot").select("node", "pivot").distinct()
        held = pairs.join(sets, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64)).cast("int"))
        salted = sets.select(F.col("node").alias("pivot"), F.col("items").alias("other"), F.explode(F.array(*map(F.lit, range(64)))).alias("salt"))
        salted = salted.join(pairs.select("pivot").distinct(), "pivot", "left_semi")
        links = cut(held.join(salted, ["pivot", "salt"]).select("node", "pivot", "items", "other").mapInArrow(compare, pair).distinct())
        found.append(links)
        both = links.select(F.col("u").alias("pivot"), F.col("v").alias("node")).union(links.select("v", "u"))
        near = both.join(shared(chosen), "pivot").select("b", "node").distinct().withColumn("near", F.lit(True))
        tried = chosen.withColumnRenamed("pivot", "node").withColumn("tried", F.lit(True))
        state = state.join(near, ["b", "node"], "left").join(tried, ["b", "node"], "left")
        state = state.select("b", "node", (F.col("open") & F.col("near").isNull() & F.col("tried").isNull()).alias("open"))
        left = state.groupBy("b").agg(F.max("open").alias("some")).where("some").select("b")
        state = cut(state.join(left, "b", "left_semi"))
        if state.isEmpty():
            break
        dealt = state.join(sets.join(state.select("node").distinct(), "node", "left_semi").mapInArrow(bands(level), "node long, bands array<long>"), "node")
        dealt = dealt.select("node", "open", F.posexplode("bands").alias("k", "band"), "b").select(F.xxhash64("b", "k", "band").alias("b"), "node", "open")
        sizes = dealt.groupBy("b").agg(F.count("*").alias("n"), F.max("open").alias("some")).where("some and n > 1")
        dealt = cut(dealt.join(sizes, "b"))
        found.append(cut(bucket_pairs(dealt.where(F.col("n") <= crowd).select(F.col("b").alias("bucket"), "node"), sets, similarity)))
        state = dealt.where(F.col("n") > crowd).select("b", "node", "open")
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], pair)


def bucket_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) within buckets of bounded size; members: (bucket, node)."""

    def verify(batches):
        for rows in whole_runs(batches):
            bucket, node = (rows.column(k).to_numpy() for k in range(2))
            items, pairs = rows.column(2), []
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(bucket)], strict=True):
                pairs += similar_links(node[a:b], [np.frombuffer(items[int(k)].as_py(), np.uint64) for k in range(a, b)], similarity)
            yield pa.record_batch([pa.array([max(p) for p in pairs], pa.int64()), pa.array([min(p) for p in pairs], pa.int64())], names=["u", "v"])

    met = members.join(sets, "node").select("bucket", "node", "items").repartition("bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(verify, "u long, v long").distinct()


def one_of_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, seen: int = SEEN) -> DataFrame:
    """``docs`` with one row, of the least id, of each group of texts linked by ``similarity`` or more.

    Similarity is the Jaccard index of the sets of word shingles, computed in full for what shares a bucket: a choice of
    three of six blocks of the fingerprint, or a band of minima. Texts of equal sets are one node and always meet. Buckets
    of more than about ``crowd`` sets go to ``crowd_links``; one in ``seen`` sets is counted to find them, which decides
    where the work is done, not what is found.

    Defined results: null texts and texts without words have the same empty set and are one group; a text of fewer words than
    a shingle is one shingle; very long texts are read whole; of equal rows one stays; null ids come last; an empty table gives an
    empty result; other columns are kept and not looked at.
    """
    masks = np.array(block_masks(), np.int64).view(np.uint64)

    def mark(batches):
        for batch in batches:
            nodes, keys = [], []
            for t in batch.column(2):
                hashes = shingles(t.as_py(), shingle)
                distinct = np.unique(hashes)
                nodes.append(xxhash.xxh64_intdigest(distinct.tobytes(), SEED))
                keys.append(bucket_keys(hashes, distinct, masks).view(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "key", "node", "keys"])

    def meet(batches):
        for rows in whole_runs(batches):
            key, node = (rows.column(k).to_numpy() for k in range(2))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            some = np.flatnonzero(ends - starts > 1)
            yield pa.record_batch([pa.array([np.sort(node[starts[k] : ends[k]]) for k in some], pa.list_(pa.int64()))], names=["nodes"])

    def fill(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([np.unique(shingles(t.as_py(), shingle)).tobytes() for t in batch.column(1)], pa.binary())], names=["node", "items"])

    keyed = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("key"), "text")
    marked = cut(keyed.mapInArrow(mark, "doc_id long, key long, node long, keys array<long>"))
    of = lambda rows: rows.groupBy("node").agg(F.first("keys").alias("keys"), F.min("key").alias("key"))
    nodes, n = of(marked), marked.count()
    buckets = nodes.select(F.explode("keys").alias("b"), "node")
    crowds = None
    if n > crowd:
        sample = of(marked.where(F.pmod(F.xxhash64("node"), F.lit(seen)) == 0)).select(F.explode("keys").alias("b"))
        hot = cut(sample.groupBy("b").count().where(F.col("count") * seen > crowd).select("b"))
        if not hot.isEmpty():
            crowds = cut(buckets.join(hot, "b", "left_semi"))
            buckets = buckets.join(hot, "b", "left_anti")
    parts = parts_for(marked, 16 * (len(masks) + BANDS) * n, 64 << 20)
    met = cut(buckets.repartition(parts, "b").sortWithinPartitions("b").mapInArrow(meet, "nodes array<long>").distinct())
    members = met.select(F.xxhash64("nodes").alias("bucket"), F.explode("nodes").alias("node"))
    wanted = members.select("node") if crowds is None else members.select("node").union(crowds.select("node"))
    asked = nodes.select("node", "key").join(wanted.distinct(), "node", "left_semi").select("node", F.col("key").alias("key__asked"))
    asked = cut(asked)
    texts = keyed.join(F.broadcast(asked) if asked.count() <= FEW else asked, F.col("key") == F.col("key__asked")).select("node", "text").dropDuplicates(["node"])
    sets = cut(texts.mapInArrow(fill, "node long, items binary"))
    links = bucket_pairs(members, sets, similarity)
    if crowds is not None:
        links = links.union(crowd_links(crowds, sets, similarity, crowd)).distinct()
    roots = components(links)
    rooted = marked.select("doc_id", "key", "node").join(roots.withColumnRenamed("u", "node"), "node", "left")
    return kept_rows(docs, rooted.select("doc_id", "key", F.coalesce("root", "node").alias("root")), id_col, text_col)


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of ``groups``: that of the least id, then text hash; null ids come last. Rows of different groups stay apart, whatever their ids."""
    marked, rooted = rooted_prints(docs, shingle, max_bits, id_col, text_col)
    return kept_rows(docs, marked.join(rooted.select("fp", "root"), "fp").select("doc_id", "key", "root"), id_col, text_col)
