"""Near-duplicates by MinHash, with an inverted join over the coordinates of the signatures.

A text is the set of its distinct word shingles, by 64-bit hash. Its signature has ``COORDINATES`` minima. Every pair of
a coordinate and a value is an entry of an inverted index, and two texts are candidates if they share ``MATCHES``
entries or more. Three rules keep the index from being merged as a whole:

* prefix: entries are ordered from rare to frequent; two texts that share ``MATCHES`` entries share one of the first
  COORDINATES - MATCHES + 1 of each, so only these are posted. An entry that one text alone has takes its place in the
  order and is posted nowhere.
* skip: a text that shares fewer than ``MATCHES`` entries with all others together is never posted, and within a list
  the count of a pair ends as soon as ``MATCHES`` is out of its reach.
* lists of one membership are merged once; the members of a list longer than ``CROWD`` are candidates of one group as
  they are, which can only add candidates.

Candidates are links of candidate groups, and each group is decided on full sets: in one task where it is small, else by
``crowd_links``, in rounds over all tasks. No step forms all pairs of a group.

Two texts at similarity 0.8 share fewer than 36 of 64 entries with a chance of about 1 in 236,000, more similar ones with
less; every link that is reported has been confirmed on the full sets.

Defined results: null texts and texts without words have the empty set and are linked with nothing, not even with each
other; a text of fewer words than a shingle is one shingle; very long texts are read whole, a megabyte at a time; equal
rows share a group; a null id never names a group that has another id; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_dir, id_and_text, parts_for, slices
from .simhash import components, whole_runs

COORDINATES, MATCHES = 64, 36
#: Members of a list, and of a candidate group, that one task takes; and the bytes of a group's sets.
CROWD, CROWD_BYTES = 4096, 1 << 25
#: Sets of a crowd that are compared with all of it in the first round; each further round takes twice as many.
PIVOTS = 16
#: Rows of ids and numbers that are sent to all tasks; more of them are joined.
FEW = 300_000

RNG = np.random.default_rng(20240607)
odd = lambda n: RNG.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False) | np.uint64(1)
PLACES, FACTORS, MIX = odd(16), odd(COORDINATES), odd(1)[0]
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(text: str | None, each: int = 1 << 20) -> np.ndarray:
    """XXH64 of each word, ASCII letters in lower case, read ``each`` bytes at a time."""
    data, at, parts = (text or "").encode().lower(), 0, []
    while at < len(data):
        end = at + each
        if end < len(data):
            found = BLANK.search(data, end)
            end = found.start() if found else len(data)
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, data[at:end].split()), np.uint64))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(shingle, len(words))
    total = len(words) - size + 1
    sums = np.full(total, size, np.uint64) * MIX
    for k in range(size):
        sums += words[k : k + total] * PLACES[k % len(PLACES)] ** np.uint64(1 + k // len(PLACES))
    sums = (sums ^ (sums >> np.uint64(31))) * MIX
    return np.unique(sums ^ (sums >> np.uint64(29)))


def signature(items: np.ndarray) -> np.ndarray:
    """COORDINATES minima, as 32-bit values."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 2048):
        np.minimum(least, (FACTORS[:, None] * items[None, at : at + 2048]).min(axis=1), out=least)
    return ((least ^ (least >> np.uint64(30))) * MIX >> np.uint64(32)).astype(np.uint32)


def marked(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n, digest, sig): the text's hash, the size of its set, the set's digest of 128 bits and its signature, both null for the empty set."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            n, digests, sigs = [], [], []
            for text in batch.column(2):
                items = shingle_set(text.as_py(), shingle)
                n.append(len(items))
                digests.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                sigs.append(signature(items).tobytes() if len(items) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "key", "n", "digest", "sig"])

    keyed = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("key"), "text")
    return keyed.mapInArrow(run, "doc_id long, key long, n long, digest binary, sig binary")


def index_entries(nodes: DataFrame) -> DataFrame:
    """(node, entry): every coordinate with its value, as one number."""

    def run(batches):
        place = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            node = batch.column(0).to_numpy()
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            yield pa.record_batch([pa.array(np.repeat(node, COORDINATES)), pa.array((place + values).ravel())], names=["node", "entry"])

    return nodes.select("node", "sig").mapInArrow(run, "node long, entry long")


def postings(nodes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(entry, n, node): the entries of each node's prefix that other nodes have too; n: nodes with the entry."""
    entries = index_entries(nodes)
    shared = entries.groupBy("entry").agg(F.count("*").alias("n")).where("n > 1")
    own = entries.join(shared, "entry").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "entry"))).alias("e"))  # at most COORDINATES a node
    first = F.slice("e", F.lit(1), F.size("e") - matches + 1)
    return own.where(F.size("e") >= matches).select("node", F.explode(first).alias("e")).select("e.entry", "e.n", "node")


def matching(sigs: np.ndarray, own: np.ndarray, matches: int) -> np.ndarray:
    """Rows of ``sigs`` that share ``matches`` coordinates or more with ``own``; a row's count ends where that is out of reach."""
    alive, count, step = np.arange(len(sigs)), np.zeros(len(sigs), np.int64), 16
    for at in range(0, COORDINATES, step):
        count = count + (sigs[alive, at : at + step] == own[at : at + step]).sum(axis=1)
        fit = count + (COORDINATES - at - step) >= matches
        alive, count = alive[fit], count[fit]
    return alive


def list_links(nodes: np.ndarray, sigs: np.ndarray, matches: int) -> list[tuple[int, int]]:
    """Links that join a list's members exactly as all pairs of ``matches`` shared entries or more do."""
    found, left, front = [], np.arange(1, len(nodes)), [0]
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
        at = front.pop()
        near = np.zeros(len(left), bool)
        near[matching(sigs[left], sigs[at], matches)] = True
        found += [(int(nodes[k]), int(nodes[at])) for k in left[near]]
        front += left[near].tolist()
        left = left[~near]
    return found


PAIR = "u long, v long"


def pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([max(p) for p in pairs], pa.int64()), pa.array([min(p) for p in pairs], pa.int64())], names=["u", "v"])


def candidates(nodes: DataFrame, matches: int = MATCHES, crowd: int = CROWD) -> DataFrame:
    """(u, v), u > v: links that join at least all nodes that pairs of ``matches`` shared entries join."""
    posted = cut(postings(nodes, matches))
    size = posted.groupBy("entry").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1")
    long = size.where(F.col("size") > crowd)
    stars = posted.join(long, "entry").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    lists = posted.join(size.where(F.col("size") <= crowd).select("entry"), "entry").groupBy("entry").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    lists = lists.select("nodes").distinct().select(F.xxhash64("nodes").alias("list"), F.explode("nodes").alias("node"))

    def count(batches):
        for rows in whole_runs(batches):
            which, node, sig = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_pylist()
            starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
            pairs = []
            for a, b in zip(starts, np.r_[starts[1:], len(which)], strict=True):
                pairs += list_links(node[a:b], np.frombuffer(b"".join(sig[a:b]), np.uint32).reshape(-1, COORDINATES), matches)
            yield pair_batch(pairs)

    met = lists.join(nodes.select("node", "sig"), "node").select("list", "node", "sig").repartition("list").sortWithinPartitions("list")
    return met.mapInArrow(count, PAIR).union(stars).distinct()


def similar(a: int, b: int, both, percent: int):
    """Whether sets of a and b elements, ``both`` of them shared, have a similarity of ``percent`` or more."""
    return 100 * both >= percent * (a + b - both)


def shared_counts(own: np.ndarray, values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Elements that sorted ``own`` has in common with each of n sets, whose elements are ``values`` of ``owner``."""
    place = np.minimum(np.searchsorted(own, values), len(own) - 1)
    return np.bincount(owner[own[place] == values], minlength=n)


def set_links(nodes: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], percent: int, matches: int) -> list[tuple[int, int]]:
    """Links that join a group's nodes as all pairs of ``matches`` entries and ``percent`` similarity do, the node that agrees most with all first."""
    sizes = np.array([len(x) for x in sets])
    central = np.zeros(len(nodes), np.int64)
    for column in sigs.T:
        _, which, n = np.unique(column, return_inverse=True, return_counts=True)
        central += n[which]
    order = np.argsort(-central, kind="stable")
    found, left, front = [], order[1:], [int(order[0])]
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
        at = front.pop(0)
        tried = matching(sigs[left], sigs[at], matches)
        if not len(tried):
            continue
        some = left[tried]
        both = shared_counts(sets[at], np.concatenate([sets[k] for k in some]), np.repeat(np.arange(len(some)), sizes[some]), len(some))
        near = np.zeros(len(left), bool)
        near[tried] = similar(sizes[some], sizes[at], both, percent)
        found += [(int(nodes[k]), int(nodes[at])) for k in left[near]]
        front += left[near].tolist()
        left = left[~near]
    return found


def group_links(grouped: DataFrame, sets: DataFrame, percent: int, matches: int = MATCHES) -> DataFrame:
    """Links within groups of bounded size; grouped: (g, node), sets: (node, sig, items)."""

    def decide(batches):
        for rows in whole_runs(batches):
            which, node, sig, items = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2), rows.column(3)
            starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(which)], strict=True):
                a, b = int(a), int(b)
                own = [np.frombuffer(x.as_buffer(), np.uint64) for x in items.slice(a, b - a)]
                yield pair_batch(set_links(node[a:b], np.frombuffer(b"".join(sig.slice(a, b - a).to_pylist()), np.uint32).reshape(-1, COORDINATES), own, percent, matches))

    met = grouped.join(sets, "node").select("g", "node", "sig", "items").repartition("g").sortWithinPartitions("g")
    return met.mapInArrow(decide, PAIR)


def central_first(crowds: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, node, agrees): how many of a node's entries are the most frequent of their coordinate in its group."""
    entries = index_entries(nodes.join(crowds.select("node"), "node", "left_semi")).join(crowds, "node")
    counted = entries.groupBy("g", "entry").agg(F.count("*").alias("n"))
    top = counted.groupBy("g", F.shiftright("entry", 32)).agg(F.max(F.struct("n", "entry")).alias("top")).select("g", F.col("top.entry").alias("entry"))
    return entries.join(F.broadcast(top) if top.count() <= FEW else top, ["g", "entry"]).groupBy("g", "node").agg(F.count("*").alias("agrees"))


def compared(crowds: DataFrame, chosen: DataFrame, sets: DataFrame, percent: int, near: int, held_bytes: int = 1 << 22, cell_nodes: int = 1024, cell_bytes: int = 1 << 23) -> DataFrame:
    """(node, linked, close): for each node of a crowd (g, node) one pivot of ``chosen`` (g, pivot) at ``percent`` or more, and all at ``near`` or more below that; further rows name pivots that a node links.

    A group is dealt to cells of bounded size, and its pivots, in parts of bounded size, to each of them; a cell reads the
    pivots of one part first and then compares its nodes one by one.
    """
    sized = crowds.join(sets.select("node", F.length("items").cast("long").alias("bytes")), "node")
    cells = sized.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / cell_nodes), F.ceil(F.sum("bytes") / cell_bytes)).cast("int").alias("cells"))
    own = chosen.join(sets.select(F.col("node").alias("pivot"), "items"), "pivot")
    room = F.sum(F.length("items").cast("long")).over(Window.partitionBy("g").orderBy("pivot"))
    own = own.select("g", "pivot", F.floor(room / held_bytes).cast("int").alias("part"), "items")
    parts = own.groupBy("g").agg(F.collect_set("part").alias("parts")).join(cells, "g")  # one row a large group
    first = own.join(cells, "g").select("g", "part", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(0).alias("kind"), F.col("pivot").alias("node"), "items")
    later = crowds.join(F.broadcast(parts) if parts.count() <= FEW else parts, "g").join(sets.select("node", "items"), "node")
    later = later.select("g", F.explode("parts").alias("part"), F.pmod(F.xxhash64("node"), F.col("cells")).cast("int").alias("cell"), F.lit(1).alias("kind"), "node", "items")

    def run(batches):
        key, names, values, owner, sizes, linked = None, [], [], None, None, set()
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            rows = []
            for *now, kind, node, items in zip(*[batch.column(k).to_pylist() for k in range(5)], batch.column(5), strict=True):
                if now != key:
                    key, names, values, owner = now, [], [], None
                    linked.clear()
                mine = np.frombuffer(items.as_buffer(), np.uint64)
                if not kind:
                    names.append(node)
                    values.append(mine.copy())
                    continue
                if owner is None:
                    ids, sizes = np.array(names), np.array([len(x) for x in values])
                    values, owner = np.concatenate(values), np.repeat(np.arange(len(names)), sizes)
                both = shared_counts(mine, values, owner, len(ids))
                like, other = similar(sizes, len(mine), both, percent), ids != node
                linking, close = ids[like & other], ids[similar(sizes, len(mine), both, near) & ~like & other]
                if len(linking) or len(close):
                    rows.append((node, int(linking[0]) if len(linking) else None, close.tolist()))
                more = {(int(linking[0]), int(x)) for x in linking[1:]} - linked
                rows += [(a, b, []) for a, b in more]
                linked |= more
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["node", "linked", "close"])

    dealt = first.union(later).repartition("g", "part", "cell").sortWithinPartitions("g", "part", "cell", "kind")
    return dealt.mapInArrow(run, "node long, linked long, close array<long>")


def crowd_links(crowds: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, pivots: int = PIVOTS) -> DataFrame:
    """Links that join the nodes of large groups as all pairs of ``percent`` similarity or more do; no group meets in one task.

    A round compares some nodes of each group, its pivots, with all of the group, on full sets. Distance 1 - similarity is a
    metric: if x is linked to pivot p, and y to x but not to p, then y's similarity to p is at least 2 * limit - 1. So once
    every node either is a pivot or is linked to one, and no node is that near to a pivot of another component, no link
    between two components is left. Until then the nodes that break this rule are the next pivots, those that agree most
    with their group first, twice as many a round.
    """
    near, spark = 2 * percent - 100, crowds.sparkSession
    central = crowds.join(central_first(crowds, nodes), ["g", "node"], "left").select("g", "node", F.coalesce("agrees", F.lit(0)).alias("agrees"))
    needed, done, links = cut(central), None, []
    while not needed.isEmpty():
        order = Window.partitionBy("g").orderBy(F.desc("agrees"), "node")
        chosen = cut(needed.withColumn("k", F.row_number().over(order)).where(F.col("k") <= pivots).select("g", F.col("node").alias("pivot")))
        pivots *= 2
        done = chosen if done is None else cut(done.union(chosen))
        links.append(cut(compared(crowds, chosen, sets, percent, near)))
        told = reduce(DataFrame.unionByName, links)
        edges = told.where("linked IS NOT NULL").select(F.greatest("node", "linked").alias("u"), F.least("node", "linked").alias("v")).distinct()
        roots = components(edges)
        of = lambda df, name: df.join(roots.select(F.col("u").alias(name), F.col("root").alias(f"{name}__root")), name, "left").withColumn(f"{name}__root", F.coalesce(f"{name}__root", name))
        apart = of(of(told.select("node", F.explode("close").alias("by")), "node"), "by").where("node__root <> by__root").select("node")
        free = central.join(told.where("linked IS NOT NULL").select("node"), "node", "left_anti").select("node")
        open_ = apart.union(free).distinct()
        needed = cut(central.join(open_, "node", "left_semi").join(done.select(F.col("pivot").alias("node")), "node", "left_anti"))
    return edges if links else spark.createDataFrame([], PAIR)


def groups(docs: DataFrame, shingle: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", matches: int = MATCHES, crowd: int = CROWD, crowd_bytes: int = CROWD_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the size of the set of word shingles, the least id of the texts that links of ``percent`` similarity or more reach, and whether it is the row's own."""
    spark = docs.sparkSession
    rows = marked(docs, shingle, id_col, text_col)
    rows.write.parquet(at := fresh_dir(spark, "minhash"))
    rows = spark.read.parquet(at)
    nodes = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("rows"))
    nodes.withColumn("node", F.monotonically_increasing_id()).write.parquet(at := fresh_dir(spark, "minhash"))
    nodes = spark.read.parquet(at)
    links = confirmed(docs, nodes, candidates(nodes, matches, crowd), shingle, percent, text_col, matches, crowd, crowd_bytes)
    roots = components(links).withColumnRenamed("u", "node")
    member = cut(nodes.select("node", "digest", "first_id", "rows").join(roots, "node", "left").withColumn("linked", F.col("root").isNotNull() | (F.col("rows") > 1)).withColumn("root", F.coalesce("root", "node")))
    # a text that nothing is linked with names itself
    least = member.groupBy("root").agg(F.min("first_id").alias("component_id"), F.max("linked").alias("linked")).where("linked").select("root", "component_id")
    member = cut(member.select("digest", "root").join(least, "root").select("digest", "component_id"))
    found = rows.select("doc_id", "n", "digest").join(F.broadcast(member) if member.count() <= FEW else member, "digest", "left")
    component = F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def confirmed(docs: DataFrame, nodes: DataFrame, links: DataFrame, shingle: int, percent: int, text_col: str, matches: int, crowd: int, crowd_bytes: int) -> DataFrame:
    """Links (u, v) of full sets within the groups that candidate ``links`` form."""
    spark = docs.sparkSession
    roots = components(links)
    grouped = cut(roots.select(F.col("u").alias("node"), F.col("root").alias("g")).union(roots.select("root", "root")).distinct().join(nodes.select("node", "n", "key"), "node"))

    def fill(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(2)], pa.binary())], names=["node", "sig", "items"])

    asked = grouped.select("node", F.col("key").alias("key__asked"))
    asked = F.broadcast(asked) if asked.count() <= FEW else asked
    texts = docs.select(F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text")).join(asked, F.col("key") == F.col("key__asked")).select("node", "text")
    texts = texts.dropDuplicates(["node"]).join(nodes.select("node", "sig"), "node").select("node", "sig", "text")
    texts.mapInArrow(fill, "node long, sig binary, items binary").write.parquet(at := fresh_dir(spark, "minhash"))
    sets = spark.read.parquet(at)
    sizes = grouped.groupBy("g").agg(F.count("*").alias("size"), F.sum(8 * F.col("n")).alias("bytes"))
    large = cut(sizes.where((F.col("size") > crowd) | (F.col("bytes") > crowd_bytes)).select("g"))
    small = group_links(grouped.join(large, "g", "left_anti").select("g", "node"), sets, percent, matches)
    if large.isEmpty():
        return small
    crowds = cut(grouped.join(large, "g", "left_semi").select("g", "node"))
    return small.union(crowd_links(crowds, nodes, sets, percent))


def one_of_each(docs: DataFrame, shingle: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id) of the documents that stay: one of each group, and all without words."""
    return groups(docs, shingle, percent, id_col, text_col, **options).where("kept").select("doc_id").distinct()
