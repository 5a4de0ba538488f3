"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of 4, 6 and 8 characters (code points) of the lower-case text, white space as spaces. From at
most ``max_rows`` labelled documents (the bound is a parameter; which ones, a hash of the id decides) every feature's
log-count ratio is estimated from document counts. The ``n_features`` with the most evidence are kept, and a logistic
model is fitted on log(1 + count) times the ratio. Scoring is one table look-up per n-gram of the whole text, so it needs
neither a shuffle nor a vocabulary.

Defined results: null and empty texts get the model's score of no features; very long texts are read whole, a window at a
time; without labels of both kinds the score is the smoothed share of toxic labels, and ``clean_documents`` keeps every
document, as nothing tells them apart; of several labels of a document the highest counts, null labels don't; rows of a
labelled id all count, also if they agree; ids without a text are ignored; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, slices

SIZES, BITS, EDGE, WINDOW = (4, 6, 8), 20, 8, 1 << 18
BLOCK = 1000
#: Fixed odd factors of the hashes.
STEP, MIX = 0x9E3779B1, (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


def ngrams(points: np.ndarray) -> np.ndarray:
    """Hashed n-grams of 4, 6 and 8 characters at each position: 3 x (len - 7), each below 3 * 2**BITS. A gram's hash is its polynomial in STEP, mixed by its size's factor."""
    power = lambda k: np.uint32(pow(STEP, k, 1 << 32))
    p = points.astype(np.uint32)
    two = p[:-1] * power(1) + p[1:]
    four = two[:-2] * power(2) + two[2:]
    n = len(p) - 7
    six = four[:n] * power(2) + two[4 : n + 4]
    eight = four[:n] * power(4) + four[4 : n + 4]
    found = []
    for k, (x, factor) in enumerate(zip((four[:n], six, eight), MIX, strict=True)):
        x = (x ^ (x >> np.uint32(15))) * np.uint32(factor)
        found.append((x >> np.uint32(32 - BITS)) + np.uint32(k << BITS))
    return np.stack(found)


def pieces(texts: list[str | None]):
    """(first document, ends of documents, features) over all n-grams of the texts, a bounded window at a time.

    A document's n-grams are those that begin up to EDGE characters before or after it; zeros stand on either side, so none
    holds a character of another document.
    """
    edge = "\0" * EDGE
    for first, group in batched(texts):
        coded = [(t or "").lower() for t in group]
        ends = np.cumsum([len(x) + 2 * EDGE for x in coded])
        data = np.frombuffer((edge + (2 * edge).join(coded) + 2 * edge).encode("utf-32-le", "surrogatepass"), "<u4")[:-1]
        data = np.where((data >= 9) & (data <= 13), np.uint32(32), data)
        for at in range(0, len(data) - 7, WINDOW):
            yield first, ends - at, ngrams(data[at : at + WINDOW + 7])


def batched(texts, most: int = WINDOW):
    first, group, total = 0, [], 0
    for k, t in enumerate(texts):
        group.append(t)
        total += len(t or "")
        if total >= most:
            yield first, group
            first, group, total = k + 1, [], 0
    if group:
        yield first, group


@dataclass
class Model:
    table: np.ndarray  # feature -> 1 + its place among the kept, or 0
    weights: np.ndarray
    bias: float

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, kept features and their counts, a row a text."""
        most, found, times = len(self.weights) + 1, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, ends, grams in pieces(texts):  # counted window by window: few features differ where many positions hit
            kept = self.table[grams]
            _, at = hit = np.nonzero(kept)
            keys, n = np.unique((first + np.searchsorted(ends, at, side="right")) * most + kept[hit], return_counts=True)
            found.append(keys)
            times.append(n)
        keys, place = np.unique(np.concatenate(found), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate(times), minlength=len(keys)).astype(np.int64)
        return keys // most, keys % most - 1, n

    def score(self, texts: list[str | None]) -> np.ndarray:
        row, feature, n = self.counts(texts)
        z = self.bias + np.bincount(row, weights=np.log1p(n) * self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def document_counts(rows: Iterable[tuple[str | None, int]]) -> np.ndarray:
    """2 x features: in how many clean and toxic documents each occurs."""
    counts = np.zeros((2, len(SIZES) << BITS), np.int32)
    for text, toxic in rows:
        seen: list[np.ndarray] = []
        for _, _, grams in pieces([text]):
            seen.append(np.unique(grams))
        for x in [np.unique(np.concatenate(seen))] if seen else []:
            counts[toxic, x] += 1
    return counts


def fit_logistic(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], n_features: int, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam; deterministic. blocks: (label of each row, its number of entries, feature and value of each entry) of some rows each, so that what a step makes stays small."""
    n, positive = sum(len(x[0]) for x in blocks), sum(float(x[0].sum()) for x in blocks)
    w, b = np.zeros(n_features), float(np.log((positive + 1) / (n - positive + 1)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for k in range(1, rounds + 1):
        g = np.append(l2 * w, 0.0)
        for y, sizes, feature, value in blocks:
            row = np.repeat(np.arange(len(y)), sizes)
            p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, weights=value * w[feature], minlength=len(y)), -40, 40)))
            miss = (p - y) / n
            g[:-1] += np.bincount(feature, weights=value * miss[row], minlength=n_features)
            g[-1] += miss.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, n_features: int = 8192, min_count: int = 4, alpha: float = 0.5, l2: float = 1e-3, rounds: int = 200, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """labels: (id, toxic), already restricted to the rows to learn from.

    The driver holds the counts of 3 * 2**BITS features and, of ``max_rows`` rows, the entries of kept features, six bytes each.
    """
    chosen = labels.where("toxic is not null").groupBy(F.col(id_col).alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)  # bounded, so it may be broadcast
    sample = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "toxic")
    tasks = min(64, max(8, docs.sparkSession.sparkContext.defaultParallelism))  # the sample is bounded, and each task gives one vector
    sample = cut(sample.select("text", "toxic").repartition(tasks))

    def rows(batches):
        for batch in batches:
            for part in slices(batch, 0):
                yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)

    def count(batches):
        counts = document_counts((t, int(y > 0)) for t, y in rows(batches))
        yield pa.record_batch([pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["counts"])

    total = np.zeros((2, len(SIZES) << BITS), np.int32)
    for x in cut(sample.mapInArrow(count, "counts binary")).toLocalIterator():  # one compressed vector a task, one at a time
        total += np.frombuffer(zlib.decompress(x[0]), np.int32).reshape(2, -1)
    share = {int(r[0] > 0): r[1] for r in sample.groupBy("toxic").count().collect()}
    clean, toxic = share.get(0, 0), share.get(1, 0)
    table = np.zeros(len(SIZES) << BITS, np.uint16)
    if n_features >= 1 << 16:
        raise ValueError("n_features must be below 65,536")
    if not clean or not toxic:
        return Model(table, np.zeros(0), float(np.log((toxic + 1) / (clean + 1))))
    often = np.flatnonzero(total.sum(axis=0) >= min_count)
    total = total[:, often]
    ratio = np.log((total[1] + alpha) / (toxic + 2 * alpha)) - np.log((total[0] + alpha) / (clean + 2 * alpha))
    evidence = np.abs(ratio) * np.sqrt(total.sum(axis=0))
    best = np.argsort(-evidence, kind="stable")[:n_features]
    best = best[evidence[best] > 0]
    table[often[best]] = np.arange(1, len(best) + 1)
    ratio = ratio[best]
    del total, evidence
    model = Model(table, ratio, 0.0)

    def present(batches):
        for batch in batches:
            for part in slices(batch, 0):
                row, feature, n = model.counts(part.column(0).to_pylist())
                toxic = np.array(part.column(1).to_pylist(), dtype=np.int64)
                edges = np.searchsorted(row, np.arange(len(toxic) + 1)).tolist()
                packed = [[x[a:b].astype(kind).tobytes() for a, b in zip(edges, edges[1:], strict=False)] for x, kind in ((feature, np.uint16), (n, np.int32))]
                yield pa.record_batch([pa.array(toxic > 0), *[pa.array(x, pa.binary()) for x in packed]], names=["toxic", "feature", "n"])

    blocks, held = [], []
    for r in cut(sample.mapInArrow(present, "toxic boolean, feature binary, n binary")).toLocalIterator():  # max_rows at most
        held.append(r)
        if len(held) == BLOCK:
            blocks.append(block_of(held, ratio))
            held = []
    if held:
        blocks.append(block_of(held, ratio))
    w, b = fit_logistic(blocks, len(ratio), l2, rounds)
    return Model(table, w * ratio, b)


def block_of(rows: list, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    feature, n = (np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in (("feature", np.uint16), ("n", np.int32)))
    sizes = np.array([len(r.n) // 4 for r in rows])
    return np.array([float(r.toxic) for r in rows]), sizes, feature, (np.log1p(n) * ratio[feature]).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: the table and n_features weights

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column(0), pa.array(shared.value.score(part.column(1).to_pylist()))], names=["doc_id", "score"])

    found = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean_documents(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; their texts aren't shuffled. A model that saw labels of one kind only, or none, rejects nothing."""
    if not len(model.weights):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(shared.value.score(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
