"""Token ids in seekable binary files.

Documents are dealt to files by ranges of their id and written in ascending order. A file holds

    frames       independent zstandard frames of little-endian unsigned 32-bit ids, whole documents of about ``frame_ids`` ids
    index frame  a skippable frame: zstandard-compressed (id, frame, offset, count) of each document, as signed 64-bit columns
    seek table   a skippable frame: per frame its compressed and raw size and the CRC-32 of its raw bytes, then their
                 number, a flag byte and the magic number 0x8F92EAB1

so that a reader opens the table at the end, the index before it, and then only the frames of the documents asked for.
Each file is written under a temporary name and renamed, so that a task that runs twice leaves one file.

Defined results: a null text is encoded as empty and so has the end id alone; null ids come first; rows of one id are in
the order of the hash of their text; very long texts are one document of one frame; an empty table makes no file; other
columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_dir, parts_for, slices

FRAME_IDS = 1 << 18
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
NULL_ID = -(1 << 63)
#: A space between white space, or at the end; all that any engine counts as white space.
JOINED = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}] [\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]| \z"


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return (pyarrow.fs.LocalFileSystem(), uri) if uri.startswith("/") else pyarrow.fs.FileSystem.from_uri(uri)


def stitches(described: str) -> bool:
    """Whether a tokenizer, as its JSON describes it, gives a text's ids by its stretches: byte-level pieces by the usual pattern, without anything before or after, and no added token that holds white space."""
    made = json.loads(described)
    split = made.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    model = made.get("model") or {}
    whole = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    added = all(not re.search(r"\s", t["content"]) and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in made.get("added_tokens") or [])
    return bool(plain and whole and added and not made.get("normalizer") and not made.get("truncation") and not made.get("padding"))


def spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin ... begin + size - 1 of all spans, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Token ids of whole texts; remembers the ids of stretches between single spaces.

    That is done for tokenizers of the kind ``stitches`` knows; any other one is given the whole texts.

    The usual pattern of a byte-level BPE never joins characters across a space, unless white space stands on both sides
    of it or it ends the text; such texts are encoded in one piece. Any other text is the sequence of its first stretch
    and of each later stretch with its space. Texts are split and their distinct stretches found in Arrow; only stretches
    that are new reach the tokenizer, many at once, and the tokens that begin with a space tell them apart again. Ids are
    then gathered from one pool of all known stretches.
    """

    def __init__(self, path: str, remember: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remember, self.stitched = remember, stitches(self.tokenizer.to_str())
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.opens = np.array([(self.tokenizer.id_to_token(k) or "").startswith("\u0120") for k in range(size)])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int32)

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word after a space, one after another, and their numbers. Words that begin or end with white space are encoded one by one."""
        sizes = np.zeros(len(words), np.int64)
        plain = np.array([bool(w) and len(w.strip()) == len(w) for w in words], bool)
        odd = np.flatnonzero(~plain).tolist()
        plain = np.flatnonzero(plain)
        order, found = [], []
        for at in range(0, len(plain), 2000):
            places = plain[at : at + 2000]
            part = [words[k] for k in places] if odd else words[at : at + 2000]
            ids = np.concatenate(self.direct([" " + " ".join(part[k : k + 100]) for k in range(0, len(part), 100)]))
            edges = np.flatnonzero(self.opens[ids])
            if len(edges) == len(part) and edges[0] == 0:
                sizes[places] = np.diff(edges, append=len(ids))
                order.append(places)
                found.append(ids)
            else:
                odd += places.tolist()
        if odd:
            alone = self.direct([" " + words[k] for k in odd])
            sizes[odd] = [len(x) for x in alone]
            order.append(np.array(odd))
            found += alone
        ids = np.concatenate([np.zeros(0, "<u4"), *found])
        if len(odd):  # back into the order of the words
            order = np.concatenate(order)
            begins = np.zeros(len(words), np.int64)
            begins[order] = np.cumsum(sizes[order]) - sizes[order]
            ids = ids[spans(begins, sizes)]
        return ids, sizes

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; none of the texts is null."""
        if not self.stitched:
            return self.direct(texts.to_pylist())
        joined = np.array(pc.match_substring_regex(texts, JOINED))
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        for k in np.flatnonzero(joined):
            out[k] = self.direct([texts[int(k)].as_py()])[0]
        rest = np.flatnonzero(~joined)
        if len(rest):
            for k, ids in zip(rest, self.split_and_encode(texts.take(pa.array(rest))), strict=True):
                out[k] = ids
        return out

    def split_and_encode(self, texts: pa.Array) -> list[np.ndarray]:
        split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy() - split.offsets[0].as_py()
        flat = split.flatten()
        coded = flat.dictionary_encode()
        piece = coded.indices.to_numpy()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        if len(self.known) > self.remember:
            self.forget()
        numbers = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(numbers < 0)
        # what comes once is encoded, but not remembered: it would seldom be asked for again
        often = np.bincount(piece, minlength=len(words))[new] > 1
        new, rare = new[often], new[~often]
        for places in (new, rare):
            numbers[places] = len(self.known) + np.arange(len(places))
            if places is new:
                ids, sizes = self.spelled(words[new].tolist())
                self.known.update(zip(words[new].tolist(), numbers[new].tolist(), strict=True))
                self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes.astype(np.int32)])
        ids, sizes = self.spelled(words[rare].tolist())
        heads = self.direct(flat.take(pa.array(starts[:-1])).to_pylist())  # without a space before them
        sizes = np.concatenate([self.sizes, sizes, [len(x) for x in heads]]).astype(np.int64)
        pool = np.concatenate([self.ids, ids, *heads])
        begins = np.cumsum(sizes) - sizes
        piece = numbers[piece]
        piece[starts[:-1]] = len(self.known) + len(rare) + np.arange(len(heads))
        n = sizes[piece]
        return np.split(pool[spans(begins[piece], n)], np.cumsum(n)[starts[1:] - 1][:-1])


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each worker process, which serves many tasks."""
    return Encoder(path)


class Writer:
    def __init__(self, sink, frame_ids: int = FRAME_IDS):
        self.frame_ids = frame_ids
        self.sink, self.table, self.index, self.held, self.n_held = sink, [], [], [], 0
        self.pack = zstandard.ZstdCompressor(level=3, write_content_size=True)

    def add(self, doc_id: int, ids: bytes) -> None:
        self.index.append((doc_id, len(self.table), self.n_held, len(ids) // 4))
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.frame_ids:
            self.flush()

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.pack.compress(raw)
            self.sink.write(packed)
            self.table.append((len(packed), len(raw), zlib.crc32(raw)))
            self.held, self.n_held = [], 0

    def close(self) -> None:
        self.flush()
        index = self.pack.compress(np.array(self.index, "<i8").reshape(-1, 4).T.tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Reads single documents of a file."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        n, flag, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE or flag != 0x80:
            raise ValueError(f"{uri}: no seek table")
        table = np.frombuffer(self.file.read_at(12 * n, end - 9 - 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.raw, self.sums = table[:, 0].astype(np.int64), table[:, 1], table[:, 2]
        self.starts = np.cumsum(self.sizes) - self.sizes
        at = int(self.sizes.sum())
        _, size = struct.unpack("<II", self.file.read_at(8, at))
        self.unpack = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.unpack.decompress(self.file.read_at(size, at + 8)), "<i8").reshape(4, -1)
        self.frame: tuple[int, bytes] = (-1, b"")

    def read_frame(self, k: int) -> bytes:
        if self.frame[0] != k:
            raw = self.unpack.decompress(self.file.read_at(int(self.sizes[k]), int(self.starts[k])), max_output_size=int(self.raw[k]))
            if zlib.crc32(raw) != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.frame = (k, raw)
        return self.frame[1]

    def ids(self, place: int) -> bytes:
        """The ids of the document at this place of the index."""
        _, frame, offset, n = (int(x) for x in self.index[:, place])
        return self.read_frame(frame)[4 * offset : 4 * (offset + n)]

    def document(self, doc_id: int) -> list[np.ndarray]:
        return [np.frombuffer(self.ids(int(k)), "<u4") for k in np.flatnonzero(self.index[0] == doc_id)]


def settle(fs: pyarrow.fs.FileSystem, draft: str, path: str) -> None:
    """Gives a complete file its name. Where a file system refuses to replace one, an earlier run of the task left the same bytes under it."""
    try:
        fs.move(draft, path)
    except OSError:
        if fs.get_file_info(path).type != pyarrow.fs.FileType.File:
            raise
        fs.delete_file(draft)


def clear_drafts(folder: str) -> None:
    """Deletes what tasks that were lost have left unfinished."""
    fs, at = opened(folder)
    for x in fs.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True)):
        if x.path.endswith(".draft"):
            fs.delete_file(x.path)


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, to: str | None = None, frame_ids: int = FRAME_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns (part, path, n_docs, n_tokens), in order of the ids by part; ``to`` is a shared folder."""
    spark = docs.sparkSession
    to = to or fresh_dir(spark, "tokens")
    end = struct.pack("<I", end_id)

    def run(batches):
        part = TaskContext.get().partitionId()
        name, writer, n_docs, n_tokens = f"{to}/part-{part:06d}.tok", None, 0, 0
        for batch in batches:
            for rows in slices(batch):
                if writer is None:
                    fs, path = opened(name)
                    fs.create_dir(os.path.dirname(path), recursive=True)
                    draft = f"{path}.{TaskContext.get().taskAttemptId()}.draft"
                    sink = fs.open_output_stream(draft)
                    writer = Writer(sink, frame_ids)
                for doc_id, ids in zip(rows.column(0).to_pylist(), encoder(tokenizer).encode(pc.fill_null(rows.column(1), "")), strict=True):
                    writer.add(NULL_ID if doc_id is None else doc_id, ids.tobytes() + end)
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) + 1
        if writer is not None:
            writer.close()
            sink.close()
            settle(fs, draft, path)
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = slim.repartitionByRange(parts_for(slim), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    files = cut(dealt.mapInArrow(run, "part int, path string, n_docs long, n_tokens long"))
    clear_drafts(to)
    return files


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; files: what write() returned."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(path)
                counts = reader.index[3]
                sums = np.array([zlib.crc32(reader.ids(k)) for k in range(len(counts))], np.int64)
                doc_ids = pa.array(reader.index[0], mask=reader.index[0] == NULL_ID)
                yield pa.record_batch([doc_ids, pa.array(start + np.cumsum(counts) - counts), pa.array(counts), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # one row a file
    placed = files.withColumn("start", F.sum("n_tokens").over(before) - F.col("n_tokens")).select("path", "start")
    spread = placed.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
