"""What the operators of this subpackage share: shared storage, lineage cuts and text batches."""

from __future__ import annotations

import ctypes
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, fresh_dir, remove, shared_dir, size_of

__all__ = ["SPACE", "cut", "fresh_dir", "id_and_text", "parts_for", "remove", "shared_dir", "size_of", "slices", "table"]

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"\x20\x09-\x0D"


def parts_for(df: DataFrame, size: int | None = None, each: int = 128 << 20) -> int:
    """Partitions for ``size`` bytes at ``each`` bytes, but no fewer than spark.sql.shuffle.partitions. Without ``size``, that of the files below ``df``; tables whose size Spark doesn't know don't count."""
    size = size_of(df) if size is None else size
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / each))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under names of its own: other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


@lru_cache(1)
def c_library():
    """The C library, where it can give memory back (glibc); else None."""
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


def release() -> None:
    """Gives memory that is free in this process back to the system: workers serve many tasks, and keep what the largest one took."""
    pa.default_memory_pool().release_unused()
    if (library := c_library()) is not None:
        library.malloc_trim(0)


def slices(batch: pa.RecordBatch, text: int = 1, most: int = 1 << 22):
    """Parts of a batch of at most about ``most`` bytes of column ``text``, so that what is made of them stays small. After a large batch, free memory is given back."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
    if batch.num_rows and sizes.sum() > most:
        release()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
