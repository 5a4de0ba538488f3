"""Incremental ingestion of documents into a vector store.

Every micro-batch is chunked and embedded and committed to a ``sources.store.Store`` under the stream's name and the
batch's number, so that a batch that is run again changes nothing: each document is ingested exactly once. A batch
replaces its documents; one whose text is null, or too short to have a chunk, leaves a mark that nothing of it is current.
Of several rows of a document in one batch the greatest ``version`` counts (the greatest content, if there is no such
column or it agrees; null the least). Several streams may write to one store, and others may add and delete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking as C
from ..operators import retrieval as R
from ..sources.store import MARK, Store


def prepared(documents: DataFrame, size: int = 500, overlap: int = 50, model=None) -> DataFrame:
    """Chunks with vectors of (doc_id, content[, version]), one version a document; one without chunks is kept as one row without content."""
    order = F.struct(*[F.col(c) for c in ("version",) if c in documents.columns], F.col("content"))
    docs = documents.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max_by("content", order).alias("content"))
    # an outer explode keeps documents without chunks
    chunks = docs.select("doc_id", F.posexplode_outer(C.fixed(F.col("content"), size, overlap)).alias("part_index", "content"))
    chunks = chunks.withColumn("part_index", F.coalesce(F.col("part_index") + 1, F.lit(1)))
    return R.embed(chunks, F.col("content"), model=model).select("doc_id", "part_index", "content", "embedding")


def start(stream: DataFrame, store: str, checkpoint: str, once: bool = True, name: str = "documents", **options) -> StreamingQuery:
    """stream: a streaming DataFrame of (doc_id, content). name: the stream's in the store; a checkpoint that begins anew needs a new one."""
    held = Store(stream.sparkSession, store)

    def write(batch: DataFrame, number: int) -> None:
        rows = prepared(batch, **options)
        held.replace(rows.withColumn(MARK, rows.content.isNull()), name=f"batch={number}", stream=name, batch=number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, store: str) -> DataFrame:
    """The store's rows: of each document those of its last batch, without deleted ones."""
    return Store(spark, store).read()


def compact(spark: SparkSession, store: str, keep: int = 1) -> None:
    """Leaves one folder of the current rows, named by the last batch; ``keep`` versions of the store stay readable."""
    held = Store(spark, store)
    folders = held.snapshot()[1]["folders"]
    if folders:
        held.compact(folders[-1]["path"].partition("/")[0])
        held.vacuum(keep)
