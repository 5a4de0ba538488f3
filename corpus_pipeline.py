"""A corpus pipeline of five stages; each takes the documents that its predecessor kept.

run(spark, sf_dir) applies them to ``documents``: toxic documents go, one document of each near-duplicate group stays,
benchmark passages are cut out, sources are mixed to their target weights, and token files are written and read back.
All stages but the last keep the columns of documents. Nulls, empty texts and rows without ids are documents as any other;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontamination, mixing, queries, simhash, token_files, toxicity
from docloom.llm.common import fresh_dir, remove, table

#: The model, the graph and the tokenizer can't be stated in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3, by a model of the labels that may be learnt from; all of them where these labels are of one kind only."""
    return toxicity.clean_documents(docs, toxicity.train(docs, queries.learnable(table(spark, sf_dir, "labels"))))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least id, of each group of texts linked by a similarity of 0.8 or more over shingles of five words."""
    return simhash.one_of_similar(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of ten words of a benchmark item, or without a whole shorter item; documents that are benchmark for more than four fifths go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, the one at its edge cut to the word; those with nothing taken go."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    return token_files.read(token_files.write(docs, queries.tokenizer_path()))


STAGES = [("toxicity", without_toxic), ("simhash near-dedup", without_copies), ("benchmark decontamination", without_benchmarks), ("mixing sources", mixed), ("token files", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's output is deleted once the next one's is written; the token files stay."""
    docs, read = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out.write.parquet(path := fresh_dir(spark, "stage"))
            out = spark.read.parquet(path)
            if read:
                remove(spark, read)
            read = path
        docs = out
    if read:
        remove(spark, read)  # the token files are written by now
    return docs
