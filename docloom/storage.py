"""Where intermediate results lie: the folder that driver and executors share, lineage cuts, and the dealing out of small tables."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="docloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """What is in a folder; nothing if there is none."""
    at, fs = hadoop_path(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def written_at(spark: SparkSession, path: str) -> float:
    """When a file or folder was last changed, in seconds since 1970."""
    at, fs = hadoop_path(spark, path)
    return fs.getFileStatus(at).getModificationTime() / 1000


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    at, fs = hadoop_path(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = hadoop_path(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file, whole or not at all; False if there is one of this name already.

    The text is written beside it and then given the name, by a link where files are local and else by a rename that
    refuses an existing name, which has to be atomic (as in HDFS).
    """
    beside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    write_text(spark, beside, text)
    url = urlparse(path)
    try:
        if url.scheme in ("", "file"):
            local = lambda p: unquote(urlparse(p).path) if url.scheme else p
            try:
                os.link(local(beside), local(path))
            except FileExistsError:
                return False
            return True
        return renamed(spark, beside, path)
    finally:
        remove(spark, beside)


def renamed(spark: SparkSession, path: str, to: str) -> bool:
    """Whether a file could be given a name that nothing else has."""
    jvm = spark._jvm
    at, conf = jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(conf).makeQualified(at).toUri(), conf)
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        context.rename(at, jvm.org.apache.hadoop.fs.Path(to), options)
    except Exception as error:
        if "FileAlreadyExistsException" in str(error):
            return False
        raise
    return True


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder, so that what follows neither recomputes it nor depends on any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def size_of(df: DataFrame) -> int:
    """Bytes of the files below ``df``; tables whose size Spark doesn't know don't count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(n for n in known if n < 1 << 60)


def spread(df: DataFrame, most: int = 1 << 30) -> DataFrame:
    """A table of less than ``most`` bytes is often one row group and hence one task: it is dealt out to all cores. Larger ones have row groups enough and stay where they lie."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size_of(df) < most else df


def parts_for(df: DataFrame, each: int = 1 << 23) -> int:
    """Partitions for what is made of ``df`` at ``each`` bytes of its files, but no fewer than spark.sql.shuffle.partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size_of(df) / each))
