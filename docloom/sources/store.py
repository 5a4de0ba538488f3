"""A store of documents' rows that is changed by commits: added to, replaced by document, deleted from, compacted.

    <store>/_log/<version>.json      a snapshot: the folders that make up the store, in order, and what streams have written
    <store>/<name>/<token>/...       a folder of Parquet files; never changed once it is written

A commit writes its folder first and then the next snapshot, whose file can be created only once: of two writers one
succeeds and the other tries again on top of it. Whatever fails before leaves a folder that no snapshot names, and the
store as it was. A reader takes one snapshot's folders, whatever is committed meanwhile.

A folder that replaces holds the rows of some documents, and the marks (``gone__``) of others: nothing that older folders
say of these documents counts any more. ``compact`` puts the current rows into one folder, ``vacuum`` removes folders that
only older snapshots name, and unfinished ones once they are old.

Defined results: a null id is a document as any other; columns that a folder lacks are null; a commit without rows is a
commit; a store without commits is empty. Numbers of commits between two compactions are what a snapshot grows with.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import names, publish, read_text, remove, written_at

MARK = "gone__"
EMPTY = {"folders": [], "schema": None, "streams": {}}


class Store:
    """path: a folder that driver and executors share. key: the column that names documents. name: the folder that commits go to where they don't say. by: columns whose values are folders of their own, so that readers of some values leave the others."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", name: str = "rows", by: tuple[str, ...] = ()):
        self.spark, self.path, self.key, self.name, self.by = spark, path.rstrip("/"), key, name, by

    # --- snapshots ---

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names(self.spark, f"{self.path}/_log") if n.endswith(".json") and not n.startswith(("_", ".")))

    def snapshot(self, version: int | None = None) -> tuple[int, dict]:
        """The last version, or that one, and what it says; version 0 is the store before any commit."""
        if version is None:
            version = max(self.versions(), default=0)
        return version, json.loads(read_text(self.spark, self.log(version))) if version else EMPTY

    def log(self, version: int) -> str:
        return f"{self.path}/_log/{version:020}.json"

    def commit(self, change: Callable[[dict], dict | None], tries: int = 100) -> int:
        """Publishes ``change(last snapshot)`` as the next version, on top of whatever others publish first. None changes nothing."""
        for _ in range(tries):
            version, last = self.snapshot()
            made = change(last)
            if made is None:
                return version
            if publish(self.spark, self.log(version + 1), json.dumps(made)):
                return version + 1
        raise RuntimeError(f"{tries} other commits to {self.path} came first")

    # --- changes ---

    def write(self, rows: DataFrame, replaces: bool, name: str | None = None) -> dict:
        """A new folder of ``rows``, which no snapshot names yet."""
        folder = f"{name or self.name}/{uuid.uuid4().hex}"
        rows.write.partitionBy(*self.by).parquet(f"{self.path}/{folder}")
        return {"path": folder, "replaces": replaces, "schema": rows.schema.jsonValue()}

    def put(self, rows: DataFrame, replaces: bool, name: str | None = None, stream: str | None = None, batch: int | None = None) -> int:
        if stream is not None and self.snapshot()[1]["streams"].get(stream, -1) >= batch:
            return self.snapshot()[0]
        entry = self.write(rows, replaces, name)

        def change(last: dict) -> dict | None:
            streams = last["streams"]
            if stream is not None:
                if streams.get(stream, -1) >= batch:
                    return None
                streams = streams | {stream: batch}
            schema = merged(last["schema"], entry["schema"])
            return {"folders": [*last["folders"], {k: entry[k] for k in ("path", "replaces")}], "schema": schema, "streams": streams}

        return self.commit(change)

    def add(self, rows: DataFrame) -> int:
        """More rows; ids may repeat."""
        return self.put(rows, False)

    def replace(self, rows: DataFrame, **where) -> int:
        """``rows`` in place of all that the store holds of their documents. A row whose ``gone__`` is true only says that nothing is left of its document. stream, batch: a batch of a stream is committed once, however often it is given."""
        return self.put(rows if MARK in rows.columns else rows.withColumn(MARK, F.lit(False)), True, **where)

    def delete(self, ids: DataFrame) -> int:
        """Nothing of the documents of ``ids``, a DataFrame with the key column, is left."""
        return self.replace(ids.select(self.key).distinct().withColumn(MARK, F.lit(True)))

    # --- rows ---

    def read(self, version: int | None = None, marks: bool = False) -> DataFrame:
        """The rows of one version; with ``marks`` those of deleted documents too."""
        return self.rows(self.snapshot(version)[1], marks)

    def rows(self, snapshot: dict, marks: bool = False) -> DataFrame:
        if not snapshot["folders"]:
            schema = StructType.fromJson(snapshot["schema"]) if snapshot["schema"] else f"{self.key} string"
            return self.spark.createDataFrame([], schema).drop(MARK)
        schema = StructType.fromJson(snapshot["schema"])
        schema = schema if MARK in schema.names else schema.add(MARK, "boolean")
        folders, columns = snapshot["folders"], [c for c in schema.names if c != MARK]
        newest = max((k for k, f in enumerate(folders) if f["replaces"]), default=0)
        older, replacing = folders[:newest], [(k, f) for k, f in enumerate(folders) if f["replaces"] and k]

        def scan(some: list[tuple[int, dict]]) -> DataFrame:
            token = F.regexp_extract(F.col("_metadata.file_path"), "/([0-9a-f]{32})/(?!.*/[0-9a-f]{32}/)", 1)
            paths = [f"{self.path}/{f['path']}" for _, f in some]
            each = [[p] for p in paths] if self.by else [paths]  # folders of values are found below one path at a time
            found = reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(*p).withColumn("token__", token) for p in each])
            numbers = self.spark.createDataFrame([(f["path"].rpartition("/")[2], k) for k, f in some], "token__ string, at__ int")
            return found.join(F.broadcast(numbers), "token__").drop("token__")  # a row a folder

        numbered = list(enumerate(folders))
        parts = [scan(numbered[newest:]).drop("at__")]
        if older:
            last = scan(replacing).groupBy(F.col(self.key).alias("key__")).agg(F.max("at__").alias("last__"))
            kept = scan(numbered[:newest]).join(last, F.col(self.key).eqNullSafe(F.col("key__")), "left").where("last__ IS NULL OR at__ >= last__")
            parts.append(kept.drop("key__", "last__", "at__"))
        rows = reduce(DataFrame.unionByName, parts)
        gone = F.coalesce(F.col(MARK), F.lit(False))
        return rows.withColumn(MARK, gone).select(*columns, MARK) if marks else rows.where(~gone).select(*columns)

    # --- upkeep ---

    def compact(self, name: str | None = None, tidy: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int:
        """One folder of the current rows, as ``tidy`` leaves them, in place of all; what is committed meanwhile stays behind it."""
        version, last = self.snapshot()
        if len(last["folders"]) < 2:
            return version
        entry = self.write(tidy(self.rows(last)), False, name)
        before = [f["path"] for f in last["folders"]]

        def change(now: dict) -> dict | None:
            if [f["path"] for f in now["folders"][: len(before)]] != before:
                return None  # another compaction came first
            return now | {"folders": [{k: entry[k] for k in ("path", "replaces")}, *now["folders"][len(before) :]]}

        return self.commit(change)

    def vacuum(self, keep: int = 2, hours: float = 24.0) -> list[str]:
        """Removes what none of the last ``keep`` versions needs: older snapshots and the folders that they alone name, and folders that no snapshot names once they are ``hours`` old. Gives the folders' names."""
        versions = self.versions()
        kept, dropped = versions[-max(1, keep) :], versions[: -max(1, keep)]
        folders = lambda some: {f["path"] for v in some for f in self.snapshot(v)[1]["folders"]}
        needed, named = folders(kept), folders(dropped)
        found = [f"{top}/{token}" for top in names(self.spark, self.path) if not top.startswith(("_", ".")) for token in names(self.spark, f"{self.path}/{top}")]
        old = lambda f: written_at(self.spark, f"{self.path}/{f}") < time.time() - 3600 * hours
        gone = [f for f in found if f not in needed and (f in named or old(f))]
        for f in gone:  # folders first: as long as a snapshot names them, they are found again
            remove(self.spark, f"{self.path}/{f}")
        for top in {f.partition("/")[0] for f in gone}:
            if not names(self.spark, f"{self.path}/{top}"):
                remove(self.spark, f"{self.path}/{top}")
        for v in dropped:
            remove(self.spark, self.log(v))
        return gone


def merged(schema: dict | None, more: dict) -> dict:
    """``schema`` and the columns it lacks; a column keeps its type."""
    if schema is None:
        return more
    kinds = {f["name"]: f["type"] for f in schema["fields"]}
    for f in more["fields"]:
        if kinds.setdefault(f["name"], f["type"]) != f["type"]:
            raise ValueError(f"column {f['name']} is {kinds[f['name']]} in the store, not {f['type']}")
    return schema | {"fields": [*schema["fields"], *[f for f in more["fields"] if f["name"] not in {g["name"] for g in schema["fields"]}]]}
