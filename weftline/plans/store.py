"""Versioned tables of a code graph: each revision is a folder of Parquet tables, and a pointer names the current one.

A reader keeps the revision it opened while a writer adds the next; the pointer is one small file that is renamed into
place, so a revision is seen whole or not at all. History keeps its watermark in the revision it belongs to."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.metrics import merge_churn, merge_pairs

SCHEMA = 1
TABLES = {
    "files": "file_id int, path string, lang string, size bigint, content_hash binary, mtime_ns decimal(38,0)",
    "symbols": "symbol_id bigint, name string, kind string, file string, byte_start bigint, byte_end bigint, visibility string, attributes array<string>, complexity bigint, lang string",
    "edges": "src bigint, dst bigint, kind string, file string, byte_start bigint, byte_end bigint",
    "churn": "path string, commits bigint, author_keys array<bigint>, last_changed timestamp_ntz",
    "co_change": "a string, b string, count bigint",
    "symbol_churn": "symbol_id bigint, commits bigint",
}
KEYS = {"files": ["path"], "symbols": ["symbol_id"], "edges": ["src", "kind", "dst"]}


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self) -> dict:
        rows = self.spark.read.text(f"{self.folder}/CURRENT").collect() if self._fs.exists(self._path(f"{self.folder}/CURRENT")) else []
        state = json.loads(rows[0][0]) if rows else {"revision": 0, "schema": SCHEMA, "watermark": None, "tables": {}}
        if state["schema"] > SCHEMA:
            raise ValueError(f"the store has schema {state['schema']}, this code {SCHEMA}")
        return state

    @property
    def revision(self) -> int:
        return self._pointer()["revision"]

    @property
    def watermark(self) -> str | None:
        return self._pointer()["watermark"]

    def table(self, name: str) -> DataFrame:
        """A table of the current revision; columns that an older schema lacks are null."""
        at = self._pointer()["tables"].get(name)
        if at is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{at}")

    def _commit(self, tables: dict[str, DataFrame], watermark: str | None = None) -> int:
        """Writes the tables as the next revision and moves the pointer. Tables not named stay as they are."""
        state = self._pointer()
        revision = state["revision"] + 1
        at = dict(state["tables"])
        for name, df in tables.items():
            at[name] = f"r{revision:08d}/{name}"
            columns = [c.split()[0] for c in TABLES[name].split(", ")]
            df.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/{at[name]}")
        state |= {"revision": revision, "tables": at, "watermark": watermark or state["watermark"]}
        new, current = self._path(f"{self.folder}/CURRENT.new"), self._path(f"{self.folder}/CURRENT")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(new, current, options)
        return revision

    def apply(self, files: DataFrame | None = None, symbols: DataFrame | None = None, edges: DataFrame | None = None, delete_files: DataFrame | None = None, delete_symbols: DataFrame | None = None, delete_edges: DataFrame | None = None) -> int:
        """One changeset as one revision, in this order: files deleted with their symbols and edges, files, symbols set,
        symbols deleted, edges removed, edges added."""
        f, s, e = self.table("files"), self.table("symbols"), self.table("edges")
        if delete_files is not None:
            gone = delete_files.select("path").distinct()
            f = f.join(gone, "path", "left_anti")
            s = s.join(gone.withColumnRenamed("path", "file"), "file", "left_anti")
            e = e.join(gone.withColumnRenamed("path", "file"), "file", "left_anti")
        f, s = upserted(f, files, KEYS["files"]), upserted(s, symbols, KEYS["symbols"])
        if delete_symbols is not None:
            s = s.join(delete_symbols.select("symbol_id"), "symbol_id", "left_anti")
        if delete_edges is not None:
            e = e.join(delete_edges.select(*KEYS["edges"]), KEYS["edges"], "left_anti")
        return self._commit({"files": f, "symbols": s, "edges": upserted(e, edges, KEYS["edges"])})

    def replace_history(self, churn: DataFrame, pairs: DataFrame, watermark: str | None = None) -> int:
        return self._commit({"churn": churn, "co_change": pairs}, watermark)

    def merge_history(self, churn: DataFrame, pairs: DataFrame, watermark: str | None = None) -> int:
        """Adds new history; the watermark moves in the same revision, so a repeated increment is told by it."""
        if watermark is not None and watermark == self.watermark:
            return self.revision
        return self._commit({"churn": merge_churn(self.table("churn"), churn), "co_change": merge_pairs(self.table("co_change"), pairs)}, watermark)

    def replace_symbol_churn(self, churn: DataFrame) -> int:
        return self._commit({"symbol_churn": churn})

    # point and range reads; Parquet's statistics and filters do the rest
    def file(self, file_id: int) -> DataFrame:
        return self.table("files").filter(F.col("file_id") == file_id)

    def outgoing(self, src: int) -> DataFrame:
        return self.table("edges").filter(F.col("src") == src)

    def incoming(self, dst: int) -> DataFrame:
        return self.table("edges").filter(F.col("dst") == dst)

    def edges_of_file(self, path: str) -> DataFrame:
        return self.table("edges").filter(F.col("file") == path)

    def symbols_of_file(self, path: str) -> DataFrame:
        return self.table("symbols").filter(F.col("file") == path)


def upserted(old: DataFrame, new: DataFrame | None, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of their keys."""
    if new is None:
        return old
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def stale(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of old rows that new no longer has."""
    return old.select(*keys).join(new.select(*keys), keys, "left_anti")


def changeset(store: Store, files: DataFrame, symbols: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """What apply() takes to make the store equal to the derived tables."""
    names = {"files": files, "symbols": symbols, "edges": edges}
    return names | {f"delete_{n}": stale(store.table(n), df, KEYS[n]) for n, df in names.items()}


def removed_edges(edges: DataFrame, *deltas: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select(*KEYS["edges"]), KEYS["edges"], "left_anti"), deltas, edges)
