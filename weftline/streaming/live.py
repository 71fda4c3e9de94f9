"""Live updates: file events as a stream that keeps a store up to date, and history as an increment.

Events are (kind, path, old_hash, new_hash, ts) with kind Created, Modified, Removed or HashDrift. A trigger's interval is
the debounce: of the events of a path in one batch, the last counts. A rename is a Removed and a Created event."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.lineage import cut
from weftline.operators.derive import scoped_edges, symbols
from weftline.plans.store import Store, changeset
from weftline.sources.facts import extract, table

EVENTS = "kind string, path string, old_hash binary, new_hash binary, ts timestamp"


def last_events(batch: DataFrame, ignored: tuple[str, ...] = (".git", "node_modules", "target")) -> DataFrame:
    """(path, kind): the last event of each path outside ignored folders; removal wins over others of one time."""
    for s in ignored:
        batch = batch.filter(~F.concat(F.lit("/"), F.col("path")).contains(f"/{s}/"))
    return batch.groupBy("path").agg(F.max_by("kind", F.struct("ts", F.col("kind") == "Removed")).alias("kind"))


def reconcile(indexed: DataFrame, disk: DataFrame) -> DataFrame:
    """HashDrift events (kind, path, old_hash, new_hash) of files that are new or differ on disk. Files gone from disk are
    not told: a scan only visits what is there."""
    both = disk.select("path", F.col("content_hash").alias("new_hash")).join(indexed.select("path", F.col("content_hash").alias("old_hash")), "path", "left")
    return both.filter(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select(F.lit("HashDrift").alias("kind"), "path", "old_hash", "new_hash")


class Engine:
    """Facts of every file beside the store. `read(paths)` gives files (path, lang, size, content_hash, mtime_ns, content)
    that exist of a DataFrame of paths."""

    def __init__(self, store: Store, facts_folder: str, read: Callable[[DataFrame], DataFrame]):
        self.store, self.folder, self.read = store, facts_folder.rstrip("/"), read
        self.spark: SparkSession = store.spark

    def facts(self) -> DataFrame | None:
        at = self.store._fs.exists(self.store._path(f"{self.folder}/v{self.store.revision}"))
        return self.spark.read.parquet(f"{self.folder}/v{self.store.revision}") if at else None

    def refresh(self, events: DataFrame) -> int:
        """Re-reads the files of the events, forgets removed ones and derives all edges anew, as one revision. An unknown
        removed path changes nothing."""
        events = cut(last_events(events))
        changed = cut(self.read(events.filter("kind <> 'Removed'").select("path")))
        new = extract(changed)
        old = self.facts()
        facts = new if old is None else old.join(events.select("path"), "path", "left_anti").unionByName(new)
        facts = cut(facts)
        files = self.store.table("files").drop("file_id").join(events.select("path"), "path", "left_anti")
        files = files.unionByName(changed.select("path", "lang", "size", "content_hash", "mtime_ns"))
        from pyspark.sql import Window

        files = cut(files.withColumn("file_id", F.row_number().over(Window.orderBy("path"))))
        found = cut(symbols(table(facts, "decls"), files))
        edges = cut(scoped_edges(found, table(facts, "calls"), table(facts, "renders"), table(facts, "hooks")))
        before = self.store.revision
        facts.write.mode("overwrite").parquet(f"{self.folder}/v{before + 1}")
        return self.store.apply(**changeset(self.store, files, found, edges))

    def start(self, events: DataFrame, checkpoint: str, interval: str = "100 milliseconds"):
        """A streaming query that refreshes the store once a trigger. Replaying a batch after a failure derives the same
        tables again, so it does no harm."""
        return events.writeStream.foreachBatch(lambda batch, _: self.refresh(batch)).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def history_totals(commits: DataFrame) -> DataFrame:
    """Commits and last change of each path over a stream (commit_id, author, ts, path) of new commits; update mode."""
    return commits.groupBy("path").agg(F.count("*").alias("commits"), F.max("ts").alias("last_changed"))


def add_history(store: Store, commit_files: DataFrame, head: str, depth: int | None = None, max_files: int = 50) -> int:
    """Merges the commits after the store's watermark, or replaces history for a bounded depth; an unchanged head writes nothing.
    commit_files: what the `commits` source gave since the watermark."""
    from weftline.operators.metrics import co_change_counts

    if head == store.watermark and depth is None:
        return store.revision
    churn = commit_files.groupBy("path").agg(F.count("*").alias("commits"), F.collect_set("author").alias("author_keys"), F.max("ts").alias("last_changed"))
    pairs = co_change_counts(commit_files, max_files)
    merge = store.merge_history if store.watermark and depth is None else store.replace_history
    return merge(churn, pairs, head)
