import random

import pytest
from pyspark.sql import functions as F

from weftline.operators.derive import scoped_edges, symbols
from weftline.plans.store import Store, changeset, stale
from weftline.sources.facts import extract, table
from weftline.streaming.live import EVENTS, Engine, add_history, history_totals, last_events, reconcile


def file_rows(spark, contents):
    rows = [(p, "python", len(c), bytearray(str(hash(c)).encode()), 0, bytearray(c.encode())) for p, c in sorted(contents.items())]
    df = spark.createDataFrame(rows, "path string, lang string, size bigint, content_hash binary, mtime_ns bigint, content binary")
    return df.withColumn("mtime_ns", F.col("mtime_ns").cast("decimal(38,0)"))


def state(store):
    s = {(r["file"], r["name"], r["symbol_id"]) for r in store.table("symbols").collect()}
    e = {(r["src"], r["kind"], r["dst"]) for r in store.table("edges").collect()}
    return {r["path"] for r in store.table("files").collect()}, s, e


def fresh(spark, contents, folder):
    store = Store(spark, folder)
    files = file_rows(spark, contents)
    facts = extract(files)
    found = symbols(table(facts, "decls"), files)
    edges = scoped_edges(found, table(facts, "calls"), table(facts, "renders"), table(facts, "hooks"))
    store.apply(**changeset(store, files.withColumn("file_id", F.lit(1)), found, edges))
    return store


def test_incremental_equals_rebuild(spark, tmp_path):
    r = random.Random(1)
    contents: dict[str, str] = {}
    store = Store(spark, f"file://{tmp_path}/a")
    known = lambda paths: file_rows(spark, contents).join(paths, "path", "left_semi")
    engine = Engine(store, f"file://{tmp_path}/facts", known)
    for step in range(3):
        touched = []
        for _ in range(2):
            path = f"d/f{r.randrange(4)}.py"
            if path in contents and r.random() < 0.3:
                del contents[path]
                touched.append(("Removed", path))
            else:
                calls = "\n    ".join(f"g{r.randrange(5)}()" for _ in range(3))
                contents[path] = f"def g{r.randrange(5)}():\n    {calls}\n"
                touched.append(("Modified", path))
        rows = [(k, p, None, None, n) for n, (k, p) in enumerate(touched)]
        events = spark.createDataFrame(rows, "kind string, path string, old_hash binary, new_hash binary, t long").withColumn("ts", F.timestamp_seconds("t"))
        assert engine.refresh(events) == step + 1
        assert state(store) == state(fresh(spark, contents, f"file://{tmp_path}/b{step}"))


def test_order_of_a_changeset_and_reads(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.revision == 0 and store.table("edges").count() == 0
    fresh_store = fresh(spark, {"a.py": "def f():\n    g()\n\ndef g():\n    pass\n", "b.py": "def h():\n    f()\n"}, f"file://{tmp_path}/s")
    old = fresh_store.table("symbols")
    n = {r["name"]: r["symbol_id"] for r in old.collect()}
    assert {r["dst"] for r in store.outgoing(n["f"]).collect()} == {n["g"]} and {r["src"] for r in store.incoming(n["f"]).collect()} == {n["h"]}
    assert store.edges_of_file("b.py").count() == 1 and store.symbols_of_file("a.py").count() == 2 and store.file(1).count() == 2
    gone = spark.createDataFrame([("a.py",)], "path string")
    extra = spark.createDataFrame([(n["h"], n["h"], "Reads", "b.py", 0, 1)], "src long, dst long, kind string, file string, byte_start long, byte_end long")
    assert store.apply(delete_files=gone, edges=extra, delete_symbols=old.filter("name = 'none'")) == 2
    assert [r["name"] for r in store.table("symbols").collect()] == ["h"]
    assert {(r["file"], r["kind"]) for r in store.table("edges").collect()} == {("b.py", "References"), ("b.py", "Reads")}
    assert old.count() == 3  # an open reader keeps its revision
    assert [tuple(r) for r in stale(old, store.table("symbols"), ["symbol_id"]).filter(F.col("symbol_id") == n["g"]).collect()] == [(n["g"],)]


def test_history_moves_with_its_mark(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/h")

    def commits(*rows):
        return spark.createDataFrame(list(rows), "commit_id string, author long, t long, path string").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))

    assert add_history(store, commits(("1", 7, 5, "a"), ("1", 7, 5, "b")), "1") == 1
    assert add_history(store, commits(("2", 8, 9, "a")), "2") == 2
    assert add_history(store, commits(("2", 8, 9, "a")), "2") == 2  # nothing new
    got = {r["path"]: (r["commits"], r["author_keys"]) for r in store.table("churn").collect()}
    assert got == {"a": (2, [7, 8]), "b": (1, [7])} and [tuple(r) for r in store.table("co_change").collect()] == [("a", "b", 1)]
    assert store.watermark == "2"
    assert add_history(store, commits(("2", 8, 9, "a")), "2", depth=1) == 3 and store.table("churn").count() == 1
    store.replace_symbol_churn(spark.createDataFrame([(1, 2)], "symbol_id long, commits long"))
    assert store.table("symbol_churn").count() == 1 and store.watermark == "2"


def test_a_newer_schema_is_refused(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/CURRENT").write_text('{"revision": 1, "schema": 99, "watermark": null, "tables": {}}')
    with pytest.raises(ValueError):
        Store(spark, f"file://{tmp_path}/n").revision


def test_events_and_reconciliation(spark):
    rows = [("Created", "a", 1), ("Removed", "a", 2), ("Modified", "b", 1), ("Removed", "b", 1), ("Created", ".git/x", 1), ("Created", "new", 5)]
    events = spark.createDataFrame(rows, "kind string, path string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert {(r["path"], r["kind"]) for r in last_events(events).collect()} == {("a", "Removed"), ("b", "Removed"), ("new", "Created")}
    table = lambda *rows: spark.createDataFrame(list(rows), "path string, content_hash string")
    got = reconcile(table(("a", "1"), ("b", "1"), ("gone", "1")), table(("a", "1"), ("b", "2"), ("c", "3")))
    assert {(r["kind"], r["path"], r["old_hash"]) for r in got.collect()} == {("HashDrift", "b", "1"), ("HashDrift", "c", None)}


def test_stream_keeps_the_store_up_to_date(spark, tmp_path):
    contents = {"a.py": "def f():\n    g()\n\ndef g():\n    pass\n"}
    store = Store(spark, f"file://{tmp_path}/s")
    engine = Engine(store, f"file://{tmp_path}/facts", lambda paths: file_rows(spark, contents).join(paths, "path", "left_semi"))
    (tmp_path / "in").mkdir()

    def send(name, *rows):
        df = spark.createDataFrame([(k, p, None, None, t) for k, p, t in rows], "kind string, path string, old_hash binary, new_hash binary, t long")
        df.withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    stream = lambda: engine.start(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), str(tmp_path / "mark"))
    send("1", ("Created", "a.py", 1))
    query = stream()
    query.processAllAvailable()
    assert {r["name"] for r in store.table("symbols").collect()} == {"f", "g"} and store.table("edges").count() == 1
    query.stop()
    contents.clear()
    send("2", ("Removed", "a.py", 2))
    query = stream()  # goes on where it was
    query.processAllAvailable()
    query.stop()
    assert store.table("symbols").count() == 0 and store.revision == 2


def test_history_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("1", 1, 5, "a"), ("2", 1, 6, "a")], "commit_id string, author long, t long, path string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    rows.write.parquet(str(tmp_path / "in"))
    totals = history_totals(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = totals.writeStream.format("memory").queryName("totals").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.sql("select path, commits from totals").collect()] == [("a", 2)]
