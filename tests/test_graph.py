import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, impact, metrics, navigate, rules


def edge_table(spark, rows):
    return spark.createDataFrame([(a, b, k) for a, b, *r in rows for k in [r[0] if r else "Calls"]], "src long, dst long, kind string")


def ids(spark, *n):
    return spark.createDataFrame([(x,) for x in n], "symbol_id long")


def seed(spark, *n):
    return spark.createDataFrame([(x,) for x in n], "seed long")


MINI = [(1, 2), (2, 3), (3, 4), (3, 5, "TypeOf"), (6, 5, "Overrides"), (8, 2)]
CYCLIC = [(1, 2), (4, 2), (2, 5), (5, 6), (6, 2), (1, 7), (2, 8, "TypeOf")]
MODULES = {"lib": [1, 2, 3], "util": [4], "model": [5, 6]}


def module_table(spark, modules, abstract=()):
    return spark.createDataFrame([(m, s, s in abstract) for m, ss in modules.items() for s in ss], "module string, symbol_id long, is_abstract boolean")


def blast(spark, rows, start, kinds=None, depth=3, local=graph.LOCAL):
    got = graph.blast_radius(edge_table(spark, rows), seed(spark, start), kinds, depth, local).collect()
    return sorted(r["node"] for r in got if r["must"]), sorted(r["node"] for r in got if not r["must"]), max((r["hop"] for r in got), default=0)


@pytest.mark.parametrize(
    "rows,start,kinds,depth,expected",
    [
        (MINI, 5, None, 10, ([3, 6], [1, 2, 8], 3)),
        ([(2, 1), (3, 1), (4, 2), (4, 3)], 1, None, 2, ([2, 3, 4], [], 2)),
        ([(2, 1), (3, 2), (4, 3)], 1, None, 3, ([2], [3, 4], 3)),
        ([(2, 1), (3, 2), (4, 3)], 1, None, 1, ([2], [], 1)),
        ([(2, 1), (3, 2), (3, 1, "Imports")], 1, ["Calls"], 3, ([2, 3], [], 2)),
        (MINI, 7, None, 3, ([], [], 0)),
    ],
)
@pytest.mark.parametrize("local", [graph.LOCAL, 0])
def test_blast_radius(spark, rows, start, kinds, depth, expected, local):
    assert blast(spark, rows, start, kinds, depth, local) == expected


def test_dominators_agree_beyond_local_size(spark):
    r = random.Random(3)
    rows = list({(r.randrange(12), r.randrange(12)) for _ in range(26)})
    edges = edge_table(spark, [(a, b) for a, b in rows if a != b])
    start = rows[0][1]
    near = {(x["node"], x["depth"]) for x in graph.dominators(edges, seed(spark, start)).collect()}
    far = {(x["node"], x["depth"]) for x in graph.dominators(edges, seed(spark, start), 0).collect()}
    # by taking each node out
    back = {}
    for a, b in rows:
        back.setdefault(b, set()).add(a)

    def reach(without=None):
        seen, todo = {start}, [start]
        while todo:
            for n in back.get(todo.pop(), ()):
                if n not in seen and n != without:
                    seen.add(n)
                    todo.append(n)
        return seen - {start}

    every = reach()
    brute = {(n, 1 + sum(d != n and n not in reach(d) for d in every)) for n in every}
    assert near == brute and far == brute


@pytest.mark.parametrize("local", [graph.LOCAL, 0])
def test_cycles(spark, local):
    got = {(r["node"], r["cycle"]) for r in graph.cycles(edge_table(spark, [*CYCLIC, (9, 10), (10, 9), (11, 11)]), local).collect()}
    assert got == {(2, 2), (5, 2), (6, 2), (9, 9), (10, 9)}
    assert graph.cycles(edge_table(spark, MINI), local).count() == 0


def test_cycles_do_not_depend_on_order(spark):
    r = random.Random(5)
    rows = list({(r.randrange(15), r.randrange(15)) for _ in range(39)})
    want = {(x["node"], x["cycle"]) for x in graph.cycles(edge_table(spark, rows)).collect()}
    r.shuffle(rows)
    assert {(x["node"], x["cycle"]) for x in graph.cycles(edge_table(spark, rows), 0).collect()} == want


def test_breaks_and_cuts(spark):
    edges = edge_table(spark, CYCLIC)
    found = graph.cycles(edges)
    got = {(r["src"], r["dst"]): round(r["score"], 4) for r in graph.cycle_breaks(edges, ids(spark, *range(1, 9)), found).collect()}
    assert got == {(5, 6): 1.0, (6, 2): 0.5, (2, 5): 0.3333}
    assert [tuple(r) for r in graph.suggested_cuts(edges, found).collect()] == [(2, 2, 5)]
    assert graph.cycle_clusters(found, ids(spark, 2, 5)).count() == 0
    assert graph.cycle_clusters(found, ids(spark, 2, 5, 6)).first()["representatives"] == [2, 5, 6]


def test_coupling(spark):
    got = {r["module"]: r for r in metrics.coupling(module_table(spark, MODULES, {6}), edge_table(spark, MINI)).collect()}
    values = {m: (r["ca"], r["ce"], round(r["instability"], 2), r["abstractness"], round(r["distance"], 2)) for m, r in got.items()}
    assert values == {"lib": (1, 2, 0.67, 0.0, 0.33), "model": (1, 0, 0.0, 0.5, 0.5), "util": (1, 0, 0.0, 0.0, 1.0)}


def test_god_modules(spark):
    modules = module_table(spark, {"a": [1, 2, 3], "b": [4], "c": [5, 6], "d": [7], "e": [8]})
    got = metrics.god_modules(modules, edge_table(spark, CYCLIC), 2).collect()
    assert [(r["module"], r["ce"], round(r["cohesion"], 4), [tuple(x) for x in r["outbound"]], r["share"]) for r in got] == [("a", 3, 0.1667, [(2, 2), (1, 1)], 67)]


def test_misplaced(spark):
    got = metrics.misplaced(module_table(spark, {"mod_a": [1, 2], "mod_b": [3, 4, 5]}), edge_table(spark, [(2, 1), (3, 1), (4, 1), (5, 1)]))
    assert [tuple(r) for r in got.collect()] == [(1, "mod_a", "mod_b", 3.0)]


def test_dead_code_and_plan(spark):
    nodes = ids(spark, *range(1, 9))
    assert sorted(r[0] for r in graph.dead_code(nodes, edge_table(spark, MINI), ids(spark, 8, 1)).collect()) == [6, 7]
    files = spark.createDataFrame([(1, "1"), (2, "1"), (3, "2"), (4, "3"), (5, "4"), (6, "4"), (7, "5"), (8, "6")], "symbol_id long, file string")
    got = graph.plan_assist(edge_table(spark, MINI), files, 2, 10).orderBy("place").collect()
    assert [(r["file"], r["certainty"], r["reasons"]) for r in got] == [("1", 1.0, [1]), ("6", 1.0, [8])]


def test_kinds_collapse_and_filter(spark):
    stored = edge_table(spark, [(1, 2, "References"), (1, 2, "Renders"), (3, 2, "Reads"), (4, 2, "Writes"), (5, 2, "Implements"), (6, 2, "TypeOf")])
    edges = graph.graph_edges(stored)
    assert edges.count() == 5
    for kinds, node in ((["Reads"], 3), (["Writes"], 4), (["Inherits"], 5), (["TypeOf"], 6), (["Calls"], 1)):
        assert [r["node"] for r in graph.callers(graph.of_kinds(edges, kinds), seed(spark, 2), 3).collect()] == [node]


def test_layers(spark):
    got = {r["node"]: r["layer"] for r in graph.layers(edge_table(spark, CYCLIC), ids(spark, *range(1, 9))).collect()}
    assert got == {1: 2, 2: 1, 3: 0, 4: 2, 5: 1, 6: 1, 7: 0, 8: 0}


def test_diff_blast_and_tests(spark):
    edges = edge_table(spark, [(2, 1), (3, 2), (5, 4), (6, 5)])
    ranges = spark.createDataFrame([(1, "a.rs", 1, 2), (4, "b.rs", 1, 2)], "symbol_id long, path string, first_line int, last_line int")
    hunks = spark.createDataFrame([("a.rs", 1, 1), ("b.rs", 2, 2)], "path string, start_line int, end_line int")
    changed = spark.createDataFrame([("a.rs",), ("b.rs",), ("newfile.rs",)], "path string")
    found = impact.diff_blast(edges, hunks, ranges, changed)
    by = {}
    for r in found.collect():
        by.setdefault(r["part"], []).append(r["symbol_id"] or r["path"])
    assert {k: sorted(v) for k, v in by.items()} == {"seed": [1, 4], "must": [2, 5], "may": [3, 6], "unresolved": ["newfile.rs"]}
    assert [r[0] for r in impact.affected_tests(found, ids(spark, 1, 6, 9)).collect()] == [1, 6]


@pytest.mark.parametrize("local", [0, 6])
def test_musts_of_all_seeds_beyond_local_size(spark, local):
    """Ladders, chains and rings, from each node: as the dominators have it."""
    r = random.Random(11)
    rows = list({(a, b) for a, b in ((r.randrange(14), r.randrange(14)) for _ in range(21)) if a != b})
    edges, every = edge_table(spark, [*rows, *((20 + k + d, 20 + k) for k in range(6) for d in (1, 2)), *((30 + k + 1, 30 + k) for k in range(4)), (40, 41), (41, 40)]), seed(spark, *range(42))
    want = {tuple(x) for x in graph.dominators(edges, every).filter("depth = 1").select("seed", "node").collect()}
    got = [tuple(x) for x in graph.musts(edges, every, local).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_diff_blast_writes_the_same_rounds_for_any_number_of_seeds(spark, monkeypatch):
    """Beyond local size, seeds go through the rounds together."""
    written = []
    for module in (graph, impact):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: written.append(df) or cut(df))

    def run(n):
        edges = edge_table(spark, [e for k in range(0, 100 * n, 100) for e in ((k + 2, k + 1), (k + 3, k + 1), (k + 4, k + 2), (k + 5, k + 3), (k + 6, k + 4), (k + 6, k + 5), (k + 7, k + 5), (k + 7, k + 8))])
        ranges = spark.createDataFrame([(100 * k + 1, "a.rs", 1, 2) for k in range(n)], "symbol_id long, path string, first_line int, last_line int")
        hunks = spark.createDataFrame([("a.rs", 1, 1)], "path string, start_line int, end_line int")
        written.clear()
        found = impact.diff_blast(edges, hunks, ranges, hunks.select("path"), local=0).collect()
        return len(written), sorted((r["symbol_id"] // 100, r["symbol_id"] % 100) for r in found if r["part"] == "must")

    few, many = run(1), run(12)
    assert few[1] == [(0, 2), (0, 3), (0, 6)] and many[1] == [(k, n) for k in range(12) for n in (2, 3, 6)]
    assert many[0] == few[0]


def test_blast_radius_writes_the_same_rounds_for_any_number_of_seeds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: written.append(df) or cut(df))

    def run(n):
        edges = edge_table(spark, [e for k in range(0, 10 * n, 10) for e in ((k + 2, k + 1), (k + 3, k + 1), (k + 4, k + 2), (k + 4, k + 3), (k + 5, k + 4))])
        written.clear()
        got = graph.blast_radius(edges, seed(spark, *range(1, 10 * n, 10)), ["Calls"], 3, 0).collect()
        return len(written), sorted((r["seed"] // 10, r["node"] % 10, r["must"]) for r in got)

    few, many = run(1), run(4)
    assert few[1] == [(0, 2, True), (0, 3, True), (0, 4, True), (0, 5, False)]
    assert many == (few[0], [(k, *r[1:]) for k in range(4) for r in few[1]])


def test_affected_tests_need_no_musts(spark, monkeypatch):
    r = random.Random(2)
    edges = edge_table(spark, list({(a, b) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(50)) if a != b}))
    ranges = spark.createDataFrame([(k, "a.rs", k, k) for k in range(40)], "symbol_id long, path string, first_line int, last_line int")
    hunks = spark.createDataFrame([("a.rs", 3, 4), ("a.rs", 30, 30)], "path string, start_line int, end_line int")
    tests = ids(spark, *range(0, 40, 2))
    want = impact.affected_tests(impact.diff_blast(edges, hunks, ranges, hunks.select("path")), tests).collect()
    monkeypatch.setattr(graph, "musts_by_steps", None)
    monkeypatch.setattr(impact, "musts_by_steps", None)
    got = impact.affected_tests(impact.diff_reach(edges, hunks, ranges), tests).collect()
    assert 3 < len(got) < 20 and got == want


def test_hotspots(spark):
    churn = spark.createDataFrame([("hot", 10), ("cold", 2), ("churned_simple", 8), ("complex_stable", 1)], "path string, commits long")
    size = spark.createDataFrame([("hot", 20), ("cold", 5), ("complex_stable", 25)], "path string, complexity long")
    got = [(r["path"], round(r["score"], 6)) for r in metrics.hotspots(churn, size).collect()]
    assert got == [("hot", 0.8), ("complex_stable", 0.1), ("cold", 0.04), ("churned_simple", 0.0)]
    assert metrics.file_risk(churn, size, "nowhere") == 0.0 and metrics.file_risk(churn.limit(0), size, "hot") is None


def test_co_change(spark):
    churn = spark.createDataFrame([("a", 10), ("b", 8), ("c", 12), ("d", 20), ("rare", 3), ("big1", 30), ("big2", 40)], "path string, commits long")
    pairs = spark.createDataFrame([("a", "b", 6), ("b", "d", 7), ("c", "d", 5), ("a", "c", 3), ("a", "rare", 6), ("big1", "big2", 5), ("a", "missing", 9)], "a string, b string, count long")
    assert [(r["a"] + r["b"], round(r["degree"], 4)) for r in metrics.co_change(pairs, churn).collect()] == [("ab", 0.6667), ("bd", 0.5), ("cd", 0.3125)]


def test_large_commits_count_for_churn_only(spark):
    rows = [(1, 7, p) for p in "abc"] + [(2, 8, p) for p in "ab"]
    commits = spark.createDataFrame(rows, "commit_id long, author long, path string").withColumn("ts", F.timestamp_seconds("commit_id"))
    assert [tuple(r) for r in metrics.co_change_counts(commits, 2).collect()] == [("a", "b", 1)]
    assert {r["path"]: (r["commits"], r["authors"]) for r in metrics.file_churn(commits).collect()} == {"a": (2, 2), "b": (2, 2), "c": (1, 1)}


def test_symbol_churn(spark):
    ranges = spark.createDataFrame([(1, "lib.rs", 1, 3), (2, "lib.rs", 5, 7)], "symbol_id long, path string, first_line int, last_line int")
    hunks = spark.createDataFrame([(1, "lib.rs", 2, 2), (1, "lib.rs", 3, 3), (2, "lib.rs", 6, 6), (3, "lib.rs", 4, 4)], "commit_id long, path string, start_line int, end_line int")
    assert {tuple(r) for r in metrics.symbol_churn(hunks, ranges).collect()} == {(1, 1), (2, 1)}


def test_history_merge_equals_one_walk(spark):
    def half(rows):
        df = spark.createDataFrame(rows, "author long, path string, t long").withColumn("ts", F.timestamp_seconds("t"))
        return df.groupBy("path").agg(F.count("*").alias("commits"), F.array_sort(F.collect_set("author")).alias("author_keys"), F.max("ts").alias("last_changed"))

    a, b = [(1, "x", 5), (2, "x", 6), (1, "y", 7)], [(2, "x", 9), (3, "z", 1)]
    got = {tuple(map(str, r)) for r in metrics.merge_churn(half(a), half(b)).collect()}
    assert got == {tuple(map(str, r)) for r in half(a + b).collect()}


def test_fitness(spark):
    symbols = spark.createDataFrame([(1, "ui/a"), (2, "core/b"), (3, "core/c")], "symbol_id long, file string")
    files = rules.layered(symbols.select(F.col("file").alias("path")).distinct(), [("ui", "ui/**"), ("core", "core/*"), ("late", "**")])
    forbidden = spark.createDataFrame([("ui", "core")], "from_layer string, to_layer string")
    edges = edge_table(spark, [(1, 2), (1, 3), (2, 3), (3, 2)])
    got = [(r["rank"], r["rule"], r["from_file"], r["to_file"], r["members"]) for r in rules.fitness(symbols, edges, files, forbidden, 0, 0.9).collect()]
    assert got == [(0, "forbidden", "ui/a", "core/b", None), (0, "forbidden", "ui/a", "core/c", None), (1, "cycle", None, None, [2, 3]), (2, "instability", "ui/a", None, None)]
    assert rules.fitness(symbols, edges, files, forbidden.limit(0), 1).count() == 0


def test_api_diff(spark):
    schema = "name string, kind string, signature string, pos int"
    base = spark.createDataFrame([("f", "function", "fn f()", 1), ("g", "function", "fn g()", 2), ("h", "function", "old", 3), ("h", "function", "fn h()", 4)], schema)
    head = spark.createDataFrame([("g", "function", "fn g(x)", 1), ("h", "function", "fn h()", 2), ("n", "struct", "struct n", 3)], schema)
    diff = rules.api_diff(base, head)
    assert [(r["name"], r["change"]) for r in diff.collect()] == [("f", "removed"), ("g", "changed"), ("n", "added")]
    assert rules.semver(diff).first()[0] == "major"
    assert rules.semver(diff.filter("change = 'added'")).first()[0] == "minor"
    assert rules.semver(rules.api_diff(base, base)).first()[0] == "none"


def test_references_take_the_last_kind(spark):
    symbols = spark.createDataFrame([(1, "target"), (2, "caller")], "symbol_id long, name string")
    stored = spark.createDataFrame([(2, 1, "References", "b", 9), (2, 1, "UsesHook", "b", 3), (7, 1, "Reads", "a", 1)], "src long, dst long, kind string, file string, byte_start long")
    assert [(r["caller_name"], r["kind"]) for r in navigate.find_references(symbols, stored, 1).collect()] == [("<unknown>", "Reads"), ("caller", "UsesHook")]
    with pytest.raises(LookupError):
        navigate.definition(symbols, "none")


@pytest.mark.parametrize(
    "path,kind",
    [("a/node_modules/x.js", "Vendored"), ("x.min.js", "Vendored"), ("target/a.rs", "Generated"), ("a/b.pb.rs", "Generated"), ("fixtures/a.py", "Fixture"), ("a/tests/b.py", "Test"), ("a_test.go", "Test"), ("src/tests.rs", "Test"), ("Cargo.TOML", "Config"), (".claude/x.md", "Config"), ("src/lib.rs", "Source")],
)
def test_doc_kinds(spark, path, kind):
    assert spark.createDataFrame([(path,)], "p string").select(rules.doc_kind(F.col("p"))).first()[0] == kind


@pytest.mark.parametrize(
    "lang,visibility,attributes,kind,name,path,root,test",
    [
        ("rust", "Public", [], "function", "f", "a.rs", True, False),
        ("rust", "Private", ["tokio::test"], "function", "f", "a.rs", True, True),
        ("rust", "Private", [], "function", "main", "a.rs", True, False),
        ("go", "Private", [], "function", "TestX", "a_test.go", True, True),
        ("go", "Private", [], "function", "TestX", "a.go", True, False),
        ("python", "Unknown", ["app.route"], "function", "f", "a.py", True, False),
        ("python", "Unknown", [], "function", "test_a", "a.py", True, True),
        ("python", "Unknown", [], "function", "f", "test_a.py", False, True),
        ("typescript", "Private", [], "function", "f", "a.spec.ts", False, True),
        ("java", "Private", ["org.junit.Test"], "method", "t", "A.java", True, True),
        ("java", "Private", [], "field", "main", "A.java", False, False),
        ("csharp", "Private", ["Fact"], "method", "t", "A.cs", True, True),
        ("cpp", "Private", [], "function", "TEST_x", "a.cpp", False, True),
        (None, "Public", [], "function", "f", "a", False, False),
    ],
)
def test_roots_and_tests(spark, lang, visibility, attributes, kind, name, path, root, test):
    row = spark.createDataFrame([(lang, visibility, attributes, kind, name, path)], "lang string, visibility string, attributes array<string>, kind string, name string, file string")
    assert tuple(row.select(rules.is_root(), rules.is_test()).first()) == (root, test)
