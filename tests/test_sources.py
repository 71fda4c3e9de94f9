import os
import subprocess

import pytest
from pyspark.sql import functions as F

from weftline.functions.text import decode_cursor, encode_cursor, glob_regex, paths_fingerprint
from weftline.operators import derive, graph, intervals, navigate, rules
from weftline.plans import outline
from weftline.sources import facts, history, occurrences, repository, rules_file

PY = b"""import os
from a.b import c


@pytest.fixture
def outer(x):
    # note
    if x and x > 1:
        return inner(x)
    for y in [z for z in x if z]:
        y.run()
    return 0


class Box:
    def put(self):
        return outer(self)
"""
TS = b"""import { x } from './x';
export class A { @Get('/') public run(a: number): void { if (a && b) { helper(a); } } }
export function App() { const s = useState(0); return <Panel><Item/></Panel>; }
function helper(n) { return n ? 1 : this.go(n); }
"""
RS = b"""use a::b;
/// doc
#[tokio::test]
pub async fn one(x: u8) -> u8 { if x > 1 || x == 0 { two(x) } else { b::three(x) } }
pub(crate) fn two(x: u8) -> u8 { x.four(); match x { 1 => 2, _ => 3 } }
struct S { a: u8 }
"""


def names(found, kind, *at):
    return [tuple(x[k] for k in at) for x in found[kind]]


def test_python_facts():
    f = facts.facts_of("python", PY)
    assert names(f, "decls", 0, 1, 5, 6) == [("function", "outer", ["pytest.fixture"], 5), ("class", "Box", [], 0), ("function", "put", [], 1)]
    assert names(f, "calls", 0, 1) == [("inner", "free"), ("run", "method"), ("outer", "free")]
    assert names(f, "imports", 0) == [("os",), ("a.b",)]
    assert PY[f["decls"][0][2] : f["decls"][0][3]].startswith(b"def outer")
    assert facts.facts_of("python", b"def (") == facts.empty()


def test_script_and_rust_facts():
    f = facts.facts_of("tsx", TS)
    assert {n for _, n, *_ in f["decls"]} == {"A", "run", "App", "helper"}
    assert [(d[0], d[4]) for d in f["decls"] if d[1] == "App"] == [("component", "Public")]
    assert names(f, "renders", 0) == [("Panel",), ("Item",)] and names(f, "hooks", 0) == [("useState",)]
    assert ("helper", "free") in names(f, "calls", 0, 1) and ("go", "method") in names(f, "calls", 0, 1)
    f = facts.facts_of("rust", RS)
    assert names(f, "decls", 0, 1, 4, 5, 6) == [("function", "one", "Public", ["tokio::test"], 3), ("function", "two", "Restricted", [], 3), ("struct", "S", "Private", [], 0)]
    assert names(f, "calls", 0, 1) == [("two", "free"), ("three", "path"), ("four", "method")] and names(f, "imports", 0) == [("a::b",)]


def test_component_files():
    f = facts.facts_of("vue", b'<template><Card/></template>\n<script lang="ts">\nfunction f() { g(); }\n</script>')
    assert names(f, "renders", 0) == [("Card",)] and names(f, "decls", 1) == [("f",)] and names(f, "calls", 0) == [("g",)]
    assert names(facts.facts_of("astro", b"---\nfunction f() {}\n---\n<Top/>"), "decls", 1) == [("f",)]


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / ".gitignore").write_text("# no\n*.log.py\nskip/\n!keep.log.py\n")
    (root / "src/a.py").write_bytes(PY)
    (root / "src/b.py").write_text("from src.a import outer\n\ndef user():\n    return outer(2)\n\ndef again():\n    return user()\n")
    (root / "x.log.py").write_text("a = 1")
    (root / "keep.log.py").write_text("a = 1")
    (root / "skip").mkdir()
    (root / "skip/c.py").write_text("a = 1")
    (root / "notes.txt").write_text("none")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "one")
    (root / "src/b.py").write_text("from src.a import outer\n\ndef user():\n    return outer(3)\n\ndef again():\n    return user()\n")
    run("commit", "-qam", "two")
    return root


def test_repository_to_graph(spark, repo):
    files = repository.walk(spark, str(repo)).cache()
    assert [(r["file_id"], r["path"], r["lang"]) for r in files.orderBy("file_id").collect()] == [(1, "keep.log.py", "python"), (2, "src/a.py", "python"), (3, "src/b.py", "python")]
    found = facts.extract(files)
    symbols = derive.symbols(facts.table(found, "decls"), files).cache()
    by = {r["symbol_id"]: r["name"] for r in symbols.collect()}
    assert sorted(by.values()) == ["Box", "again", "outer", "put", "user"]
    edges = derive.scoped_edges(symbols, facts.table(found, "calls"), facts.table(found, "renders"), facts.table(found, "hooks"))
    assert {(by[r["src"]], by[r["dst"]], r["kind"]) for r in edges.collect()} == {("put", "outer", "References"), ("user", "outer", "References"), ("again", "user", "References")}
    seed = symbols.filter("name = 'outer'").select(F.col("symbol_id").alias("seed"))
    assert {by[r["node"]] for r in graph.callers(graph.graph_edges(edges), seed, 3).collect()} == {"put", "user", "again"}
    text = navigate.read_symbol(symbols, files, "user", mode="signature").first()
    assert text["text"] == "def user():" and not text["stale"]
    assert navigate.read_symbol(symbols, files, "again").first()["text"] == "def again():\n    return user()"
    folded = {r["path"]: r for r in outline.outlines(files, symbols).collect()}["src/a.py"]
    assert "def outer(x){ … 6 lines }" in folded["skeleton"] and folded["kept_lines"] + folded["elided_lines"] == PY.count(b"\n")


def test_history(spark, repo):
    history.register(spark)
    rows = spark.read.format("commits").option("path", str(repo)).load()
    got = rows.groupBy("path").count().orderBy("path").collect()
    assert [(r["path"], r["count"]) for r in got if r["path"].endswith("b.py")] == [("src/b.py", 2)]
    first = subprocess.run(["git", "-C", str(repo), "rev-list", "--max-parents=0", "HEAD"], capture_output=True, text=True).stdout.strip()
    assert [r["path"] for r in spark.read.format("commits").option("path", str(repo)).option("since", first).load().collect()] == ["src/b.py"]
    assert spark.read.format("commits").option("path", str(repo)).option("since", "0" * 40).load().count() == rows.count()
    assert history.diff(str(repo), commit="HEAD") == ([("src/b.py", 4, 4)], ["src/b.py"])
    (repo / "src/a.py").write_bytes(b"import os\n" + PY)
    assert history.diff(str(repo)) == ([("src/a.py", 1, 1)], ["src/a.py"]) or history.diff(str(repo))[1] == ["src/a.py"]
    assert history.blobs(str(repo), "HEAD", ["src/b.py", "none"])[0][0] == "src/b.py"
    hunks = history.commit_hunks(spark, str(repo), rows.select("commit_id").distinct())
    assert hunks.filter("path = 'src/b.py'").count() == 2


def test_history_of_merged_branches(spark, tmp_path):
    """Every commit that leads to HEAD counts, each by its change against its first parent."""
    root = tmp_path / "merged"
    root.mkdir()
    clock = iter(range(1_700_000_000, 1_800_000_000, 60))

    def run(*a):
        when = f"{next(clock)} +0000"
        env = {**os.environ, "GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when}
        subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", f"user.email={a[-1]}@x", *a], check=True, capture_output=True, env=env)

    def commit(path, text, name):
        (root / path).write_text(text)
        run("add", ".")
        run("commit", "-qm", name)

    run("init", "-q", "-b", "trunk")
    commit("m", "1", "a")
    run("checkout", "-qb", "side")
    commit("s", "1", "b")
    commit("s", "2", "b")
    run("checkout", "-q", "trunk")
    commit("m", "2", "a")
    run("merge", "-q", "--no-ff", "side", "-m", "joined")
    commit("m", "3", "a")
    history.register(spark)
    rows = spark.read.format("commits").option("path", str(root)).load().collect()
    assert sorted((r["path"], r["author"] == history.author_key("b@x", "n")) for r in rows) == [("m", False)] * 3 + [("s", False)] + [("s", True)] * 2
    assert [r["ts"] for r in rows] == sorted((r["ts"] for r in rows), reverse=True)
    first = subprocess.run(["git", "-C", str(root), "rev-list", "--max-parents=0", "HEAD"], capture_output=True, text=True).stdout.strip()
    since = spark.read.format("commits").option("path", str(root)).option("since", first).load()
    assert sorted(r["path"] for r in since.collect()) == ["m", "m", "s", "s", "s"]
    assert {r["path"] for r in spark.read.format("commits").option("path", str(root)).option("depth", "1").load().collect()} == {"m"}


def test_patterns_are_checked_where_they_run(spark):
    from weftline.operators.rules import valid_pattern

    assert valid_pattern("(?<x>a)+") == "(?<x>a)+"
    for bad in ("(?P<x>a)", "(", "a{2,1}"):
        with pytest.raises(ValueError):
            valid_pattern(bad)


def test_scoped_resolution(spark):
    schema = "path string, kind string, name string, def_bs long, def_be long, visibility string, attributes array<string>, complexity long"
    decls = [("crates/a/x.rs", "f", 0, 100), ("crates/a/x.rs", "g", 200, 300), ("crates/a/y.rs", "g", 0, 50), ("crates/a/y.rs", "h", 60, 90), ("crates/b/z.rs", "only", 0, 50), ("crates/b/z.rs", "h", 60, 90)]
    files = spark.createDataFrame([(p, 400) for p in {d[0] for d in decls}], "path string, size long")
    symbols = derive.symbols(spark.createDataFrame([(p, "function", n, a, b, "Private", [], 1) for p, n, a, b in decls], schema), files)
    calls = spark.createDataFrame([("crates/a/x.rs", n, s, b, b + 1) for n, s, b in (("g", "free", 10), ("h", "free", 20), ("only", "free", 30), ("only", "method", 40), ("g", "method", 50), ("f", "free", 60), ("none", "free", 70), ("h", "path", 25))], "path string, callee string, shape string, bs long, be long")
    none = spark.createDataFrame([], "path string, name string, bs long, be long")
    name = {r["symbol_id"]: (r["file"][-4:-3], r["name"]) for r in symbols.collect()}
    got = {(name[r["src"]], name[r["dst"]], r["byte_start"]) for r in derive.scoped_edges(symbols, calls, none, none).collect()}
    assert got == {(("x", "f"), ("x", "g"), 10), (("x", "f"), ("y", "h"), 20), (("x", "f"), ("z", "only"), 30)}


def test_occurrence_edges_and_gate(spark):
    symbols = spark.createDataFrame([(1, "a", "x", 0, 50), (2, "b", "x", 60, 90), (3, "c", "y", 0, 50)], "symbol_id long, name string, file string, byte_start long, byte_end long")
    occ = spark.createDataFrame([("x", "A", 1, 2, 1), ("y", "C", 1, 2, 1), ("x", "B", 61, 62, 1), ("x", "C", 10, 11, 8), ("x", "C", 12, 13, 12), ("x", "C", 14, 15, 2), ("y", "A", 5, 6, 0), ("x", "A", 20, 21, 8), ("x", "Z", 20, 21, 8)], "path string, sym string, bs long, be long, roles int")
    rel = spark.createDataFrame([("x", "B", "C", True, True), ("x", "B", "Z", True, False), ("x", "B", "B", True, False)], "path string, from_key string, to_key string, is_impl boolean, is_type boolean")
    got = {(r["src"], r["dst"], r["kind"]) for r in derive.occurrence_edges(symbols, occ, rel).collect()}
    want = {(1, 3, "Reads"), (1, 3, "Writes"), (1, 3, "Imports"), (3, 1, "References"), (2, 3, "Implements"), (2, 3, "TypeOf")}
    assert got == want
    calls = spark.createDataFrame([("x", "c", "free", 30, 31), ("y", "a", "free", 30, 31)], "path string, callee string, shape string, bs long, be long")
    none = spark.createDataFrame([], "path string, name string, bs long, be long")
    files = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, content_hash string")
    indexed = spark.createDataFrame([("x", "1"), ("y", "old")], "path string, indexed_hash string")
    gated = derive.gated_edges(symbols.withColumn("visibility", F.lit("Public")), {"calls": calls, "renders": none, "hooks": none}, occ, rel, files, indexed)
    assert {(r["src"], r["dst"], r["kind"]) for r in gated.collect()} == {(3, 1, "References"), *()} | {(1, 2, "x")} - {(1, 2, "x")}


def test_intervals(spark):
    decls = spark.createDataFrame([(1, "f", 0, 100), (2, "f", 10, 50), (3, "f", 12, 30), (4, "g", 0, 9)], "decl_id long, path string, def_bs long, def_be long")
    sites = spark.createDataFrame([(1, "f", 15, 16), (2, "f", 60, 61), (3, "g", 20, 21), (4, "f", 5, 55)], "site_id long, path string, bs long, be long")
    assert {(r["site_id"], r["decl_id"]) for r in intervals.innermost(sites, decls).collect()} == {(1, 3), (2, 1), (4, 1)}
    marks = spark.createDataFrame([(1, "f", 11, 45), (2, "f", 8, 60), (3, "g", 0, 20)], "mark_id long, path string, bs long, be long")
    assert {(r["mark_id"], r["decl_id"]) for r in intervals.container_or_largest(marks, decls).collect()} == {(1, 2), (2, 1), (3, 4)}
    assert {(r["mark_id"], r["decl_id"]) for r in intervals.next_start(spark.createDataFrame([(1, "f", 9, 10), (2, "f", 11, 11)], "mark_id long, path string, bs long, be long"), decls).collect()} == {(1, 2), (2, 3)}
    text = spark.createDataFrame([(bytearray("é\nab\n\nc".encode()),)], "content binary").withColumn("s", intervals.line_starts(F.col("content")))
    assert text.select("s", *(intervals.line_of(F.col("s"), F.lit(k)) for k in (0, 2, 3, 6, 7))).first()[:] == ([0, 3, 6, 7], 1, 1, 2, 3, 4)
    wide = spark.createDataFrame([("p", 1, 2000)], "path string, start_line int, end_line int")
    ranges = spark.createDataFrame([(k, "p", 100 * k, 100 * k + 300) for k in range(30)], "symbol_id long, path string, first_line int, last_line int")
    assert intervals.overlaps(wide, ranges).count() == 21


@pytest.mark.parametrize("find", [intervals.innermost, intervals.container_or_largest])
def test_a_place_is_looked_up_once(spark, monkeypatch, find):
    """Many marks at one place and many declarations of one span are not paired with each other."""
    decls = spark.createDataFrame([(n, "f", 10 * (n % 3), 100 - n % 3) for n in range(300)], "decl_id long, path string, def_bs long, def_be long")
    marks = spark.createDataFrame([(n, "f", *[(15, 20), (25, 30), (5, 6)][n % 3]) for n in range(200)], "mark_id long, path string, bs long, be long")
    paired = []
    first = intervals.first_match
    monkeypatch.setattr(intervals, "first_match", lambda rows, keys, order: paired.append(rows.count()) or first(rows, keys, order))
    got = {r["mark_id"]: r["decl_id"] for r in find(marks, decls, "mark_id").collect()}
    assert got == {n: [1, 2, 0][n % 3] for n in range(200)}
    assert sum(paired) <= 9


def test_scip_symbols():
    a = occurrences.parse("scip-x cargo my  pkg 1.0 `a/b`/Type#run(+1).")
    assert (a.package, a.descriptors) == ("my pkg", (("a/b", "namespace", None), ("Type", "type", None), ("run", "method", "+1")))
    assert occurrences.parse("s . . . `plain`#").id == occurrences.parse("s . . . plain#").id and occurrences.parse("s . . . x#").manager is None
    assert occurrences.parse("local 3").scheme == "local"
    for bad in ("", "s . .", "s . . . ", "s . . . a", "local a b", "s . . . [a", "s . . . a("):
        with pytest.raises(ValueError):
            occurrences.parse(bad)
    assert [occurrences.byte_place("é😀x".encode(), c, e) for c, e in ((1, "utf16"), (3, "utf16"), (2, "utf32"), (3, "utf8"), (99, "utf16"))] == [2, 6, 6, 3, 7]


def test_visibility_and_attributes(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for lang, text, want in (("rust", "pub", "Public"), ("rust", "pub(crate)", "Restricted"), ("rust", "", "Private"), ("java", "@A public static", "Public"), ("kotlin", "internal", "Restricted"), ("csharp", "republic", "Unknown"), ("typescript", "export default", "Public"), ("c", "static", "Private"), ("go", "x", "Unknown")):
        assert one(rules.visibility(lang, F.lit(text))) == want
    for text, want in (("#[tokio::test(flavor)]", "tokio::test"), ("@pytest.fixture(x)", "pytest.fixture"), ("[Fact]", "Fact"), ("#![no_std]", "no_std")):
        assert one(rules.attribute_name(F.lit(text))) == want


def test_globs_and_cursors():
    import re

    for glob, yes, no in (("*.rs", "a/b.rs", "a.rsx"), ("src/**/x", "src/x", "lib/x"), ("a?c", "abc", "ac"), ("[ab].py", "a.py", "c.py"), ("*.{ts,tsx}", "x.tsx", "x.js")):
        assert re.match(glob_regex(glob), yes) and not re.match(glob_regex(glob), no)
    with pytest.raises(ValueError):
        glob_regex("{a")
    c = encode_cursor(3, [5, 0])
    assert decode_cursor(c, 3, 2) == [5, 0]
    for text, revision, lists in ((c, 4, 2), (c, 3, 1), ("zz", 3, 2), (c[:-2], 3, 2), ("", 3, 2)):
        with pytest.raises(ValueError):
            decode_cursor(text, revision, lists)
    mark = paths_fingerprint(["a", "b"])
    assert mark == paths_fingerprint(["b", "a"]) and decode_cursor(encode_cursor(1, [2], mark), 1, 1, mark) == [2]
    with pytest.raises(ValueError):
        decode_cursor(encode_cursor(1, [2], mark), 1, 1, paths_fingerprint(["c"]))


def test_pages(spark):
    from weftline.functions import paging

    df = spark.range(5)
    first = paging.page(df, ["id"], 2, noun="rows")
    assert [r[0] for r in first["rows"]] == [0, 1] and first["total"] == 5 and first["note"].startswith("Showing 2 of 5 rows")
    last = paging.page(df, ["id"], 3, first["next_cursor"])
    assert [r[0] for r in last["rows"]] == [2, 3, 4] and last["next_cursor"] is None
    assert paging.page(df, ["id"], 0) == {"rows": [], "total": 5, "next_cursor": None, "note": ""}
    two = paging.pages({"a": (df, ["id"]), "b": (df.limit(1), ["id"])}, 2)
    again = paging.pages({"a": (df, ["id"]), "b": (df.limit(1), ["id"])}, 2, two["next_cursor"])
    assert len(again["a"]) == 2 and again["b"] == []


def test_rules_file():
    r = rules_file.parse('[[layer]]\nname="ui"\nglobs=["ui/**"]\n[[layer]]\nname="core"\nglobs="core/*"\n[[rule]]\nforbid=["ui","core"]\n[thresholds]\nmax_instability=0.8')
    assert (r.layers, r.forbidden, r.max_cycles, r.max_instability) == ((("ui", "ui/**"), ("core", "core/*")), (("ui", "core"),), 0, 0.8)
    for bad in ("x =", "[[layer]]\nname='a'", "[[rule]]\nforbid=['a','b']"):
        with pytest.raises(ValueError):
            rules_file.parse(bad)


def test_outline_folding():
    text = b"import a\n\n// says\npub fn long(x) {\n  1\n  2\n  3\n}\nfn short() { 1 }\nstruct S {\n  fn m() {\n    1\n    2\n    3\n  }\n}\n"
    parts = [("long", "function", text.index(b"pub"), text.index(b"fn short") - 1, "Public"), ("short", "function", text.index(b"fn short"), text.index(b"struct") - 1, "Private"), ("S", "struct", text.index(b"struct"), len(text) - 1, "Private"), ("m", "function", text.index(b"fn m"), text.rindex(b"}\n}") + 1, "Public")]
    got = outline.fold(text, parts, "rust")
    assert got["skeleton"] == "import a\n\n// says\npub fn long(x) { … 4 lines }\nfn short() { 1 }\nstruct S {\n  fn m() { … 4 lines }\n}"
    assert got["kept_lines"] + got["elided_lines"] == text.count(b"\n") and got["symbols"][0] == ("long", "function", 4, 8, 4, True)
    public = outline.fold(text, parts, "rust", private=False)
    assert [s[0] for s in public["symbols"]] == ["long", "S", "m"] and public["kept_lines"] + public["elided_lines"] == text.count(b"\n")
    capped = outline.fold(text, parts, "rust", top=1)
    assert [s[0] for s in capped["symbols"]] == ["long"] and capped["skeleton"].endswith("// … 2 more symbols elided (max_symbols=1)")
    gap = b"\n".join(b"line %d" % k for k in range(12))
    assert outline.fold(gap, [])["skeleton"] == "// … 12 lines elided"
