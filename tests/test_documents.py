import pytest

from weftline.plans import documents


@pytest.fixture(scope="module")
def project(spark):
    rows = [
        (1, "a", "function", "crates/x/src/domain/a.rs", "Private", 3),
        (2, "b", "function", "crates/x/src/adapters/b.rs", "Public", 2),
        (3, "c", "function", "crates/y/src/adapters/c.rs", "Private", 5),
        (4, "d", "function", "crates/y/tests/d.rs", "Private", 1),
    ]
    symbols = spark.createDataFrame([(*r[:4], r[4], [], r[5], "rust") for r in rows], "symbol_id long, name string, kind string, file string, visibility string, attributes array<string>, complexity long, lang string")
    edges = spark.createDataFrame([(1, 2, "Calls"), (2, 3, "Calls"), (3, 1, "Calls"), (4, 1, "Calls")], "src long, dst long, kind string")
    churn = spark.createDataFrame([("crates/x/src/domain/a.rs", 4), ("crates/y/src/adapters/c.rs", 2)], "path string, commits long")
    return symbols, edges, churn


def test_doc_for_a_symbol(project):
    got = documents.doc_for(*project, "a")
    assert (got["role"], got["must"], got["may"], got["references"], got["file_risk"]) == ("function in the x domain layer", 2, 1, ["c"], 0.6)
    with pytest.raises(LookupError):
        documents.doc_for(*project, "none")


def test_doc_for_a_module(project):
    text = documents.doc_for_module(*project, "crates/x/src/domain/a.rs")
    assert "## Callers\n\n- `c` (1)\n- `d` (1)" in text and "in 2, out 1" in text and "`a` in cycle 1" in text and text.endswith("0.60")
    with pytest.raises(LookupError):
        documents.doc_for_module(*project, "none")


def test_doc_for_the_project(project):
    text = documents.doc_for_project(*project, core_crate="x")
    assert "2 crates, 2 layers, 4 symbols, 3 edges; rust." in text or "2 crates, 2 layers" in text
    assert "`a` to `b`: domain to adapter" in text and "`b` to `c`: core to other crate" in text and "- 3 symbols: 1, 2, 3" in text
    assert {tuple(r) for r in documents.crate_edges(*project[:2]).collect()} == {("x", "y"), ("y", "x")}


def test_digest_and_diagram(project):
    symbols, edges, _ = project
    assert documents.digest(symbols, edges, 4, "x" * 700).splitlines()[0] == "4 files, 4 symbols, 4 edges" and documents.digest(symbols, edges, 4, "x" * 700).endswith("x" * 600)
    svg = documents.diagram(["a", "b<", "c"], [("a", "b<"), ("a", "c")], {"a": 1}, 2)
    assert svg.count("<rect") == 2 and "1 more not shown" in svg and "b&lt;" in svg and svg.count("<line") == 1
    assert documents.slug("A b::C!") == "a-b-c"
