import hashlib
import random

import duckdb
import numpy as np
import pytest

from weftline.llm import substrings


def brute(rows, window):
    """doc_id -> (n_words, n_removed, digest), for different ids."""
    words = {d: (t or "").encode().split() for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = {k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for k in range(i, i + window)}
        left = [x for k, x in enumerate(w) if k not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


@pytest.mark.parametrize("window,gram", [(5, 2), (9, 3), (12, 8), (50, 8)])
def test_against_brute_force(spark, docs_of, words, window, gram):
    r = random.Random(window)
    shared = [r.choices(words, k=r.randint(window - 1, window * 3)) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "the " * (window + 5)), (4, "the " * (window + 2)), (5, " ".join(words[:window]))]
    for d in range(10, 40):
        part = []
        for _ in range(r.randint(0, 3)):
            part += r.choices(words, k=r.randint(0, window)) + (r.choice(shared) if r.random() < 0.6 else [])
        rows.append((d, r.choice([" ", "  ", "\n"]).join(part)))
    rows += [(50, rows[10][1]), (51, rows[12][1])]
    r.shuffle(rows)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substrings.removed(docs_of(rows, True), window=window, gram=gram).collect()}
    assert got == brute(rows, window)


def test_repeated_rows_and_no_ids(spark, docs_of):
    text, other = " ".join(map(str, range(60))), " ".join(map(str, range(100, 170)))
    rows = [(1, text), (2, text), (2, text), (2, other), (3, other), (None, text)]
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substrings.removed(docs_of(rows)).collect())
    assert got == [(-1, 60, 0), (1, 60, 0), (2, 60, 60), (2, 60, 60), (2, 70, 0), (3, 70, 70)]
    assert substrings.removed(docs_of([])).count() == 0


def test_stage_keeps_columns_and_layout(spark, docs_of):
    text = " ".join(map(str, range(60)))
    rows = [(1, f"x\ny  z {text}"), (2, f"keep\nthis {text} and\n this"), (3, text), (4, "short"), (5, None)]
    docs = docs_of(rows, True)
    out = substrings.cut_repeats(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: rows[0][1], 2: "keep\nthis\nand\n this", 4: "short", 5: None}


def test_subtree_keeps_what_a_lesser_document_has():
    path = [np.array([1, 1, 1, 1, 2]), np.array([1, 1, 2, 2, 5])]
    assert substrings.subtree([*path, np.array([1, 1, 3, 3, 4])], np.array([4, 1, 2, 2, 7])).tolist() == [0]
    assert substrings.subtree([*path, np.array([1, 2, 3, 4, 4])], np.array([4, 1, 2, 3, 7])).tolist() == []
    assert substrings.subtree([np.array([], np.int64)], np.array([], np.int64)).tolist() == []


def test_subtree_against_brute_force():
    r = np.random.default_rng(9)
    for _ in range(200):
        n = int(r.integers(1, 30))
        path = [r.integers(0, 3, n) for _ in range(3)]
        order = np.lexsort(path[::-1])
        path, doc = [p[order] for p in path], r.integers(0, 5, n)
        rows = list(zip(*(p.tolist() for p in path)))
        want = [i for i in range(n) if any(rows[j] == rows[i] and doc[j] < doc[i] for j in range(n))]
        assert substrings.subtree(path, doc).tolist() == want


@pytest.mark.parametrize("size", [1, 4, 30, 1000])
def test_overfull_groups_take_longer_prefixes(spark, docs_of, words, size):
    """Passages that many documents share, of which some have only the first 8, 16 or 32 words in common."""
    r = random.Random(size)
    common = r.choices(words, k=70)
    rows = [(0, " ".join(common))]
    for d in range(1, 25):
        n = r.choice([8, 12, 20, 40, 49, 50, 55, 70])
        rows.append((d, " ".join(r.choices(words, k=5) + common[:n] + r.choices(words, k=45))))
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substrings.removed(docs_of(rows), size=size).collect()}
    assert got == brute(rows, 50)


def test_stage_takes_any_column_names(spark, docs_of):
    text = " ".join(map(str, range(60)))
    docs = docs_of([(1, text), (2, "own " + text)])
    from pyspark.sql import functions as F

    for c in ("_left", "_id", "_key", "left", "key", "row", "_salt", "_hot", "n", "a.b", "pos"):
        docs = docs.withColumn(c, F.lit(c))
    out = substrings.cut_repeats(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["left"], r["a.b"]) for r in out.collect()} == {1: (text, "left", "a.b"), 2: ("own", "left", "a.b")}


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    got = substrings.op9_substrings(spark, folder)
    assert {tuple(r) for r in got.collect()} == set(con.execute(substrings.OP9_SQL).fetchall())
