import random

import pytest

from weftline.llm import decontaminate as d


def nearest(item, text):
    """Least edits of item against any part of text."""
    last = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(last[j - 1] + (c != t), last[j] + 1, now[-1] + 1))
        last = now
    return min(last)


@pytest.mark.parametrize("alphabet", ["ab ", "abcdefgh "])
def test_finds_exactly_what_is_within_the_budget(alphabet):
    r = random.Random(len(alphabet))
    for _ in range(300):
        item = d.normal("".join(r.choices(alphabet, k=r.randint(1, 80))))
        if not item:
            continue
        e = d.budget(len(item))[0]
        assert e == int(len(item) * d.RATE)
        part = list(item)
        for _ in range(r.randint(0, e + 2)):
            k = r.randrange(len(part))
            if (kind := r.random()) < 0.4:
                part[k] = r.choice(alphabet)
            elif kind < 0.7:
                part.insert(k, r.choice(alphabet))
            elif len(part) > 1:
                del part[k]
        text = d.normal("".join(r.choices(alphabet, k=r.randint(0, 120))) + "".join(part) + "".join(r.choices(alphabet, k=r.randint(0, 60))))
        found = d.Items([(1, item)]).find(text)
        want = nearest(item, text)
        assert bool(found) == (want <= e)
        if found:
            assert found[0][3] == want and nearest(item, text[found[0][1] : found[0][2]]) == want


def test_long_texts_are_read_in_parts():
    item = "a passage of the benchmark that is long enough to be found"
    old, d.PART = d.PART, 100
    try:
        text = "x y z " * 15 + item.upper() + " q" * 300 + item
        assert d.Items([(4, item)]).find(text)[0][3] == 0
    finally:
        d.PART = old


def test_parts_of_the_hits_give_the_same(monkeypatch):
    r = random.Random(3)
    items = d.Items([(k, "".join(r.choices("ab", k=r.randint(5, 60)))) for k in range(20)])
    texts = ["".join(r.choices("ab", k=300)) for _ in range(20)]
    want = [items.find(t) for t in texts]
    assert any(want)
    monkeypatch.setattr(d, "HITS", 7)
    assert [items.find(t) for t in texts] == want
    assert [items.any(t) for t in texts] == [bool(w) for w in want]


def test_runs_of_one_character_stay_in_memory():
    """Long runs of one character against items with a run of it, under 2 GB."""
    import subprocess
    import sys

    code = """
import resource, random
from weftline.llm import decontaminate as d
r = random.Random(1)
plain = lambda: "".join(r.choices("bcdefgh", k=60))
items = d.Items([(k, plain() + "a" * 400 + plain()) for k in range(5)])
assert items.find("a" * 200_000) == []
found = d.Items([(7, "a" * 400)]).find("x " + "a" * 1_000_000)
assert [f[0] for f in found] == [7] and found[0][3] == 0
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 2_000_000
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_rows(spark, docs_of):
    items = [(1, "The  Benchmark passage, with\nsome more words in it"), (2, None), (3, ""), (4, "tiny"), (4, "tiny")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "before THE benchmark passage, with some mare words in it after"), (2, None), (3, ""), (4, "a tiny one"), (5, "clean text"), (5, "clean text")]
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in d.matches(docs_of(rows, True), bench).distinct().collect())
    assert got == [(1, 1, 1), (4, 4, 0)]
    assert sorted(r["doc_id"] for r in d.clean(docs_of(rows, True), bench).collect()) == [2, 3, 5, 5]
    assert d.matches(docs_of(rows), bench.limit(0)).count() == 0 and d.clean(docs_of(rows), bench.limit(0)).count() == 6
    assert d.matches(docs_of([]), bench).count() == 0
    # a benchmark in several blocks gives the same
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in d.matches(docs_of(rows), bench, block=20).distinct().collect()) == got


def test_query_finds_every_planted_passage(spark):
    folder = "/root/testdata/sf0.01"
    got = {(r["doc_id"], r["item_id"]) for r in d.op6_decontaminate(spark, folder).collect()}
    bench = [(r["item_id"], d.normal(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], d.normal(r["text"])) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert {(a, i) for a, t in docs for i, b in bench if b in t} <= got
    text, item = dict(docs), dict(bench)
    assert all(nearest(item[i], text[a]) <= d.budget(len(item[i]))[0] for a, i in got)
