import itertools
import random

import numpy as np
import pytest
import xxhash

from weftline.llm import simhash
from weftline.llm.components import components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def unite(nodes, links):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", " \n", "one", "One TWO", "ÀB c\td\x0be", "a a a a a", "x " * 500 + "end", None])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_index_finds_all(seed=2):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 63, 40, np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << r.integers(0, 64, 40, np.uint64)) for _ in range(8))]))
    rank = fps.copy()
    for n in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(n)
    fps = fps[np.argsort(rank)]
    got = {(int(a), int(b)) for q, n in simhash.GrayIndex(fps).search(fps, 2) for a, b in zip(q, n)}
    assert got == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2}
    label = unite(range(len(fps)), simhash.spanning(fps, 2))
    assert label == unite(range(len(fps)), [(a, b) for a, b in got if a != b])


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_links_are_complete(spark, bucket):
    r = random.Random(4)
    fps = {0, 1, 3}
    for _ in range(25):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(4):
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 3)))
            fps.add(x)
    x = r.getrandbits(64)  # a dense group, which small buckets must deal again
    fps |= {x ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(8), 2)}
    fps = sorted(fps)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    got = simhash.links(spark.createDataFrame(rows, "fp long, id long"), 2, bucket).collect()
    want = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert unite(range(len(fps)), [tuple(x) for x in got]) == unite(range(len(fps)), want)
    assert len(got) <= 6 * 9 * len(fps)


def test_upper_nodes_lead_to_every_link(spark):
    """All links come through the index: the ranges it routes to hold every partner, and whole ranges are left out."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 3000, np.uint64)
    fps = np.unique(np.concatenate([base, base[:500] ^ np.uint64(5 << 40), base[500:900] ^ np.uint64(1)]))
    df = spark.createDataFrame([(f, k) for k, f in enumerate(fps.view(np.int64).tolist())], "fp long, id long")
    ranked = df.select("fp", "id", simhash.gray_rank(df["fp"]).alias("rank"))
    top = simhash.upper(ranked)
    rows = ranked.collect()
    rank = np.array([x["rank"] for x in rows])
    home = top.home(rank)
    assert 200 < len(top.names) <= simhash.SUBTREES
    routed = {(int(q), int(n)) for qs, ns in top.routes(fps, home, 2) for q, n in zip(qs, ns)}
    assert len(routed) < 0.3 * len(fps) * len(top.names)
    assert top.index.visited < len(fps) * len(top.names)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2).tolist():
            assert (i, max(home[i], home[j])) in routed or (j, max(home[i], home[j])) in routed
    got = simhash.links(df).collect()
    want = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2) if i < j]
    assert unite(range(len(fps)), [tuple(x) for x in got]) == unite(range(len(fps)), want)


def test_index_prunes_whole_groups():
    r = np.random.default_rng(8)
    fps = np.unique(r.integers(0, 1 << 63, 5000, np.uint64))
    rank = fps.copy()
    for n in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(n)
    fps = fps[np.argsort(rank)]
    index = simhash.GrayIndex(fps)
    found = [(int(a), int(b)) for q, n in index.search(fps[:50], 2) for a, b in zip(q, n)]
    assert set(found) >= {(k, k) for k in range(50)} and index.visited < 50 * 1500


def test_components(spark):
    r = random.Random(6)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == unite(nodes, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows(spark, docs_of):
    rows = [(5, "a b c d"), (3, "A B C D"), (9, None), (7, ""), (2, "quite another text of words"), (3, "A B C D"), (None, "a b c d")]
    got = simhash.near_duplicates(docs_of(rows, True)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == [(-1, 3), (2, 2), (3, 3), (3, 3), (5, 3), (7, 7), (9, 7)]
    kept = simhash.deduplicated(docs_of(rows, True))
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 3, 3, 7] and kept.columns == docs_of(rows, True).columns
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_query_against_brute_force(spark):
    got = simhash.op10_simhash(spark, "/root/testdata/sf0.001").collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    fp = {d: plain_fingerprint(t) for d, t in text.items()}
    want = unite(fp, [(a, b) for a, b in itertools.combinations(sorted(fp), 2) if (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{fp[d]:016x}", want[d]) for d in fp}
