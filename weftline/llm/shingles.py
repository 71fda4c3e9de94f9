"""Near copies by Jaccard similarity of word shingle sets: SimHash fingerprints of the sets find candidates, whole sets decide.

A set's fingerprint has WORDS words of 64 bits. Two sets of similarity s agree on a bit with chance 1 - acos(2 s / (1 + s)) / pi,
0.848 at 0.8. Each of several tables samples some of the bits; fingerprints that agree on all of a table's bits are its
bucket, under one upper node of a Gray-ordered index, and a search below it adds up the differences of the first SEARCHED
words and leaves groups beyond LIMIT. Tables are as many as miss a pair at the similarity with chance MISSED if it differs
in as many bits as such pairs do on average, and their bits grow with the logarithm of the number of sets, so buckets of
unlike sets stay small at every size. What the searches link is a
candidate group. Within it, sets are compared whole, so no pair below the similarity is linked."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import mapped, text_bytes, written
from weftline.llm.components import components, labels, roots
from weftline.llm.simhash import GrayIndex, gray_rank

SIZE, SEED = 5, 42
#: Least similarity of near copies, as a fraction.
SHARED, OF = 4, 5
#: 64-bit words of a fingerprint; the chance that no table has a pair of that similarity in one bucket.
WORDS, MISSED = 4, 0.001
#: Words that a search compares, and differing bits of a candidate pair: one at the similarity differs in 19 of 128 on
#: average, with a deviation of 4; unlike sets in 64, with one of 6.
SEARCHED, LIMIT = 2, 33
#: Members of a candidate group that are compared in one place, and shingles of theirs.
BUCKET, HELD = 8192, 1 << 22
#: Shingles whose bits are summed at once.
PIECE = 4096
#: Rows of (set, table) in a range.
RANGE = 400_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's lower-case word shingles; a text of fewer words is one shingle, one of none has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    return np.unique(np.fromiter([digest(whole[a:b], SEED) for a, b in zip(starts, ends[min(size, len(words)) - 1 :].tolist())], np.uint64, n))


def wide(found: np.ndarray) -> np.ndarray:
    """SimHash of a set of 64-bit hashes: WORDS words."""
    total = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(found), PIECE):
        h = found[k : k + PIECE, None] * _MIX
        h = (h ^ (h >> np.uint64(32))) * _MIX[::-1]
        h ^= h >> np.uint64(29)
        total += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * total > len(found)).view(np.uint64)


def tables(n: int) -> np.ndarray:
    """The bits that each table samples, for n sets."""
    size = max(16, math.ceil(math.log2(max(n, 1))) - 2)
    s = SHARED / OF
    alike = (1 - math.acos(2 * s / (1 + s)) / math.pi) ** size
    r = np.random.default_rng(SEED)
    return np.array([r.choice(64 * WORDS, size, replace=False) for _ in range(math.ceil(math.log(MISSED) / math.log(1 - alike)))])


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Positions (i, j) that join what is linked among non-empty sets. A set is compared with those no link has reached yet."""
    sizes = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(code, np.cumsum(sizes)[:-1])
    mark = np.zeros(int(code.max()) + 1, bool)
    left, out, todo = np.arange(len(sets)), [], []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
            code = code[sizes[todo[0]] :]
            continue
        x = todo.pop()
        mark[own[x]] = True
        n = sizes[left]
        shared = np.add.reduceat(mark[code], np.cumsum(n) - n, dtype=np.int64)
        mark[own[x]] = False
        near = (SHARED + OF) * shared >= SHARED * (n + sizes[x])
        if near.any():
            out += [(x, y) for y in left[near].tolist()]
            todo += left[near].tolist()
            left, code = left[~near], code[np.repeat(~near, n)]
    return out


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, whole, n, w0, w1, ...) of each row: whole is a 128-bit hash of the shingle set, n its size, w its fingerprint."""

    def work():
        def step(rows):
            found = [shingles(t) for t in rows["text"]]
            fps = np.array([wide(s) for s in found]).reshape(len(found), WORDS).view(np.int64)
            return {"doc_id": rows["doc_id"], "whole": [xxhash.xxh3_128_digest(s.tobytes()) for s in found], "n": list(map(len, found))} | {f"w{k}": fps[:, k] for k in range(WORDS)}

        return step

    kind = "doc_id long, whole binary, n long, " + ", ".join(f"w{k} long" for k in range(WORDS))
    return mapped(docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text)), work, kind)


def candidates(fps: DataFrame, n: int) -> DataFrame:
    """fps: n rows (id, w0, w1, ...). (a, b): ids whose closure puts candidate pairs into one group. Rows are dealt by ranges of
    (table, bucket, Gray rank). A bucket within one range is searched; one that several ranges share, be it large or at a
    range's end, is one group as it is, so no task holds more than its range."""
    picks = tables(n)
    words = [f"w{k}" for k in range(WORDS)]
    ways, size = picks.shape
    weight = np.int64(1) << np.arange(size, dtype=np.int64)

    def deal(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                fp = np.stack([part[w].to_numpy() for w in words], axis=1)
                bits = np.unpackbits(fp.view(np.uint8).reshape(len(fp), -1), axis=1)
                key = (bits[:, picks].astype(np.int64) * weight).sum(axis=2)
                who = np.repeat(np.arange(len(fp)), ways)
                cols = [np.tile(np.arange(ways, dtype=np.int32), len(fp)), key.ravel(), part["id"].to_numpy()[who], *(fp[who, k] for k in range(SEARCHED))]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["way", "bits", "id", *words[:SEARCHED]])

    def search(batches):
        """Links within buckets (cut null), and for the range's first and last bucket each member with its first."""
        held = [[b[c].to_numpy() for c in ("way", "bits", "id", *words[:SEARCHED])] for b in batches if b.num_rows]
        if not held:
            return
        way, bits, ids, *fp = (np.concatenate(x) for x in zip(*held))
        fp = np.stack(fp, axis=1).view(np.uint64)
        start = np.flatnonzero(np.concatenate([[True], (way[1:] != way[:-1]) | (bits[1:] != bits[:-1])]))
        end = np.append(start[1:], len(way))
        for c in sorted({0, len(start) - 1}):
            who = ids[start[c] : end[c]]
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.full(len(who), who.min())), pa.array(np.full(len(who), way[start[c]])), pa.array(np.full(len(who), bits[start[c]]))], names=["a", "b", "way", "bits"])
        last = np.repeat(end, end - start)
        label, n = np.arange(len(ids)), np.arange(len(ids))
        for i, j in GrayIndex(fp).search(fp, LIMIT, n + 1, last):
            label = labels(label, i, j)
        label = roots(label)
        at = np.flatnonzero(label != n)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]]), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.int64())], names=["a", "b", "way", "bits"])

    kind = ", ".join(["way int, bits long, id long", *(f"{w} long" for w in words[:SEARCHED])])
    rows = fps.select("id", *words).mapInArrow(deal, kind).withColumn("rank", gray_rank(F.col("w0")))
    parts = max(1, -(-n * ways // RANGE))
    rows = rows.repartitionByRange(parts, "way", "bits", "rank").sortWithinPartitions("way", "bits", "rank", "id").drop("rank")
    found = written(rows.mapInArrow(search, "a long, b long, way int, bits long"), "candidates")
    shared = found.filter("way is not null")
    several = shared.groupBy("way", "bits").agg(F.min("b").alias("least"), F.max("b").alias("most")).filter("least < most").select("way", "bits", "least")
    return found.filter("way is null").select("a", "b").unionAll(shared.join(several, ["way", "bits"]).select("a", F.col("least").alias("b")))


def _linked(rows: DataFrame) -> DataFrame:
    """rows: group, p, q, id, shingles. Links (a, b) of ids in each (group, p, q)."""
    keys = ("group", "p", "q")

    def run(batches):
        shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        ids, sets, now = [], [], None

        def told():
            out = forest(sets) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in out], pa.int64()), pa.array([ids[j] for _, j in out], pa.int64())], schema=shape)

        for batch in batches:
            for *key, one, found in zip(*(batch[c].to_pylist() for c in (*keys, "id", "shingles"))):
                if key != now:
                    if len(sets) > 1:
                        yield told()
                    ids, sets, now = [], [], key
                ids.append(one)
                sets.append(np.frombuffer(found, np.uint64))
        yield told()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "id", "shingles").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, least: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """least: (whole, id, n, w0, ...), whole distinct. (a, b): ids whose closure links all sets of the similarity or more that
    lie in one candidate group. A group above `bucket` members, or HELD shingles, is dealt to pairs of parts, so that each
    pair of its members still meets."""
    fps = least.filter("n > 0")
    group = written(components(candidates(fps, fps.count())), "groups")
    size = group.join(least.select(F.col("id").alias("node"), "n"), "node").groupBy("component").agg(F.ceil(F.greatest(F.count("*") / bucket, F.sum("n") / HELD)).cast("int").alias("parts"))
    rows = least.join(group, F.col("id") == F.col("node")).join(size, "component")
    rows = rows.withColumn("_p", F.pmod(F.xxhash64("whole"), F.col("parts")).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = written(rows.select(F.col("component").alias("group"), F.least("_p", "_q").alias("p"), F.greatest("_p", "_q").alias("q"), "id", "whole"), "members")

    def work():
        def step(part):
            found = [shingles(t) for t in part["text"]]
            return {"whole": [xxhash.xxh3_128_digest(s.tobytes()) for s in found], "shingles": [s.tobytes() for s in found]}

        return step

    plain = docs.select(F.col(doc_id).alias("id"), text_bytes(text)).join(rows.select("id").distinct(), "id", "left_semi")
    sets = mapped(plain, work, "whole binary, shingles binary", 64).dropDuplicates(["whole"])
    return _linked(rows.join(sets, "whole"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """docs with one document of each component of near copies: that of least doc_id (rows that share it or have none stay). Rows
    without a word (null, empty, blank) are copies of one another. Repeated rows are one set. All columns stay as they are,
    whatever their names. Empty docs: no rows."""
    found = written(sketches(docs, doc_id, text), "sketches")
    least = written(found.groupBy("whole").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n", *(f"w{k}" for k in range(WORDS))))), "sets")
    found = components(links(docs, least.filter("id is not null"), doc_id, text, bucket))
    kept = least.join(found.withColumnRenamed("node", "id"), "id", "left").filter("component is null or component = id").select(F.col("id").alias("_kept"))
    kept = kept.unionAll(docs.sparkSession.range(1).select(F.lit(None).cast("long"))).distinct()
    return docs.join(kept, docs[doc_id].eqNullSafe(kept["_kept"]), "left_semi")
