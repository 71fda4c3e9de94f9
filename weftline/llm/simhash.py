"""SimHash near-duplicates found through Gray-ordered hierarchical indexes.

Fingerprints are sorted by Gray rank. An index node keeps the bit pattern that all fingerprints below it share, less what
the nodes above it hold already; a search adds up the differences on the way down and leaves whole groups as soon as they
exceed the limit. Over a corpus the order is cut into ranges: each range is a subtree, and the patterns shared by ranges
are the index's upper nodes, which every task has. A fingerprint goes to the subtrees that the upper nodes leave, and only
to its own and later ones, so that each pair meets once. No range depends on a key's frequency, nothing is cut off, and a
task returns a spanning forest of its links, never all pairs. At most 2080 fingerprints are within two bits of one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import keyed_join, mapped, table, text_bytes, written
from weftline.llm.components import components, labels, roots

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: Subtrees, at least, and the fingerprints that one takes before there are more subtrees.
SUBTREES, BUCKET = 256, 1 << 22
#: Children of an index node.
FAN = 8
#: Words of (query, node) pairs held at once, and visitors of a subtree that are looked up at once.
FRONTIER, VISITORS = 1 << 18, 1 << 16


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats counted; no word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = words[k : min(n, k + (1 << 16)) + size - 1]
        m = max(1, len(part) - size + 1)
        whole = b" ".join(part)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[:m].tolist()
        h = np.fromiter([digest(whole[a:b], SEED) for a, b in zip(starts, ends[min(size, len(part)) - 1 :].tolist())], np.uint64, m)
        total += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): one row for each row of docs; fp is the signed form of the 64 bits. Null and blank texts have fp 0."""

    def work():
        def step(rows):
            fp = np.array([fingerprint(t) for t in rows["text"]], np.uint64).view(np.int64)
            return {"doc_id": rows["doc_id"], "fp": fp}

        return step

    return mapped(docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text)), work, "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in the reflected Gray code (the prefix parity of its bits), as a long of the same order."""
    for n in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, n))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Tree over patterns that are sorted by Gray rank: an array of 64-bit words, or rows of several. A node keeps, of the bits
    that all patterns below it agree on, those that its parent lacks; the leaves keep the rest. `same` marks the bits that
    hold for a pattern (all without it). `visited` counts the nodes that searches have looked at."""

    def __init__(self, fps: np.ndarray, same: np.ndarray | None = None, fan: int = FAN):
        self.fan, self.visited = fan, 0
        value = fps.reshape(len(fps), -1)
        same = np.full(value.shape, ~np.uint64(0)) if same is None else same.reshape(value.shape)
        self.value, self.same = [value], [same]
        while len(value) > 1:
            starts = np.arange(0, len(value), fan)
            low = np.bitwise_and.reduceat(value, starts)
            differ = low ^ np.bitwise_or.reduceat(value, starts)
            same = np.bitwise_and.reduceat(same, starts) & ~differ
            value = low
            self.value.append(value)
            self.same.append(same)
        self.mask = [s if k + 1 == len(self.same) else s & ~self.same[k + 1][np.arange(len(s)) // fan] for k, s in enumerate(self.same)]

    def search(self, queries: np.ndarray, limit: int, first: np.ndarray | None = None, last: np.ndarray | None = None):
        """Yields arrays (query position, pattern position) of all within `limit` bits, in pieces of bounded size. Of a query,
        only patterns from `first` up to before `last` count, and the search starts at the least nodes that cover these."""
        queries = queries.reshape(len(queries), -1)
        n = len(self.value[0])
        first = np.zeros(len(queries), np.int64) if first is None else first
        last = np.full(len(queries), n) if last is None else last
        todo = []
        # of its level, the nodes over a query's span are at most fan + 1
        level = np.zeros(len(queries), np.int64)
        for k in range(1, len(self.value)):
            level[last - first > self.fan**k] = k
        for k in np.unique(level).tolist():
            q = np.flatnonzero((level == k) & (last > first))
            low = first[q] // self.fan**k
            many = (last[q] - 1) // self.fan**k - low + 1
            ends = np.cumsum(many)
            node = np.repeat(low - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)
            todo.append((k, np.repeat(q, many), node, None))
        room = max(64, FRONTIER // queries.shape[1])
        while todo:
            k, q, node, gone = todo.pop()
            if len(q) > room:
                cut = len(q) // 2
                todo += [(k, q[:cut], node[:cut], gone if gone is None else gone[:cut]), (k, q[cut:], node[cut:], gone if gone is None else gone[cut:])]
                continue
            self.visited += len(q)
            whole = self.same if gone is None else self.mask  # a search that starts here counts what the nodes above hold too
            far = np.bitwise_count((queries[q] ^ self.value[k][node]) & whole[k][node]).sum(axis=1, dtype=np.int16)
            gone = far if gone is None else gone + far
            near = gone <= limit
            q, node, gone = q[near], node[near], gone[near]
            if not len(q):
                continue
            if k == 0:
                yield q, node
                continue
            child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
            q, gone = np.repeat(q, self.fan), np.repeat(gone, self.fan)
            size = self.fan ** (k - 1)
            there = (child < len(self.value[k - 1])) & (child * size < last[q]) & ((child + 1) * size > first[q])
            todo.append((k - 1, q[there], child[there], gone[there]))


def spanning(fps: np.ndarray, limit: int = DISTANCE) -> list[tuple[int, int]]:
    """Positions (i, root) that join what is linked among fps, which are distinct and in Gray order."""
    label, n = np.arange(len(fps)), np.arange(len(fps))
    for i, j in GrayIndex(fps).search(fps, limit, n + 1, np.full(len(fps), len(fps))) if len(fps) > 1 else ():
        label = labels(label, i, j)
    label = roots(label)
    return [(int(i), int(label[i])) for i in np.flatnonzero(label != np.arange(len(fps)))]


class Upper:
    """The index's upper nodes: ranges of the Gray order, and the bits that all fingerprints of a range share."""

    def __init__(self, bounds: list[int], nodes: list[tuple[int, int, int]]):
        self.bounds = np.array(bounds, np.int64)
        self.names = np.array([k for k, _, _ in nodes], np.int64)
        low, high = (np.array([x[c] for x in nodes], np.int64).view(np.uint64) for c in (1, 2))
        self.index = GrayIndex(low, ~(low ^ high)) if nodes else None

    def home(self, rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, rank, side="left")

    def routes(self, fps: np.ndarray, home: np.ndarray, limit: int):
        """Yields (query position, range): its own range and those after it that may hold a fingerprint within `limit` bits."""
        at = np.searchsorted(self.names, home)
        for q, node in self.index.search(fps, limit, at, np.full(len(fps), len(self.names))):
            yield q, self.names[node]


def upper(ranked: DataFrame, bucket: int = BUCKET) -> Upper:
    """The upper nodes over ranked (fp, rank): SUBTREES of them, or more where these would hold over `bucket` fingerprints
    each. The driver gets three numbers a node."""
    n = ranked.count()
    parts = min(n, max(SUBTREES, -(-n // bucket)))
    found = ranked.agg(F.percentile_approx("rank", [k / parts for k in range(1, parts)], min(1_000_000, 20 * parts))).first()[0] if parts > 1 else []
    bounds = sorted(set(found or []))

    def run(batches):
        own = Upper(bounds, [])
        for b in batches:
            fp, home = b["fp"].to_numpy(), own.home(b["rank"].to_numpy())
            order = np.argsort(home, kind="stable")
            start = np.flatnonzero(np.diff(home[order], prepend=-1))
            cols = (home[order][start], np.bitwise_and.reduceat(fp[order], start), np.bitwise_or.reduceat(fp[order], start)) if len(fp) else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "low", "high"])

    nodes = ranked.select("fp", "rank").mapInArrow(run, "node long, low long, high long").groupBy("node").agg(F.expr("bit_and(low)"), F.expr("bit_or(high)"))
    return Upper(bounds, sorted(tuple(r) for r in nodes.collect()))


def links(fps: DataFrame, limit: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """fps: (fp, id), fp distinct. (a, b): ids whose closure links all fingerprints with `limit` or fewer differing bits.
    Empty fps: no rows. Each subtree is held by one task; those that visit it pass through in parts of VISITORS."""
    ranked = fps.select("fp", "id", gray_rank(F.col("fp")).alias("rank"))
    top = upper(ranked, bucket)

    def route(batches):
        for b in batches:
            fp, ids, rank = (b[c].to_numpy() for c in ("fp", "id", "rank"))
            home = top.home(rank)
            for q, node in top.routes(fp.view(np.uint64), home, limit) if len(fp) else ():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node, node != home[q], rank[q], fp[q], ids[q])], names=["node", "visitor", "rank", "fp", "id"])

    def search(batches):
        now, own, ids, held = None, None, None, []
        shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def told(label, names):
            at = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(names[label[at]])], schema=shape)

        def settle(visitors: bool):
            """Links of the rows held: among themselves while they are the subtree's own, else to these."""
            nonlocal own, ids, held
            if not held:
                return
            fp, names = (np.concatenate(x) for x in zip(*held))
            held = []
            fp = fp.view(np.uint64)
            if not visitors:
                own, ids = GrayIndex(fp), names
                n = np.arange(len(fp))
                label = n.copy()
                for i, j in own.search(fp, limit, n + 1, np.full(len(fp), len(fp))):
                    label = labels(label, i, j)
                yield told(roots(label), names)
            else:
                label = np.arange(len(ids) + len(fp))
                for i, j in own.search(fp, limit):
                    label = labels(label, j, i + len(ids))
                yield told(roots(label), np.concatenate([ids, names]))

        state = (None, False)
        for b in batches:
            if not b.num_rows:
                continue
            node, visitor, fp, name = (b[c].to_numpy(zero_copy_only=False) for c in ("node", "visitor", "fp", "id"))
            cuts = [0, *(np.flatnonzero((node[1:] != node[:-1]) | (visitor[1:] != visitor[:-1])) + 1).tolist(), len(node)]
            for x, y in zip(cuts, cuts[1:]):
                if (here := (node[x], visitor[x])) != state or sum(len(h[0]) for h in held) >= VISITORS and visitor[x]:
                    yield from settle(state[1])
                    state = here
                held.append((fp[x:y], name[x:y]))
        yield from settle(state[1])

    rows = ranked.mapInArrow(route, "node long, visitor boolean, rank long, fp long, id long")
    dealt = rows.repartition("node").sortWithinPartitions("node", "visitor", "rank")
    return dealt.select("node", "visitor", "fp", "id").mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the least doc_id that links reach, itself included.

    Rows without a word (null, empty, blank) share fingerprint 0 and are linked like others. A very long text is hashed in
    parts. Rows of one doc_id stay separate rows; a null doc_id never becomes a component's id unless all its rows have none.
    Only the two named columns are read, so others may have any name. Empty docs: no rows."""
    fps = written(fingerprints(docs, doc_id, text), "fingerprints")
    least = written(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "distinct")
    found = components(links(least.filter("id is not null").select("fp", "id"), limit))
    named = least.join(found.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"), "n")
    return keyed_join(fps, named, ["fp"], fps.count(), "doc_id").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = DISTANCE) -> DataFrame:
    """docs with one document of each component: that of least doc_id (rows that share it stay)."""
    kept = near_duplicates(docs, doc_id, text, limit).filter("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs[doc_id].eqNullSafe(kept["_kept"]), "left_semi")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
