"""Benchmark passages in documents, edits allowed: q-gram lemma filter over diagonal bands, then banded alignment.

Texts are compared in lower case with white space as single spaces. An item of m characters may differ from a passage by
e = m * RATE edits. A passage within e edits shares at least m + 1 - q (e + 1) of the item's q-grams with it, all on
diagonals (place in the document less place in the item) that lie within e of each other; q is Q, or less for short items
so that the bound is 1 at least. Places are taken in steps of e + 1, so a q-gram that an item repeats counts once a
step, and bands of three steps overlap so that any such set lies wholly in one. Places of the document that share a q-gram
in a band are counted; bands that reach the bound are aligned by Levenshtein distance with free ends in the document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import mapped, table, written

Q = 8
#: Edits allowed, as a share of the item's length.
RATE = 0.1
#: Characters of the benchmark that one pass over the documents takes and the driver holds; a larger one takes more passes.
BLOCK = 4_000_000
#: Shared q-grams that are looked at at once.
HITS = 1 << 20
#: Characters of a document whose q-grams are looked up at once.
PART = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _qgrams(text: str, q: int) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    m = len(c) - q + 1
    code = np.zeros(max(m, 0), np.uint64)
    for k in range(q if m > 0 else 0):
        code = (code ^ (code >> np.uint64(29))) * _M + c[k : k + m]
    return (code ^ (code >> np.uint64(32))) * _M


def budget(m: int, q: int = Q, rate: float = RATE) -> tuple[int, int, int]:
    """Edits allowed for an item of m characters, the length of its q-grams, and how many of them must be shared."""
    e = int(m * rate)
    q = min(q, m // (e + 1))
    return e, q, m + 1 - q * (e + 1)


def aligned(item: str, text: str, edits: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the passage of text nearest to item, of the least end on ties, if within `edits`.
    Only the cells on diagonals -edits .. len(text) - len(item) + edits are filled; no passage within `edits` leaves them."""
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    a = np.frombuffer(item.encode("utf-32-le"), np.uint32)
    t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = len(t) - len(a) + 1 + 2 * edits
    if width <= 0:
        return None
    pad = np.concatenate([np.zeros(edits, np.uint32), t, np.zeros(edits + 1, np.uint32)])
    offset = np.arange(width)
    big = len(a) + len(t) + 1
    outside = lambda i: (offset + i - edits < 0) | (offset + i - edits > len(t))
    # row[k]: distance of item[:i] to a passage that ends before text place i + k - edits; started with where it starts
    row = np.where(outside(0), big, 0)
    begin = offset - edits
    for i in range(1, len(a) + 1):
        place = pad[i - 1 : i - 1 + width]  # text[i - 1 + k - edits], one below the cell's end
        take = row + (place != a[i - 1])
        drop = np.append(row[1:], big) + 1
        best = np.where(take <= drop, take, drop)
        start = np.where(take <= drop, begin, np.append(begin[1:], 0))
        best = np.where(outside(i), big, best)
        # extra characters of the text: a running minimum along the row
        lead = best - offset
        least = np.minimum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == least, offset, 0))
        row, begin = least + offset, start[source]
        row = np.where(outside(i), big, row)
    k = int(np.argmin(row))
    if row[k] > edits:
        return None
    return int(row[k]), int(begin[k]), len(a) + k - edits


class Grams:
    """Index of the q-grams of one length, of the items (place in the list, text, edits, least) that use it."""

    def __init__(self, q: int, items: list[tuple[int, str, int, int]]):
        self.q = q
        self.names, self.edits, self.least = (np.array([x[c] for x in items], np.int64) for c in (0, 2, 3))
        self.longest = max(len(t) for _, t, _, _ in items)
        codes = [_qgrams(t, q) for _, t, _, _ in items]
        code = np.concatenate(codes)
        owner = np.repeat(np.arange(len(codes)), list(map(len, codes)))
        step = np.concatenate([np.arange(len(c)) for c in codes]) // (self.edits[owner] + 1)
        order = np.lexsort((step, owner, code))
        code, owner, step = code[order], owner[order], step[order]
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1]) | (step[1:] != step[:-1])])
        code, self.owner, self.step = code[new], owner[new], step[new]
        self.code, first = np.unique(code, return_index=True)
        self.first = np.append(first, len(code))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.code >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def bands(self, text: str) -> list[tuple[int, int]]:
        """(item, band) with as many places that share a q-gram as the lemma asks for. Band k of an item holds the diagonals
        from k (edits + 1) to (k + 2) (edits + 1) - 1 at least."""
        out: set[tuple[int, int]] = set()
        for start in range(0, max(1, len(text)), PART):
            out |= self._bands(text[start : start + PART + 2 * self.longest], start)
        return sorted(out)

    def _bands(self, text: str, start: int) -> set[tuple[int, int]]:
        code = _qgrams(text, self.q)
        at = np.flatnonzero(self.seen[(code >> np.uint64(64 - _BITS)).astype(np.int64)])
        k = np.searchsorted(self.code, code[at])
        k[k == len(self.code)] = 0
        same = self.code[k] == code[at]
        at, k = at[same], k[same]
        if not len(at):
            return set()
        total = np.cumsum(self.first[k + 1] - self.first[k])
        cuts = [0]
        while cuts[-1] < len(at):  # parts of about HITS hits; every place is in one part
            done = total[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, done + HITS, "right"))))
        found = [self._counted(at[a:b] + start, k[a:b]) for a, b in zip(cuts, cuts[1:])]
        key, n = (np.concatenate(x) for x in zip(*found))
        if len(found) > 1:
            key, back = np.unique(key, return_inverse=True)
            n = np.bincount(back, n).astype(np.int64)
        item = key >> 40
        good = n >= self.least[item]
        return set(zip(self.names[item[good]].tolist(), ((key[good] & ((1 << 40) - 1)) - (1 << 39)).tolist()))

    def _counted(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item and band as one number, places in it) for some places."""
        n = self.first[k + 1] - self.first[k]
        hit = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, place = self.owner[hit], np.repeat(at, n)
        step = place // (self.edits[item] + 1) - self.step[hit]
        key = (item << 40) + step + (1 << 39)
        key, place = np.concatenate([key, key - 1, key - 2]), np.tile(place, 3)
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])])
        key = key[new]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[begins], np.diff(np.append(begins, len(key)))


class Items:
    """Q-gram indexes of a block of benchmark items, one for each length of q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE):
        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.edits = [budget(len(t), q, rate)[0] for _, t in self.items]
        by: dict[int, list[tuple[int, str, int, int]]] = {}
        for k, (_, t) in enumerate(self.items):
            e, size, least = budget(len(t), q, rate)
            by.setdefault(size, []).append((k, t, e, least))
        self.letters = [sorted((t.count(c), c) for c in set(t))[::-1] for _, t in self.items]
        self.grams = [Grams(size, part) for size, part in sorted(by.items())]

    def _lacks(self, item: int, part: str) -> bool:
        """Whether part lacks more of the item's characters, counted each, than edits could make up for."""
        left = self.edits[item]
        for n, c in self.letters[item]:
            if (here := part.count(c)) < n:
                left -= n - here
                if left < 0:
                    return True
        return False

    def passages(self, text: str):
        """(item's place, distance, start, end) of the passages within the budgets, band by band; none of an item after an exact one."""
        exact = set()
        for grams in self.grams:
            for item, band in grams.bands(text):
                if item in exact:
                    continue
                e, name = self.edits[item], self.items[item][1]
                low = max(0, band * (e + 1) - e)
                part = text[low : (band + 2) * (e + 1) - 1 + len(name) + e]
                if not self._lacks(item, part) and (found := aligned(name, part, e)):
                    if not found[0]:
                        exact.add(item)
                    yield item, found[0], low + found[1], low + found[2]

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance): the best passage of each item, places in the normalised text."""
        best: dict[int, tuple[int, int, int]] = {}
        for item, *seen in self.passages(normal(text)):
            best[item] = min(best.get(item, tuple(seen)), tuple(seen))
        return [(self.items[k][0], a, b, d) for k, (d, a, b) in sorted(best.items())]

    def any(self, text: str | None) -> bool:
        """Whether a passage of any item is in the text."""
        return next(self.passages(normal(text)), None) is not None


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = BLOCK):
    """(whether it is the last, items) of each block of about `size` characters of the benchmark. The driver holds one at a time."""
    items = benchmark.filter(F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // size))
    for k in range(n):
        yield k == n - 1, [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, start, end, distance) for each row of docs and each item with a passage in it within the item's
    edit budget: the nearest passage, the first on ties, its places in the lower-cased text with single spaces.

    Null, empty and blank texts and items match nothing. Very long texts are searched in overlapping parts, whatever they
    repeat. Repeated rows are judged alike, and items that occur twice match twice. Only the named columns are read, so
    others may have any name. An empty benchmark or empty docs: no rows."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = "doc_id long, item_id long, start long, end long, distance long"
    out = None
    for last, items in blocks(benchmark, item_id, item_text, block):

        def work(items=items):
            index = Items(items, q, rate)

            def step(rows):
                found = [(d, *m) for d, t in zip(rows["doc_id"], rows["text"]) for m in index.find(t)]
                return {n: [f[k] for f in found] for k, n in enumerate(("doc_id", "item_id", "start", "end", "distance"))}

            return step

        part = mapped(plain, work, kind)
        if not (last and out is None):  # of several blocks the driver holds one: each one's matches are written first
            part = written(part, "matches")
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_text: str = "text", q: int = Q, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """docs without the rows whose text holds a passage of an item. All columns stay as they are, whatever their names. Null and
    empty texts stay, repeated rows are judged alike. An empty benchmark: all rows; empty docs: no rows."""
    import pandas as pd
    from pyspark.sql.pandas.functions import pandas_udf

    out = docs
    for last, items in blocks(benchmark, "item_id", item_text, block):
        index = Items(items, q, rate)

        def leaks(texts):
            return pd.Series([index.any(t) for t in texts], dtype=bool)

        leaks.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        out = out.filter(~pandas_udf(leaks, "boolean")(F.col(text)))
        if not last:
            out = written(out, "clean")
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
