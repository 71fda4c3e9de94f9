"""Removal of word passages that an earlier document also has, by prefix-partitioned suffix trees.

A suffix is taken to its first WINDOW words and written as a path: 64-bit codes of its first 8, 16 and 32 words and
a 128-bit code of all 50. Suffixes are dealt to groups by their first 8 words. A group that turns out larger than memory
allows is dealt again by longer prefixes, of 16, 32 and 50 words, so prefixes are as long as they must be. A task sorts a
group's suffixes by path and builds their subtree: its internal nodes are the runs of suffixes with a common path, those
of one document alone are left with all below them, and those WINDOW words deep are the repeats. Every suffix of such
a node but those of its least document is covered; overlapping ones make the maximal repeats that are removed. A path of
50 words that alone exceeds a group is one node, whose least document an aggregate finds.

Only suffixes that can repeat enter the trees. Each window has an anchor, the least code of the 8-word grams in it, so
equal windows have equal anchors; windows whose anchor only one document has are left out. Documents of the same words
as an earlier one are settled by that alone. Both are exact.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import discard, keyed_join, mapped, table, text_bytes, written

WINDOW, GRAM = 50, 8
#: Suffixes of a group on average; one of over twice as many is dealt again. A suffix takes 64 bytes.
GROUP = 1 << 16

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(31)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Code of a sequence from the codes of its two parts."""
    x = (a * _M1) ^ (b + _M2 + (a << np.uint64(17)))
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> np.uint64(29))


def _codes(words: list[bytes], seed: int, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """size -> codes of all runs of so many words."""
    digest = xxhash.xxh64_intdigest
    have = {1: np.fromiter([digest(w, seed) for w in words], np.uint64, len(words))}

    def code(n: int) -> np.ndarray:
        if n not in have:
            half = 1 << ((n - 1).bit_length() - 1)
            a, b = code(half), code(n - half)
            m = len(words) - n + 1
            have[n] = _join(a[:m], b[half : half + m])
        return have[n]

    return {n: code(n) for n in sizes}


def _anchors(grams: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window, the least gram code in it."""
    return np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).min(axis=1)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _outline(window: int, gram: int):
    """Of each document: number of words, 128-bit code of its words, digest of the words joined by a space, anchors."""

    def work():
        def step(rows):
            out = {k: [] for k in ("doc_id", "key", "n_words", "c1", "c2", "sha", "anchors")}
            for d, key, text in zip(rows["doc_id"], rows["key"], rows["text"]):
                words = text.split()
                whole = b" ".join(words)
                code = xxhash.xxh3_128_intdigest(whole)
                anchors = _signed(np.unique(_anchors(_codes(words, 1, (gram,))[gram], window, gram))) if len(words) >= window else []
                row = (d, key, len(words), (code >> 64) - (1 << 63), (code & ((1 << 64) - 1)) - (1 << 63), hashlib.sha256(whole).hexdigest(), anchors)
                for name, v in zip(out, row):
                    out[name].append(v)
            return out

        return step

    return work


def _suffixes(window: int, gram: int, depths: tuple[int, ...]):
    """Paths of the suffixes whose anchor is among the document's repeated ones."""

    def work():
        def step(rows):
            out = {k: [] for k in (*(f"p{n}" for n in depths), "a", "b", "doc_id", "key", "pos")}
            for d, key, text, known in zip(rows["doc_id"], rows["key"], rows["text"], rows["anchors"]):
                words = text.split()
                code = _codes(words, 1, (gram, *depths, window))
                at = np.flatnonzero(np.isin(_signed(_anchors(code[gram], window, gram)), np.array(known, np.int64)))
                for n in depths:
                    out[f"p{n}"].append(_signed(code[n][at]))
                out["a"].append(_signed(code[window][at]))
                out["b"].append(_signed(_codes(words, 2, (window,))[window][at]))
                out["doc_id"].append(np.full(len(at), d))
                out["key"].append(np.full(len(at), key))
                out["pos"].append(at)
            return {k: np.concatenate(v) if v else [] for k, v in out.items()}

        return step

    return work


def subtree(path: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Positions of the suffixes under a node of full depth that a lesser document has too. The suffixes are in path order;
    path[k] holds their codes at depth k. From the root down, a node is a run of suffixes with a common path, and its children
    are the runs into which the next depth splits it; a node within one document is left with all below it."""
    alive = np.arange(len(doc))
    edge = np.zeros(len(doc), bool)  # where a node begins among those alive
    edge[:1] = True
    for code in path:
        if not len(alive):
            return alive
        part = code[alive]
        edge[1:] |= part[1:] != part[:-1]
        start = np.flatnonzero(edge)
        size = np.diff(np.append(start, len(alive)))
        own = doc[alive]
        many = np.repeat(np.maximum.reduceat(own, start) > np.minimum.reduceat(own, start), size)
        alive, edge = alive[many], edge[many]
    start = np.flatnonzero(edge)
    low = np.repeat(np.minimum.reduceat(doc[alive], start), np.diff(np.append(start, len(alive)))) if len(alive) else alive
    return alive[doc[alive] > low]


def _covered(batches, path: list[str]):
    """Rows come by group and path. Builds one group's subtree after the other; returns (doc_id, key, pos) of covered suffixes."""
    names, held, now = [*path, "doc_id", "key", "pos"], [], None

    def told():
        cols = [np.concatenate(x) for x in zip(*held)]
        at = subtree(cols[:-3], cols[-3])
        return pa.RecordBatch.from_arrays([pa.array(c[at]) for c in cols[-3:]], names=names[-3:])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b[n].to_numpy() for n in names]
        group = b["group"].to_numpy()
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        for x, y in zip(cuts, cuts[1:]):
            if group[x] != now and held:
                yield told()
                held = []
            now = group[x]
            held.append([c[x:y] for c in cols])
    if held:
        yield told()


def _dealt(suffixes: DataFrame, prefixes: list[list[str]], size: int) -> tuple[DataFrame, DataFrame | None]:
    """The suffixes with a group each, by the shortest prefix whose group holds at most twice `size`; and those whose whole
    path fills more than that, if any."""
    out, left, first = None, suffixes, 0
    for cols in prefixes:
        groups = max(1, -(-left.count() // size))
        named = left.withColumn("group", F.pmod(F.xxhash64(*cols), F.lit(groups)) + F.lit(first))
        over = written(named.groupBy("group").count().filter(F.col("count") > 2 * size).select("group"), "overfull")
        full = over.count()
        fits = named.join(over, "group", "left_anti") if full else named
        out = fits if out is None else out.unionByName(fits)
        if not full:
            return out, None
        first += groups
        left = written(named.join(over, "group", "left_semi").drop("group"), "overfull")
    return out, left


def repeats(docs: DataFrame, outline: DataFrame, window: int = WINDOW, gram: int = GRAM, size: int = GROUP) -> DataFrame:
    """(doc_id, key, starts): for each document, the starts of windows that a document of lesser id has too. docs: doc_id, key, text (bytes)."""
    depths = tuple(n for n in (8, 16, 32) if n < window)
    owned = outline.filter("first").select("doc_id", "key", F.explode("anchors").alias("anchor"))
    shared = written(owned.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).filter("low < high").select("anchor", "n"), "anchors")
    total = outline.filter("first").agg(F.sum(F.size("anchors"))).first()[0] or 0
    known = keyed_join(owned, shared, ["anchor"], total, "doc_id").groupBy("doc_id", "key").agg(F.collect_set("anchor").alias("anchors"))
    schema = "".join(f"p{n} long, " for n in depths) + "a long, b long, doc_id long, key long, pos int"
    suffixes = written(mapped(docs.join(known, ["doc_id", "key"]).select("doc_id", "key", "text", "anchors"), _suffixes(window, gram, depths), schema, 64), "suffixes")
    path = [*(f"p{n}" for n in depths), "a", "b"]
    dealt, alone = _dealt(suffixes, [*([f"p{n}"] for n in depths), ["a", "b"]], size)
    rows = dealt.repartition("group").sortWithinPartitions("group", *path)
    found = rows.mapInArrow(lambda batches: _covered(batches, path), "doc_id long, key long, pos int")
    if alone is not None:
        least = written(alone.groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "nodes")
        found = found.unionByName(keyed_join(alone, least, ["a", "b"], alone.count(), "doc_id").filter("doc_id > low").select("doc_id", "key", "pos"))
    out = written(found.groupBy("doc_id", "key").agg(F.collect_set("pos").alias("starts")), "repeats")
    discard(suffixes)
    discard(shared)
    return out


def _spans(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal runs of words that windows at the starts cover."""
    at = np.unique(np.array(starts, np.int64))
    cut = np.flatnonzero(np.diff(at) > window) + 1
    return [(int(x[0]), int(x[-1]) + window) for x in np.split(at, cut)]


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, bytes, int]:
    """The text without its words in the spans, the kept words joined by a space, and the number of words removed.
    What stands between kept words stays as it is, but for white space at the ends of a cut."""
    places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    parts, words, end, gone = [], [], 0, 0
    for a, b in [*spans, (len(places), len(places))]:
        if a > end:
            parts.append(text[places[end][0] : places[a - 1][1]])
            words += [text[x:y] for x, y in places[end:a]]
        gone += b - a
        end = b
    return b"\n".join(parts), b" ".join(words), gone


def _cut(window: int):
    def work():
        def step(rows):
            out = {k: [] for k in ("doc_id", "key", "gone", "left_sha", "left_text")}
            for d, key, text, starts in zip(rows["doc_id"], rows["key"], rows["text"], rows["starts"]):
                left, words, gone = without(text, _spans(starts, window))
                for name, v in zip(out, (d, key, gone, hashlib.sha256(words).hexdigest(), left.decode())):
                    out[name].append(v)
            return out

        return step

    return work


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, size: int = GROUP) -> DataFrame:
    """(doc_id, key, n_words, n_removed, kept_sha256, text): key is xxhash64 of the text, and text is what is left of a
    text that lost words, else null.

    A null or empty text has no words. Texts under `window` words keep all, very long ones are read whole. Rows that share a
    doc_id, repeated ones too, are judged each against lesser doc_ids only, so a passage within one doc_id stays; rows
    without a doc_id are neither judged nor a source. Only the two named columns are read, so others may have any name.
    Empty docs: no rows."""
    gram = min(gram, window)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), text_bytes(text))
    raw = written(mapped(plain, _outline(window, gram), "doc_id long, key long, n_words long, c1 long, c2 long, sha string, anchors array<long>"), "outline")
    least = written(raw.groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "least")
    outline = written(keyed_join(raw, least, ["c1", "c2"], raw.count(), "doc_id").withColumn("first", F.col("doc_id").isNotNull() & (F.col("doc_id") == F.col("least"))).drop("least", "c1", "c2"), "outline")
    discard(raw)
    discard(least)
    starts = repeats(plain, outline, window, gram, size)
    changed = mapped(plain.join(starts, ["doc_id", "key"]), _cut(window), "doc_id long, key long, gone long, left_sha string, left_text string", 64)
    changed = changed.dropDuplicates(["doc_id", "key"])
    copy = ~F.col("first") & F.col("doc_id").isNotNull() & (F.col("n_words") >= window)
    return outline.join(changed, ["doc_id", "key"], "left").select(
        "doc_id",
        "key",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("left_text")).alias("text"),
    )


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without repeated passages: texts lose them, and rows of which nothing is left go. Other columns stay, whatever
    their names. Rows without a doc_id or a text, and those under `window` words, stay as they are."""
    found = removed(docs, doc_id, text, window).filter("n_removed > 0").select("doc_id", "key", F.col("text").alias("left")).dropDuplicates(["doc_id", "key"])
    named = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.struct(*named).alias("row"))
    kept = rows.join(found, ["doc_id", "key"], "left").filter(F.col("left").isNull() | (F.col("left") != ""))
    return kept.select(*(F.coalesce("left", f"row.{n}").alias(c) if c == text else F.col(f"row.{n}").alias(c) for c, n in zip(docs.columns, named)))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: Windows as joined words; a word goes if a window over it starts in a lesser document too.
OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), p AS (
  SELECT doc_id, CAST(unnest(range(1, greatest(len(words) - 48, 1))) AS INT) AS i, words FROM w
), g AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM p
), l AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h),
s AS (SELECT doc_id, list(i) AS starts FROM g JOIN l USING (h) WHERE doc_id > low GROUP BY doc_id),
c AS (
  SELECT s.doc_id, unnest(starts) AS a FROM s
), k AS (SELECT DISTINCT doc_id, unnest(range(a, a + 50)) AS i FROM c),
r AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE
    list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
