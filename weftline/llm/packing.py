"""Packing of token pieces into sequences by vector best fit.

A piece asks for tokens, one document place and attention cost (its length squared); a sequence has a capacity of each.
Pieces go largest first to the open sequence that can take them under every capacity and fits best: least weighted norm
of what is left, or greatest weighted dot product of demand and residual. Pieces are dealt by hash to groups of about
GROUP, so no group depends on the corpus's size, and each is packed on its own: a small group leaves at most a few
sequences part full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import mapped, table, written
from weftline.llm.tokens import encoder

TOKENS = 2048
#: Largest number of pieces in a sequence, and largest sum of squared lengths: no more attention than one full piece asks for.
DOCUMENTS, ATTENTION = 256, 2048 * 2048
WEIGHTS = (1.0, 0.02, 0.02)
GROUP = 8192
END = 0


def cut(n: int, tokens: int = TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than `tokens`."""
    head = n % tokens or min(n, tokens)
    return [(0, head)] + [(s, tokens) for s in range(head, n, tokens)]


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokens: int = TOKENS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row of docs; a null or empty text is the end id alone.

    Only a text of more than `tokens` ids is cut, whatever its length. Rows that share a doc_id, null ones among them, are
    cut each on its own. Empty docs: no rows. Only the two named columns are read, so others may have any name."""

    def work():
        def step(rows):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for d, ids in zip(rows["doc_id"], encoder(path).encode(rows["text"])):
                raw = np.append(ids, END).astype("<u4").tobytes()
                for k, (s, n) in enumerate(cut(len(raw) // 4, tokens)):
                    for name, v in (("doc_id", d), ("piece", k), ("start", s), ("length", n), ("ids_crc32", zlib.crc32(raw[4 * s : 4 * (s + n)]))):
                        out[name].append(v)
            return out

        return step

    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int] = (TOKENS, DOCUMENTS, ATTENTION), weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece. A piece above a capacity gets a sequence of its own."""
    order = np.argsort(-lengths, kind="stable")
    whole = np.array(capacity, float)
    w = np.array(weights, float)[:, None]
    n = len(lengths)
    left = np.empty((3, n))
    names = np.empty(n, np.int64)
    sequence, offset = np.empty(n, np.int64), np.zeros(n, np.int64)
    opened = live = 0
    least = int(lengths.min()) if n else 0
    for i in order.tolist():
        size = int(lengths[i])
        need = np.array([size, 1, size * size], float)
        rest = (left[:, :live] - need[:, None]) / whole[:, None]
        fits = (rest >= 0).all(axis=0)
        at = -1
        if fits.any():
            if rule == "norm":
                score = (w * rest * rest).sum(axis=0)
            else:
                score = -(w * (need / whole)[:, None] * (rest + (need / whole)[:, None])).sum(axis=0)
            score[~fits] = np.inf
            at = int(score.argmin())
        if at < 0:
            at, live = live, live + 1
            left[:, at], names[at] = whole, opened
            opened += 1
        sequence[i], offset[i] = names[at], int(whole[0] - left[0, at])
        left[:, at] -= need
        if left[0, at] < least or left[1, at] < 1 or left[2, at] < least * least:  # full: the last open one takes its place
            live -= 1
            left[:, at], names[at] = left[:, live], names[live]
    return sequence, offset


def packed(found: DataFrame, capacity: tuple[int, int, int] = (TOKENS, DOCUMENTS, ATTENTION), weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """pieces() with sequence_id and offset. Offsets of a sequence run from 0 without a gap. No piece: no rows.

    Pieces of equal length are taken in order of doc_id, piece and crc; of sequences that fit equally well, the first open
    one is taken. Pieces equal in all columns lie in one group, next to each other."""
    groups = max(1, round(found.count() / group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table, part: int) -> pa.RecordBatch:
            sequence, offset = best_fit(rows["length"].to_numpy(), capacity, weights, rule)
            ids = (int(rows["_group"][0].as_py()) << 32) + (part << 24) + sequence
            out = rows.drop_columns(["_group"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))
            return out.combine_chunks().to_batches()[0]

        part = 0
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch["_group"].to_numpy()
            cuts = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(name)]
            for a, b in zip(cuts, cuts[1:]):
                if last is not None and (name[a] != last or sum(x.num_rows for x in held) >= 8 * group) and held:
                    part = part if name[a] == last else 0
                    yield done(pa.Table.from_batches(held), part)
                    part, held = (part + 1 if name[a] == last else 0), []
                last = name[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield done(pa.Table.from_batches(held), part)

    dealt = found.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    rows = dealt.repartitionByRange(groups, "_group").sortWithinPartitions("_group", F.desc("length"), "doc_id", "piece", "ids_crc32")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", **kind) -> DataFrame:
    """Placement of each piece of each row of docs. Rows that share a doc_id are packed as rows of their own."""
    return packed(written(pieces(docs, path, doc_id, text), "pieces"), **kind)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
