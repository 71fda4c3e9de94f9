"""Token ids in a compressed file format with access to single documents.

A data set is a folder of two Parquet tables, which any store that Spark writes to can hold: `dictionary`, one row with
the zstandard dictionary trained on serialised id arrays, and `shards`, one row for each shard with its bytes:

    magic, version, bytes an id, dictionary hash (xxh64), documents, those of them without an id, ids before the shard within its range
    doc_id int64[n], ids uint32[n], end of frame uint64[n]
    frames: one zstandard frame a document, independent of the others, over its little-endian ids

The index gives any document's frame, so a short document costs one small read and no other is decompressed.
Documents without an id come first; their place in doc_id holds 0. Documents stand in ascending order of id over ranges, shards and places; a range's first place is the sum over the ranges before.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import CLEANUP, mapped, sampled, shared_dir, table
from weftline.llm.tokens import encoder

MAGIC, VERSION = b"WFID", 2
HEAD = struct.Struct("<4sHHQIIQ")
#: The dictionary is trained on all ids of so many documents, those of least xxhash64(doc_id), in parts of so many bytes.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 2000, 1 << 14, 1 << 16
LEVEL = 3
#: A shard is closed at so many bytes of frames or documents.
SHARD_BYTES, SHARD_DOCS = 4 << 20, 1 << 16
#: Documents of a range, and ranges at most: beyond RANGE_DOCS * RANGES documents (2 * 10 ** 8) ranges grow, shards don't.
RANGE_DOCS, RANGES = 4_000, 50_000
END = 1


def train(docs: DataFrame, path: str, sample: int = SAMPLE, end: int = END) -> bytes:
    """A zstandard dictionary for the ids of docs (doc_id, text), trained in one task on whole documents of the sample. Where there
    is too little to train on, the sampled ids themselves are the dictionary (raw content); without any, the end id repeated."""
    chosen = sampled(docs.filter("text is not null"), "doc_id", sample, "text")

    def run(batches):
        e = encoder(path)
        whole = [_raw(x, e.width, end) for b in batches for k in range(0, b.num_rows, 64) for x in e.encode(b["text"].slice(k, 64).to_pylist())]
        samples = sorted(w[k : k + SAMPLE_BYTES] for w in whole for k in range(0, len(w), SAMPLE_BYTES))
        yield pa.RecordBatch.from_arrays([pa.array([trained(samples, e.width.type(end).tobytes())], pa.binary())], names=["dictionary"])

    found = chosen.select("text").coalesce(1).mapInArrow(run, "dictionary binary").collect()
    return bytes(found[0]["dictionary"]) if found else trained([], encoder(path).width.type(end).tobytes())


def trained(samples: list[bytes], end: bytes) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples, or too much alike
        return (32 * end + b"".join(samples))[-DICTIONARY:]


def _raw(ids: np.ndarray, width: np.dtype, end: int) -> bytes:
    return np.append(ids, width.type(end)).astype(width).tobytes()


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def dictionary_hash(dictionary: bytes) -> int:
    return xxhash.xxh64_intdigest(dictionary) if dictionary else 0


def shard(docs: list[int | None], ids: list[int], frames: list[bytes], width: int, dictionary: int, before: int) -> bytes:
    """The bytes of a shard. Documents without an id (None) come first."""
    nulls = docs.count(None)
    ends = np.cumsum([len(f) for f in frames], dtype=np.uint64)
    return HEAD.pack(MAGIC, VERSION, width, dictionary, len(docs), nulls, before) + np.array([0] * nulls + docs[nulls:], "<i8").tobytes() + np.array(ids, "<u4").tobytes() + ends.astype("<u8").tobytes() + b"".join(frames)


class Shard:
    """Reads a shard's bytes."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, width, name, n, self.nulls, self.before = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this format")
        if name != dictionary_hash(dictionary):
            raise ValueError("the shard was written with another dictionary")
        self.data, self.width = memoryview(data), np.dtype(f"<u{width}")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.n_ids = np.frombuffer(data, "<u4", n, at + 8 * n)
        self.ends = np.frombuffer(data, "<u8", n, at + 12 * n)
        self.frames = at + 20 * n
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document; no other frame is read."""
        start = int(self.ends[k - 1]) if k else 0
        frame = self.data[self.frames + start : self.frames + int(self.ends[k])]
        size = int(self.n_ids[k]) * self.width.itemsize
        return np.frombuffer(self.unpack.decompress(frame, max_output_size=size), self.width)


def write(docs: DataFrame, folder: str, path: str, doc_id: str = "doc_id", text: str = "text", end: int = END, level: int = LEVEL) -> None:
    """Writes the ids of each row of docs, each with the end id after it. A null or empty text is the end id alone, a very long
    one is one frame; rows that share an id follow one another in order of their bytes, those without an id come first.
    Only the two named columns are read, so others may have any name. Empty docs: a dictionary and no shard."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dictionary = train(plain, path, end=end)
    spark.createDataFrame([(dictionary_hash(dictionary).to_bytes(8, "little"), bytearray(dictionary))], "hash binary, dictionary binary").write.parquet(f"{folder}/dictionary")
    ranges = min(RANGES, -(-max(1, plain.count()) // RANGE_DOCS))
    bounds = plain.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], min(100 * ranges, 1_000_000))).first()[0] if ranges > 1 else []
    bounds = sorted(set(bounds or []))

    def frames():
        pack = _compressor(dictionary)

        def step(rows):
            e = encoder(path)
            raws = [_raw(x, e.width, end) for x in e.encode(rows["text"])]
            at = np.searchsorted(bounds, np.array([d if d is not None else -(1 << 63) for d in rows["doc_id"]], np.int64), side="left") if bounds else np.zeros(len(raws), np.int64)
            return {"range": at, "doc_id": rows["doc_id"], "n": [len(r) // e.width.itemsize for r in raws], "frame": [pack.compress(r) for r in raws]}

        return step

    width = encoder(path).width.itemsize
    name = dictionary_hash(dictionary)
    shape = pa.schema([("range", pa.int32()), ("shard", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("bytes", pa.binary())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now, number, before = [], 0, None, 0, 0

        def told() -> pa.RecordBatch:
            docs, ids, parts = ([h[k] for h in held] for k in range(3))
            known = [d for d in docs if d is not None]
            row = (now, number, len(docs), sum(ids), known[0] if known else None, known[-1] if known else None, shard(docs, ids, parts, width, name, before))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, shape)], schema=shape)

        for batch in batches:
            for where, d, n, frame in zip(*(batch[c].to_pylist() for c in ("range", "doc_id", "n", "frame"))):
                if held and (where != now or size + len(frame) > SHARD_BYTES or len(held) >= SHARD_DOCS):
                    yield told()
                    number, before = (number + 1, before + sum(h[1] for h in held)) if where == now else (0, 0)
                    held, size = [], 0
                now = where
                held.append((d, n, frame))
                size += len(frame)
        if held:
            yield told()

    rows = mapped(plain, frames, "range int, doc_id long, n long, frame binary").repartition("range").sortWithinPartitions("range", "doc_id", "frame")
    found = rows.mapInArrow(shards, "range int, shard int, docs long, ids long, first_doc long, last_doc long, bytes binary")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        found.write.option("compression", "uncompressed").parquet(f"{folder}/shards")
    finally:
        spark.conf.set(CLEANUP, before)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids): every document of a data set; start is the number of ids before it, in ascending order of doc_id."""
    return _read(spark, folder, lambda ids: ids.tolist(), "ids array<int>", "ids")


def _read(spark: SparkSession, folder: str, make, kind: str, *names: str) -> DataFrame:
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
    shards = spark.read.parquet(f"{folder}/shards")
    # one number for each of at most RANGES ranges
    totals = {r["range"]: r["ids"] for r in shards.groupBy("range").agg(F.sum("ids").alias("ids")).collect()}
    base, at = {}, 0
    for k in sorted(totals):
        base[k], at = at, at + totals[k]

    def work():
        def step(rows):
            out = {k: [] for k in ("doc_id", "start", *names)}
            for where, data in zip(rows["range"], rows["bytes"]):
                one = Shard(data, dictionary)
                start = base[where] + one.before
                for k in range(len(one)):
                    value = make(one.ids(k))
                    out["doc_id"].append(int(one.doc_ids[k]) if k >= one.nulls else None)
                    out["start"].append(start)
                    for name, v in zip(names, value if len(names) > 1 else (value,)):
                        out[name].append(v)
                    start += int(one.n_ids[k])
            return out

        return step

    return mapped(shards.select("range", "bytes"), work, f"doc_id long, start long, {kind}", 1)


def get(spark: SparkSession, folder: str, doc_id: int) -> list[int]:
    """Ids of one document: Parquet skips other shards by first_doc and last_doc, and one frame is decompressed."""
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
    for row in spark.read.parquet(f"{folder}/shards").filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).select("bytes").toLocalIterator():
        one = Shard(bytes(row["bytes"]), dictionary)
        k = one.nulls + int(np.searchsorted(one.doc_ids[one.nulls :], doc_id))
        if k < len(one) and one.doc_ids[k] == doc_id:
            return one.ids(k).tolist()
    raise LookupError(f"no document {doc_id}")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a data set, from its decompressed ids."""
    return _read(spark, folder, lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())), "n_tokens long, ids_crc32 long", "n_tokens", "ids_crc32")


def op4_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return digests(spark, folder)
