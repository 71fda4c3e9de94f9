"""Quality score: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text is cut into words and runs of symbols. Its features are hashed single tokens and pairs, of the tokens as they are
and of their shapes (case, length, kind, symbol), and of tokens that repeat the one before. A feature's value is the
square root of its share, so every text has norm 1; the score is a sparse dot product through the logistic function."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import mapped, remainder, table

#: Weights; at most so many labelled documents are learned from: those of least xxhash64(doc_id); rounds over them.
BITS, SAMPLE, ROUNDS = 18, 8000, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Token codes kept by a process.
CACHE = 400_000
_A, _B, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - BITS)


def shape(token: str) -> str:
    """Kind of a token: its case and a length class, or the symbols themselves (runs cut to one of each)."""
    if token[0].isalnum() or token[0] == "_":
        kind = "d" if token.isdigit() else "U" if token.isupper() else "l" if token.islower() else "T" if token[1:].islower() else "m"
        return kind + str(min(len(token), 12) // 4)
    return "s" + re.sub(r"(.)\1+", r"\1\1", token)[:4]


class _Codes(dict):
    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > CACHE:
            self.clear()
        found = self[token] = (xxhash.xxh64_intdigest(token), xxhash.xxh64_intdigest(shape(token), 1))
        return found


_codes = _Codes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values); no token: none."""
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.empty(0, np.int64), np.empty(0)
    code = np.array(list(map(_codes.__getitem__, tokens)), np.uint64)
    parts = []
    for c, salt in ((code[:, 0], np.uint64(11)), (code[:, 1], np.uint64(13))):
        parts.append((c + salt) * _A)
        parts.append((c[:-1] * _B + (c[1:] ^ (c[1:] >> np.uint64(31))) + salt) * _A)
    same = (code[1:, 0] == code[:-1, 0]).astype(np.uint64)
    parts.append((same + np.uint64(17)) * _B * _A)
    at, n = np.unique((np.concatenate(parts) >> _SHIFT).astype(np.int32), return_counts=True)
    return at, np.sqrt(n / n.sum())


class Ftrl:
    """Follow-the-regularised-leader (proximal) for logistic loss; place 2 ** BITS is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def model(self) -> np.ndarray:
        return self.weights(slice(None)).astype(np.float32)


def score(model: np.ndarray, text: str | None) -> float:
    at, x = features(text)
    return float(1 / (1 + np.exp(-np.clip(float(model[at] @ x) + float(model[-1]), -35, 35))))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Weights learned from the labelled documents. Rows without text or label, or labelled otherwise than 0 or 1, teach nothing;
    empty texts teach the bias. Learning is sequential, so one task does it, over at most `sample` pairs of a document and a
    label: those of least xxhash64(doc_id), on ties of least hash of the text, then of least label. Repeated rows and labels
    count each. No labelled row, or no document: all scores are 0.5."""
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "label").limit(sample).coalesce(1)

    def run(batches):
        import random

        seen = []
        for batch in batches:
            seen += [(*features(t), y) for t, y in zip(batch["text"].to_pylist(), batch["label"].to_pylist())]
        model = Ftrl()
        for k in range(rounds):
            random.Random(k).shuffle(seen)
            for at, x, y in seen:
                model.learn(at, x, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.model().tobytes()], pa.binary())], names=["model"])

    found = rows.select("text", "label").mapInArrow(run, "model binary").collect()
    return np.frombuffer(bytes(found[0]["model"]), np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def scored(docs: DataFrame, model: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of each row of docs over its whole text, however long; null and empty texts get the bias's score. Repeated
    rows are scored alike. Only the two named columns are read, so others may have any name. Empty docs: no rows."""

    def work():
        return lambda rows: {"doc_id": rows["doc_id"], "score": [score(model, t) for t in rows["text"]]}

    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), work, "doc_id long, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 3) != 1))
    return scored(docs, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
