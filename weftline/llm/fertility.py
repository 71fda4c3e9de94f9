"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback measures each text: characters per token, share of tokens that are fallback
bytes, entropy of its tokens in bits. Documents of a language (or script, where no language is given) set the bands that
its documents must lie in: their own quartiles, widened by multiples of the spread between quartiles. The spread is that of
the language's documents, and the mean spread of all languages counts like PRIOR further documents, so a language of few
documents has its own place and a usual width. Quartiles are exact over measures rounded to STEP. A measure of fewer tokens scatters more, so bands widen with the root of (median number of tokens / a document's tokens) below the median."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import mapped, table, written

MIN_WORDS = 50
#: Spreads that a band reaches beyond the quartiles: characters per token (both ways), byte share (up), entropy (down).
REACH = {"chars_per_token": 4.5, "byte_share": 6.0, "entropy": 2.0}
#: Least width of a spread, so that a uniform corpus doesn't reject all else.
FLOOR = {"chars_per_token": 0.04, "byte_share": 0.004, "entropy": 0.25}
#: Documents that the mean spread of all languages counts for in a language's own.
PRIOR = 50
#: Rounding of the measures where quartiles are taken; of the number of tokens its logarithm to base 2 is rounded.
STEP = {"chars_per_token": 1e-3, "byte_share": 1e-4, "entropy": 1e-3, "n_tokens": 1 / 64}
#: Languages and scripts up to which their bands are broadcast; more are joined by shuffling.
FEW = 10_000
#: Characters whose scripts are counted at once.
PIECE = 1 << 18
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_BLANK = b" \t\n\v\f\r"

#: First code points of the blocks that tell scripts apart, fixed by the Unicode standard.
SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x1000, "other"), (0x1E00, "latin"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other")]


def script(text: str) -> str:
    """The script of most of the text's letters; the first by name on ties."""
    found: dict[str, int] = {}
    for k in range(0, len(text), PIECE):
        codes, n = np.unique(np.frombuffer(text[k : k + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
        at = np.searchsorted([s for s, _ in SCRIPTS], codes, side="right") - 1
        for c, j, m in zip(codes.tolist(), at.tolist(), n.tolist()):
            if chr(c).isalpha():
                found[SCRIPTS[j][1]] = found.get(SCRIPTS[j][1], 0) + m
    return max(sorted(found), key=found.get) if found else "none"


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.split()
    n = len(words)
    blanks = sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    raw = np.frombuffer(text, np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum()) - blanks
    symbols = len(_SYMBOLS.findall(text))
    seen, dup = set(), 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                dup += 1
            elif line.strip(_BLANK):
                seen.add(line)
    repeat = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter([ids.setdefault(x, len(ids)) for x in words], np.int64, n)
        code = (w[:-2] * len(ids) + w[1:-1]) * len(ids) + w[2:] if len(ids) < 1 << 20 else None
        if code is None:  # too many different words for one number: pairs get numbers of their own first
            pair = np.unique(w[:-2] * len(ids) + w[1:-1], return_inverse=True)[1]
            code = pair * len(ids) + w[2:]
        order = np.argsort(code, kind="stable")
        s = code[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = order[twice]
        cover = np.zeros(n, bool)
        cover[at] = cover[at + 1] = cover[at + 2] = True
        repeat = int(cover.sum())
    return n, chars, symbols, dup, repeat


class Fertility:
    """Measures of a text by a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.array([self.model.is_byte(k) for k in range(self.model.get_piece_size())])

    def measure(self, texts: list[str]) -> list[tuple[float, float, float, int]]:
        out = []
        for text, ids in zip(texts, self.model.encode(texts, num_threads=1)):
            if not ids:
                out.append((0.0, 0.0, 0.0, 0))
                continue
            n = np.bincount(ids)
            bytes_ = int(n[self.byte[: len(n)]].sum())
            n = n[n > 0]
            out.append((len(text) / len(ids), bytes_ / len(ids), float(np.log2(len(ids)) - (n * np.log2(n)).sum() / len(ids)), len(ids)))
        return out


_open: dict[str, Fertility] = {}
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURES = ("chars_per_token", "byte_share", "entropy")


def measured(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, group, base measures, fertility measures, base_failed) of each row of docs. A null text has no words."""

    def work():
        if path not in _open:
            _open[path] = Fertility(path)

        def step(rows):
            texts = [t or "" for t in rows["text"]]
            found = [base(t.encode()) for t in texts]
            out = {"doc_id": rows["doc_id"], "group": [k if k is not None else f"script:{script(t)}" for k, t in zip(rows["lang"], texts)]}
            out |= {name: [f[k] for f in found] for k, name in enumerate(_BASE)}
            fert = _open[path].measure(texts)
            return out | {name: [f[k] for f in fert] for k, name in enumerate((*_MEASURES, "n_tokens"))}

        return step

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    kind = "doc_id long, group string, " + ", ".join(f"{n} long" for n in _BASE) + ", " + ", ".join(f"{n} double" for n in _MEASURES) + ", n_tokens long"
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return mapped(plain, work, kind, 64).withColumn("base_failed", failed)


def bands(good: DataFrame) -> DataFrame:
    """(group, q1, q3 and spread of each measure, median): one row for each group of good. Each measure of a group is counted by
    rounded value, so what is sorted has no more rows than values."""
    value = {m: F.col(m) for m in _MEASURES} | {"n_tokens": F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))}
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.round(v / STEP[m]).cast("long").alias("bin")) for m, v in value.items())))
    counts = good.select("group", rows.alias("r")).groupBy("group", "r.measure", "r.bin").agg(F.count("*").alias("n"))
    order = Window.partitionBy("group", "measure").orderBy("bin")
    upto = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("group", "measure")))
    at = {name: F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin"))) for name, share in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))}
    quartiles = upto.groupBy("group", "measure").agg(F.max("all").alias("n"), *(v.alias(k) for k, v in at.items()))
    of = lambda m, q: F.max(F.when(F.col("measure") == m, F.col(q)))
    cols = [(of(m, q) * STEP[m]).alias(f"{m}_{q}") for m in _MEASURES for q in ("q1", "q3")]
    own = quartiles.groupBy("group").agg(F.max("n").alias("n"), *cols, F.pow(F.lit(2.0), of("n_tokens", "q2") * STEP["n_tokens"]).alias("median"))
    mean = own.agg(*((F.sum(F.col("n") * (F.col(f"{m}_q3") - F.col(f"{m}_q1"))) / F.sum("n")).alias(f"{m}_mean") for m in _MEASURES))
    spread = [((F.col("n") * (F.col(f"{m}_q3") - F.col(f"{m}_q1")) + PRIOR * F.col(f"{m}_mean")) / (F.col("n") + PRIOR)).alias(f"{m}_spread") for m in _MEASURES]
    return own.crossJoin(F.broadcast(mean)).select("group", "median", *(f"{m}_{q}" for m in _MEASURES for q in ("q1", "q3")), *spread)  # mean: one row


def _inside(m: str) -> Column:
    scatter = F.sqrt(F.greatest(F.lit(1.0), F.col("median") / F.greatest(F.col("n_tokens"), F.lit(1))))
    reach = REACH[m] * F.greatest(F.col(f"{m}_spread"), F.lit(FLOOR[m])) * scatter
    low, high = F.col(m) >= F.col(f"{m}_q1") - reach, F.col(m) <= F.col(f"{m}_q3") + reach
    return {"chars_per_token": low & high, "byte_share": high, "entropy": low}[m]


def judged(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """measured() with `kept`: whether the base rules hold and every fertility measure lies in its group's band.

    Bands come from all documents that pass the base rules; in a group without any, no document passes them. Null and empty
    texts fail the base rules. Very long texts are read whole. A measure just on a band's bound is inside. Repeated rows
    are judged alike, and each counts for the bands. Only the three named columns are read, so others may have any name.
    Empty docs: no rows."""
    found = written(measured(docs, path, doc_id, text, lang), "fertility")
    own = written(bands(found.filter(~F.col("base_failed"))), "bands")
    if own.count() <= FEW:
        own = F.broadcast(own)
    ok = _inside(_MEASURES[0]) & _inside(_MEASURES[1]) & _inside(_MEASURES[2])
    both = found.join(own, "group", "left")
    return both.select("doc_id", *_BASE, "base_failed", (~F.col("base_failed") & F.coalesce(ok, F.lit(False))).alias("kept"), "group", *_MEASURES, "n_tokens")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = judged(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *_MEASURES)
