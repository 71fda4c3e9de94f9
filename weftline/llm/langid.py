"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent character n-grams (one to five letters, with word ends) of a language in order. A
document's own list is compared to each profile: every n-gram adds the difference of its two places, or PROFILE if the
profile lacks it (out-of-place distance). The nearest profile gives the language.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import mapped, remainder, smallest, table

#: N-grams of a profile, and of a document's list.
PROFILE = 400
ORDERS = 5
#: At most so many labelled documents of a language are learned from: those of least xxhash64(doc_id).
SAMPLE = 1000
UNKNOWN = "und"
#: Letters counted at once; longer texts are counted in parts that end at a word's end.
PART = 1 << 19
_OTHER = re.compile(r"[\W\d_]+")
_M = np.uint64(0x9E3779B97F4A7C15)


def _codes(chars: np.ndarray) -> list[np.ndarray]:
    """64-bit codes of the n-grams of each order; none spans a word's end (the value 95) but at its own ends."""
    end = chars == 95
    c = chars.astype(np.uint64) + np.uint64(1)
    out = [c[~end] * _M]
    code, inner = c, None
    for n in range(2, ORDERS + 1):
        if len(c) < n:
            break
        m = len(c) - n + 1
        code = (code[:m] ^ (code[:m] >> np.uint64(32))) * _M + c[n - 1 :]
        if n > 2:
            last = end[n - 2 : n - 2 + m]
            inner = last if inner is None else inner[:m] | last
        keep = ~inner if inner is not None else ~(end[:m] & end[1 : 1 + m])
        out.append(code[keep] * _M)
    return out


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's n-grams in order of value, and how often each occurs."""
    word = _OTHER.sub("_", (text or "").lower()).strip("_")
    if not word:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = f"_{word}_"
    found, start = [], 0
    while start < len(word) - 1:
        stop = len(word) - 1
        if stop - start > PART and (cut := word.find("_", start + PART)) > 0:
            stop = cut
        chars = np.frombuffer(word[start : stop + 1].encode("utf-32-le"), np.uint32)
        found.append(_counted(np.concatenate(_codes(chars))))
        start = stop
    if len(found) == 1:
        return found[0]
    codes, back = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return codes, np.bincount(back, np.concatenate([n for _, n in found])).astype(np.int64)


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    start = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[start], np.diff(np.append(start, len(codes)))


def ranked(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent codes, most frequent first; ties by code."""
    if len(codes) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))][:n]


class Profiles:
    """Places of each known n-gram in each language's profile."""

    def __init__(self, lists: dict[str, np.ndarray]):
        self.langs = sorted(lists)
        self.codes = np.unique(np.concatenate([np.empty(0, np.uint64), *lists.values()]))
        self.place = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.place[np.searchsorted(self.codes, lists[lang]), k] = np.arange(len(lists[lang]))

    def nearest(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin over the next language. The score is 1 less the distance as a share of the greatest possible.
        No letter: (und, 0, 0). Ties go to the first language by name."""
        top = ranked(*grams(text), PROFILE)
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0, 0.0
        at = np.searchsorted(self.codes, top)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != top)] = len(self.codes)
        place = self.place[at]
        far = np.where(place < 0, PROFILE, np.abs(place - np.arange(len(top))[:, None])).sum(axis=0)
        score = 1 - far / (PROFILE * len(top))
        best = int(np.argmax(score))
        rest = np.delete(score, best)
        return self.langs[best], float(score[best]), float(score[best] - (rest.max() if len(rest) else 0))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages in `lang`. Rows without text or language teach nothing, empty texts nothing either; repeated rows
    count each. N-grams of equal count stand in order of their codes. No labelled row: no profile, and all texts are `und`. At most `sample` documents of each
    language are read; their n-grams are counted over whole texts. The driver gets PROFILE codes a language."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = smallest(known.select("lang", "doc_id"), ["lang"], order, sample, "doc_id").distinct()
    if ids.count() <= 1_000_000:  # `sample` ids a language; a hundred languages and more are broadcast
        ids = F.broadcast(ids)
    chosen = smallest(known.join(ids, ["lang", "doc_id"], "left_semi"), ["lang"], [*order, F.xxhash64("text")], sample, "doc_id")

    def work():
        def step(rows):
            by: dict[str, list] = {}
            for k, t in zip(rows["lang"], rows["text"]):
                by.setdefault(k, []).append(grams(t))
            out = {"lang": [], "code": [], "n": []}
            for k, found in by.items():
                codes, back = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                out["lang"] += [k] * len(codes)
                out["code"].append(codes.view(np.int64))
                out["n"].append(np.bincount(back, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64))
            return out | {k: np.concatenate([np.empty(0, np.int64), *out[k]]) for k in ("code", "n")}

        return step

    counts = mapped(chosen, work, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    lists: dict[str, list[tuple[int, int]]] = {}
    for r in smallest(counts, ["lang"], [F.desc("n"), F.col("code")], PROFILE, "code").collect():
        lists.setdefault(r["lang"], []).append((-r["n"], r["code"]))
    return Profiles({k: np.array([code for _, code in sorted(v)], np.int64).view(np.uint64) for k, v in lists.items()})


def predicted(docs: DataFrame, profiles: Profiles, keys: list[str], text: str = "text") -> DataFrame:
    """Columns `keys` of docs, which must not be named like the new ones, with lang_pred, score (0 to 1) and margin. Whole texts are
    read, very long ones in parts; null, empty or letterless ones are `und`, 0; equal distances give the first language by
    name. Repeated rows are judged alike. Empty docs: no rows."""
    kind = "lang_pred string, score double, margin double"

    import pandas as pd
    from pyspark.sql.pandas.functions import pandas_udf

    def name(texts):
        return pd.DataFrame([profiles.nearest(t) for t in texts], columns=["lang_pred", "score", "margin"])

    name.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    found = pandas_udf(name, kind)(F.col(text))
    return docs.select(*keys, found.alias("_found")).select(*keys, "_found.lang_pred", "_found.score", "_found.margin")


def kept(docs: DataFrame, profiles: Profiles, least: float, text: str = "text") -> DataFrame:
    """docs whose text has a letter and scores at least `least` with its language. Null, empty and letterless texts go. All columns
    stay as they are, whatever their names; repeated rows are judged alike. Empty docs: no rows."""
    import pandas as pd
    from pyspark.sql.pandas.functions import pandas_udf

    def near(texts):
        found = [profiles.nearest(t) for t in texts]
        return pd.Series([lang != UNKNOWN and score >= least for lang, score, _ in found], dtype=bool)

    near.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return docs.filter(pandas_udf(near, "boolean")(F.col(text)))


def trained(spark: SparkSession, sf_dir: str) -> Profiles:
    """Learned from documents whose crc32(doc_id as text) mod 4 is not 2."""
    return learn(table(spark, sf_dir, "documents").filter(remainder(F.col("doc_id"), 4) != 2))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = predicted(table(spark, sf_dir, "documents"), trained(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "margin")
