import pytest
import re
import random
from collections import Counter

import numpy as np

from weftline.llm import langid


def test_grams_against_plain_count():
    text = "Ab-aB, zoë"
    grams = Counter()
    for w in ("ab", "ab", "zoë"):
        w = f"_{w}_"
        grams.update(w[i : i + n] for n in range(1, 6) for i in range(len(w) - n + 1) if w[i : i + n] != "_")
    codes, counts = langid.grams(text)
    assert sorted(counts.tolist()) == sorted(grams.values())
    long = "one two three " * 60_000
    old, langid.PART = langid.PART, 1 << 30
    whole = langid.grams(long)
    langid.PART = old
    parts = langid.grams(long)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_distance_is_out_of_place():
    lists = {"x": np.array([1, 2, 3], np.uint64), "y": np.array([3, 9, 1], np.uint64)}
    p = langid.Profiles(lists)
    assert p.place[np.searchsorted(p.codes, np.uint64(3))].tolist() == [2, 0] and p.place[np.searchsorted(p.codes, np.uint64(9))].tolist() == [-1, 1]


def test_held_out_accuracy_and_cases(spark):
    folder = "/root/testdata/sf0.01"
    got = langid.op1_language(spark, folder).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and 0.15 < len(held) / len(got) < 0.35
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nulls_and_empty_tables(spark, docs_of):
    none = langid.learn(docs_of([]))
    docs = docs_of([(1, None), (2, ""), (3, "12 !?"), (4, "some words"), (4, "some words")], True)
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predicted(docs, none, ["doc_id"]).collect()} == {(d, "und", 0.0) for d in (1, 2, 3, 4)}
    some = langid.learn(docs.withColumn("lang", docs["lang"]))
    assert some.langs == ["en"]
    assert [r["doc_id"] for r in langid.kept(docs, some, 0.1).collect()] == [4, 4]
    assert langid.predicted(docs_of([]), some, ["doc_id"]).count() == 0


def plain_nearest(text, lists):
    """Out-of-place distances from strings and dictionaries. Ties of counts stand in order of the n-grams' codes, as in a profile."""
    word = re.sub(r"[\W\d_]+", "_", (text or "").lower()).strip("_")
    counts = Counter()
    for w in word.split("_") if word else []:
        w = f"_{w}_"
        counts.update(g for n in range(1, 6) for g in (w[k : k + n] for k in range(len(w) - n + 1)) if g.strip("_"))
    own = sorted(counts, key=lambda g: (-counts[g], code_of(g)))[: langid.PROFILE]
    if not own:
        return "und", 0.0
    far = {name: sum(abs(place[code_of(g)] - k) if code_of(g) in place else langid.PROFILE for k, g in enumerate(own)) for name, place in lists.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (langid.PROFILE * len(own))


def code_of(gram):
    """Code of one n-gram; an n-gram of one letter has that letter alone."""
    c = np.array([ord(x) for x in gram], np.uint32)
    found = langid._codes(c)[len(gram) - 1]
    assert len(found) == 1
    return int(found[0])


def test_nearest_against_a_plain_distance(spark, words):
    r = random.Random(8)
    other = ["".join(r.choices("xyzqvw", k=r.randint(1, 6))) for _ in range(60)]
    rows = [(k, " ".join(r.choices(words if k % 2 else other, k=80)), "ab"[k % 2]) for k in range(40)]
    profiles = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    lists = {name: {int(profiles.codes[k]): int(profiles.place[k, c]) for k in range(len(profiles.codes)) if profiles.place[k, c] >= 0} for c, name in enumerate(profiles.langs)}
    assert {len(v) for v in lists.values()} == {langid.PROFILE}
    texts = [" ".join(r.choices(words + other, k=r.randint(1, 60))) for _ in range(60)] + ["", None, "12 !", "é", "A'b c-D", "word " * 400]
    for t in texts:
        lang, score, _ = profiles.nearest(t)
        want = plain_nearest(t, lists)
        assert score == pytest.approx(want[1]) and lang == want[0]
