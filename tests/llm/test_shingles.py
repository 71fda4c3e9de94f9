import random

import numpy as np
import pytest

import corpus_pipeline
from weftline.llm import shingles


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_copies(words):
    """Texts of 300 words, each with a copy of similarity 0.8 to 0.95, and texts just below."""
    r = random.Random(7)
    texts = []
    for k in range(60):
        base = [f"{w}{r.randint(0, 99)}" for w in r.choices(words, k=300)]
        copy = list(base)
        for at in range(10, 290, r.randint(26, 90)):
            copy[at] = f"new{k}x{at}"
        texts += [" ".join(base), " ".join(copy)]
    return texts


def kept_by_brute_force(texts):
    sets = [grams(t) for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if alike(sets[i], sets[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return sorted({x for x in label})


@pytest.mark.parametrize("bucket", [8192, 3])
def test_same_groups_as_brute_force(spark, docs_of, words, bucket):
    texts = near_copies(words)
    base = texts[0].split()
    for k in range(9):  # one group whose members meet in large buckets
        base[20 + 29 * k] = f"again{k}"
        texts.append(" ".join(base))
    texts += [None, "", " ", "two words", "Two  words", "one two three four five six"]
    got = shingles.deduplicated(docs_of(list(enumerate(texts)), True), bucket=bucket)
    assert sorted(r["doc_id"] for r in got.collect()) == kept_by_brute_force(texts)


def test_the_stage_links_near_copies(spark, docs_of, words):
    texts = near_copies(words)
    near = [k for k in range(0, len(texts), 2) if 0.8 <= alike(grams(texts[k]), grams(texts[k + 1])) <= 0.95]
    assert len(near) > 15
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs_of(list(enumerate(texts))), "").collect()}
    assert all(k in kept and k + 1 not in kept for k in near)
    assert corpus_pipeline.drop_near_duplicates(spark, docs_of([]), "").count() == 0


def test_forest_joins_all_that_is_linked():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 14, 12).astype(np.uint64)) for _ in range(80)]
    label = list(range(len(sets)))
    for i, j in shingles.forest(sets):
        assert alike({*sets[i].tolist()}, {*sets[j].tolist()}) >= 0.8
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    for i in range(len(sets)):
        for j in range(i):
            assert alike({*sets[i].tolist()}, {*sets[j].tolist()}) < 0.8 or label[i] == label[j]
