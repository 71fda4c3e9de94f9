import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftline.llm import binary, packing
from weftline.llm.tokens import Encoder

TEXTS = [None, "", " ", "\n", "a", "two words", " lead", "trail ", "a  b\n\nc\t d", "nl\nnl", "<|endoftext|> is text", "a <|endoftext|> b", "<|ENDOFTEXT|>", "<|startoftext|>x<|", "x" * 300, "don't we'll 's", "é ß Ü, œuvre. Σ ΑΣ ŉ", "a\x00b \x00", "İstanbul ﬁ ２ e\u0301", "words,. and;: marks!?", "１２ 3.4", "日本 語", "a\u00a0b\u2003c"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    e = Encoder(path)
    want = [x.ids for x in plain.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(TEXTS)] == want
    assert [x.tolist() for x in e.encode(TEXTS[::-1])] == want[::-1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("cache", [40, 800_000])
def test_encoder_equals_the_library_on_random_texts(name, cache, monkeypatch):
    from weftline.llm import tokens

    monkeypatch.setattr(tokens, "CACHE", cache)  # a small cache is emptied over and over
    monkeypatch.setattr(tokens, "CALL", 50)
    r = random.Random(5)
    marks = ["a", "Zz", "é", "ß", "'s", ".", ",!", " ", " ", " ", "\n", "\t", "7", "½", "中", "\u0301", "\x00", "\x01", "\xa0", "\u2028", "word", "other", "<|", "|>", "endoftext", "x" * 60]
    texts = ["".join(r.choices(marks, k=r.randint(0, 40))) for _ in range(600)] + [" ".join(r.choices(["one", "two,", "thrée", "(four)", "five's"], k=r.randint(1, 60))) for _ in range(200)]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    e = Encoder(public_tokenizers.path(name))
    for k in range(0, len(texts), 50):
        part = texts[k : k + 50]
        assert [x.tolist() for x in e.encode(part)] == [plain.encode(t, add_special_tokens=False).ids for t in part]


@pytest.mark.parametrize("n,pieces", [(1, [(0, 1)]), (2048, [(0, 2048)]), (2049, [(0, 1), (1, 2048)]), (5000, [(0, 904), (904, 2048), (2952, 2048)])])
def test_cut(n, pieces):
    assert packing.cut(n) == pieces


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_respects_every_capacity(rule):
    lengths = np.random.default_rng(1).integers(1, 100, 400)
    for capacity in ((100, 1000, 10**6), (100, 3, 10**6), (100, 1000, 6000)):
        sequence, offset = packing.best_fit(lengths, capacity, (1, 1, 1), rule)
        for s in range(sequence.max() + 1):
            own = np.flatnonzero(sequence == s)
            n = lengths[own]
            assert len(own) == 1 or (n.sum() <= capacity[0] and len(n) <= capacity[1] and (n**2).sum() <= capacity[2])
            at = np.argsort(offset[own])
            assert (offset[own][at] == np.cumsum(n[at]) - n[at]).all()
    tight = packing.best_fit(lengths, (100, 1000, 10**6))[0].max() + 1
    left: list[int] = []  # plain best fit by tokens alone
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [k for k, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits, key=left.__getitem__)] -= n
        else:
            left.append(100 - n)
    assert tight <= 1.02 * len(left)
    assert len(packing.best_fit(np.empty(0, np.int64))[0]) == 0


def test_packing_covers_every_id(spark, docs_of):
    rows = [(1, None), (2, "word " * 5000), (3, "some text"), (3, "some text"), (4, ""), (None, "no id")]
    got = packing.pack(docs_of(rows, True), public_tokenizers.path("byte_bpe_50k.json")).collect()
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.append(e.encode([t])[0], 0).astype("<u4") for d, t in rows}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in got) == sum(len(ids[d]) for d, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    assert packing.pack(docs_of([]), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_small_groups_do_not_mix_places(spark, docs_of):
    rows = [(d, "w " * (d % 40)) for d in range(300)]
    got = packing.pack(docs_of(rows), public_tokenizers.path("byte_bpe_50k.json"), capacity=(64, 64, 4096), group=50)
    used = got.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in used) <= 64 and got.count() == 300


def test_files_give_back_the_ids(spark, docs_of, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(7, "Some Words here"), (3, None), (3, ""), (-5, "x y"), (None, "no id"), (9, "long " * 3000)]
    binary.write(docs_of(rows, True), f"file://{tmp_path}/ids", path)
    got = binary.read(spark, f"file://{tmp_path}/ids").orderBy("start").collect()
    e = Encoder(path)
    want = sorted(((d if d is not None else -(1 << 63)), [*map(int, e.encode([t])[0]), 1]) for d, t in rows)
    assert [((r["doc_id"] if r["doc_id"] is not None else -(1 << 63)), list(r["ids"])) for r in got] == want
    assert [r["start"] for r in got] == [sum(len(i) for _, i in want[:k]) for k in range(len(want))]
    assert binary.get(spark, f"file://{tmp_path}/ids", 7) == dict(want)[7]
    with pytest.raises(LookupError):
        binary.get(spark, f"file://{tmp_path}/ids", 8)
    binary.write(docs_of([]), f"file://{tmp_path}/none", path)
    assert binary.digests(spark, f"file://{tmp_path}/none").count() == 0


def test_shard_needs_its_dictionary():
    import zstandard

    frame = zstandard.ZstdCompressor().compress(np.array([1, 2], "<u2").tobytes())
    data = binary.shard([4], [2], [frame], 2, 0, 0)
    assert binary.Shard(data, b"").ids(0).tolist() == [1, 2]
    with pytest.raises(ValueError):
        binary.Shard(data, b"another")


def test_dictionary_of_few_samples_is_their_bytes():
    import zstandard

    for samples in ([], [b"\x01\x00"], [bytes(range(200))] * 3):
        dictionary = binary.trained(samples, b"\x01\x00")
        raw = b"".join(samples) + bytes(range(100))
        frame = binary._compressor(dictionary).compress(raw)
        assert zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(frame) == raw
    assert binary.trained([bytes([k, k // 3] * 50) for k in range(256)] * 8, b"\x01\x00")


def test_least_id_and_no_id_are_told_apart(spark, docs_of, tmp_path):
    low = -(1 << 63)
    binary.write(docs_of([(low, "least"), (None, "none"), (None, ""), (5, "five")]), f"file://{tmp_path}/ids", public_tokenizers.path("word_bpe_49k.json"))
    got = binary.read(spark, f"file://{tmp_path}/ids").collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == [(False, 0), (False, 0), (True, low), (True, 5)]
    assert len(binary.get(spark, f"file://{tmp_path}/ids", low)) == 2


def test_queries(spark):
    """Both queries against the library alone, one call a text."""
    folder = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    start = 0
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in binary.op4_binary(spark, folder).orderBy("doc_id").collect():
        ids = np.array([*plain.encode(text[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for d, t in text.items():
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want |= {(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))}
    got = packing.op2_packing(spark, folder)
    rows = got.collect()
    assert {tuple(r[:5]) for r in rows} == want and len(rows) == len(want)
    total = got.agg({"length": "sum"}).first()[0]
    assert got.select("sequence_id").distinct().count() <= 1.02 * total / 2048 + 1
