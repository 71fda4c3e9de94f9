"""Ids of public tokenizers, with a cache of words.

Both vocabularies cut a text into runs before they merge anything, and never across white space, so a text's ids are those
of its words one after the other. Words met before come from a cache of bounded size: each has a number, and the ids of a
batch are gathered from one array by these numbers. New words of Latin-1 characters need none of the library's
normalising and cutting: they are cut here, written in the byte alphabet that the file's pre-tokenizer would have
used, and go to the file's model in one call. What is left goes through the file's own pipeline."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words in the cache, and the longest word that stays in it.
CACHE, LONGEST = 800_000, 48
_LETTERS, _DIGITS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \\t\\n\\v\\f\\r\\x85\\xa0"
_REST = rf"[^{_LETTERS}{_DIGITS}{_SPACES}\0]++"
#: Runs of Latin-1 text, with the white space that a run keeps, and without any. A null character stands between words.
_KEPT = re.compile(rf"\0|'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]++| ?[{_DIGITS}]++| ?{_REST}|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_BARE = re.compile(rf"\0|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]++|[{_DIGITS}]|{_REST}")
#: Characters of runs that go to the model in one call, and what a null character is written as.
CALL, _MARK = 4000, "\u0100"
#: Stands before a word at a text's start where a word's number depends on that.
_HEAD = "\r"


def byte_alphabet() -> dict[int, str]:
    """Byte -> character of byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """ids of texts by a `tokenizers` file as Tokenizer.encode(text, add_special_tokens=False) gives them: the template's
    special tokens are left out, and an added token's own string in a text becomes that token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: byte-level files keep white space and case: a word then has the white space before it
        self.keeps = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # a text with the first characters of an added token is left to the library; those with a case match any text
        added = [t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = sorted({a if a.lower() == a.upper() else "" for a in added})
        alphabet = byte_alphabet()
        # characters as they are written; 1 ends a run and becomes the space that sets runs apart
        written = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(256)} | {1: " "}
        self.written = {c: s for c, s in written.items() if s != chr(c)}
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        #: characters that an id stands for, in the byte alphabet
        self.covers = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.covers[k] = len(token.removesuffix(suffix)) if suffix else len(token)
        self._clear()

    def _clear(self) -> None:
        self.words = _Words()
        self.pool, self.start, self.size = np.empty(0, self.width), np.empty(0, np.int64), np.empty(0, np.int32)
        self.again = np.empty(0, bool)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)

    def _split(self, text: str) -> list[str] | None:
        """Words whose ids, joined, are the text's. For a file that keeps white space, a word stands for itself with one
        space before it, or starts with a newline, or with _HEAD at the text's start; None if the text has other white
        space than single ones between words, or what may be an added token."""
        for a in self.added:
            if a in text:
                return None
        if not self.keeps:
            return text.replace("\n", " ").split(" ")
        words = text.split()
        gaps = len(words) - 1
        lines = text.count("\n")
        if len(" ".join(words)) != len(text) or text.count(" ") + lines != max(gaps, 0):
            return None
        if lines:
            words = text.replace("\n", " \n").split(" ")
        if words:
            words[0] = _HEAD + words[0]
        return words

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of Latin-1 characters, none of which is null or U+0001, joined, and each word's number of ids."""
        text = "\0".join(words) if self.keeps else "\0".join(words).lower()
        text = "\1".join((_KEPT if self.keeps else _BARE).findall(text)).translate(_Table(self.written))
        code = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        mark = code == ord(_MARK)
        ends = np.append(np.cumsum(~mark & (code != 32))[mark], np.count_nonzero(~mark & (code != 32)))
        text = text.replace(_MARK, "")
        cuts = [0]
        while cuts[-1] < len(text):
            at = text.find(" ", cuts[-1] + CALL)
            cuts.append(at if at >= 0 else len(text))
        found = self.bare.encode_batch_fast([text[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), self.width)
        size = np.diff(np.searchsorted(np.cumsum(self.covers[ids]), ends, "right"), prepend=0)
        return ids, size

    def _learn(self, new: list[str]) -> None:
        """Adds the ids of the words numbered last."""
        lead = [w[1:] if w[0] == _HEAD else w if w[0] == "\n" else " " + w for w in new] if self.keeps else new
        try:
            "".join(lead).encode("latin-1")
            plain = None
        except UnicodeEncodeError:
            plain = [k for k, w in enumerate(lead) if max(w, default="") <= "\xff"]
        if "\0" in (text := "".join(lead)) or "\1" in text:
            plain = [k for k in (range(len(lead)) if plain is None else plain) if "\0" not in lead[k] and "\1" not in lead[k]]
        if plain is None:
            ids, size = self._merged(lead)
        else:
            found = dict.fromkeys(range(len(lead)))
            if plain:
                ids, n = self._merged([lead[k] for k in plain])
                found.update(zip(plain, np.split(ids, np.cumsum(n)[:-1])))
            rest = [k for k, v in found.items() if v is None]
            for k, e in zip(rest, self.tokenizer.encode_batch_fast([lead[k] for k in rest], add_special_tokens=False)):
                found[k] = np.array(e.ids, self.width)
            size = np.array([len(v) for v in found.values()])
            ids = np.concatenate(list(found.values()))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.pool = np.concatenate([self.pool, ids])
        self.again = np.concatenate([self.again, np.zeros(len(size), bool)])

    def _shrink(self) -> None:
        """Leaves the words that were met in two batches or more since the last time."""
        keep = [w for w, again in zip(self.words, self.again.tolist()) if again and len(w) <= LONGEST]
        if len(keep) > CACHE // 2:
            return self._clear()
        at = np.fromiter(map(self.words.__getitem__, keep), np.int64, len(keep))
        self.pool, size = self._gathered(at), self.size[at]
        self.words = _Words(zip(keep, range(len(keep))))
        self.start, self.size, self.again = np.cumsum(size) - size, size, np.zeros(len(keep), bool)

    def _gathered(self, at: np.ndarray) -> np.ndarray:
        size = self.size[at]
        end = np.cumsum(size, dtype=np.int64)
        return self.pool[np.repeat(self.start[at] - end + size, size) + np.arange(end[-1] if len(end) else 0)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as an array of `width`; a null text has none."""
        texts = [t or "" for t in texts]
        split = [self._split(t) if t else [] for t in texts]
        n = [len(words or ()) for words in split]
        if len(self.words) > CACHE:
            self._shrink()
        before = len(self.words)
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(words or () for words in split)), np.int64, sum(n))
        if before:
            self.again[at[at < before]] = True
        if self.words.new:
            self._learn(self.words.new)
            self.words.new = []
        ids = self._gathered(at)
        cut = np.concatenate([[0], np.cumsum(self.size[at], dtype=np.int64)])[np.concatenate([[0], np.cumsum(n, dtype=np.int64)])].tolist()
        return [self.whole(t) if words is None else ids[a:b] for t, words, a, b in zip(texts, split, cut, cut[1:])]


class _Words(dict):
    """Number of each word; a new one takes the next and is listed in `new`."""

    def __init__(self, *known):
        super().__init__(*known)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


class _Table(dict):
    """Characters without another form stand for themselves."""

    def __missing__(self, c: int) -> int:
        self[c] = c
        return c


_open: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder of the file, kept between tasks with its words."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
