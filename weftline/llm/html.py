"""Main text of web pages: a bidirectional LSTM in numpy labels the blocks of a page as article or furniture.

A page is read into its leaf blocks, each with the path of open elements (tag, class and id words) and its text. A block's
vector hashes the path and the words and adds length, link share, punctuation and place. One LSTM reads the blocks forwards
and one backwards, so every label depends on the whole page. The model learns from a bounded sample of pages: those that mark
their main text (an article or main element, or one named so) give blocks labelled by that, and the texts of all of them
are set into made-up layouts, whose main text is known whatever its elements are called: in a good part of them neither
main text nor furniture has a telling name, so that length, links, punctuation, place and neighbours have to tell."""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import mapped, sampled, table

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[^<]++|<""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements whose text runs on in the block around them; all others end it.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template iframe object svg math".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Open elements that a start tag of the name closes, up to the nearest of the second set.
CLOSES = {"p": ({"p"}, {"div", "article", "section", "td", "li", "body", "blockquote"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

PATH, WORDS, EXTRA, HIDDEN = 128, 32, 4, 24
#: Bounds of learning: pages (those of least xxhash64(page_id)), made-up layouts a page, rounds. A longer page is learned in
#: sequences of BLOCKS blocks.
PAGES, LAYOUTS, BLOCKS, ROUNDS = 200, 5, 96, 10
#: Blocks, with padding, that the network reads at once; a longer page is read alone.
AT_ONCE = 1 << 13
#: Marks main text in made-up layouts (a private character).
_MAIN = "\ue000"


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of linked characters) of each leaf block with text, in page order. Character references are decoded
    and runs of white space made one space; comments, scripts and styles are left out. A line break ends a block."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = 0
    skip = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((tuple(t for _, names in stack for t in names), text, min(1.0, linked / len(text))))
            held.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal skip
        if any(name not in INLINE for name, _ in stack[at:]):
            flush()
        skip -= sum(name in DROPPED for name, _ in stack[at:])
        del stack[at:]

    page = page or ""
    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        name = m[2]
        if name is None:
            text = m[0]
            if not skip and (text[0] != "<" or text == "<"):
                text = entities.unescape(text) if "&" in text else text
                held.append(text)
                if any(n == "a" for n, _ in stack):
                    linked += len(text)
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                flush()
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == name:
                    close(at)
                    break
            else:
                if name not in INLINE:
                    flush()
            continue
        if name not in INLINE:
            flush()
        ends, within = CLOSES.get(name, (None, None))
        if name in ENDS_P:
            ends, within = CLOSES["p"]
        if ends:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] in within:
                    break
                if stack[at][0] in ends:
                    close(at)
                    break
        if name in VOID or m[3].endswith("/"):
            continue
        names = [f"t:{name}"]
        if m[3]:
            for a, b, c in _NAMES.findall(m[3]):
                names += [f"c:{w}" for w in re.findall(r"[a-z]+", (a or b or c).lower())]
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, pos)
            inner, pos = page[pos : end.start() if end else size], end.end() if end else size
            text = "" if name in DROPPED or skip else " ".join(entities.unescape(inner).split())
            if text:
                out.append((tuple(t for _, x in stack for t in x) + tuple(names), text, 0.0))
            continue
        stack.append((name, tuple(names)))
        skip += name in DROPPED
    flush()
    return out


class _Places(dict):
    """Hashed place of a path name or word."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, name: str) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[name] = xxhash.xxh64_intdigest(name) % self.size
        return found


_path_place, _word_place = _Places(PATH), _Places(WORDS)


def vectors(found: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    x = np.zeros((len(found), PATH + WORDS + EXTRA), np.float32)
    for k, (path, text, link) in enumerate(found):
        for name in path:
            x[k, _path_place[name]] = 1
        words = text.split(" ")
        # word counts of the whole block, as a vector of length 1
        n = np.bincount([_word_place[w] for w in words], minlength=WORDS)
        x[k, PATH : PATH + WORDS] = n / np.sqrt((n * n).sum())
        x[k, PATH + WORDS :] = (min(len(words), 100) / 100, link, min(1.0, 5 * sum(map(text.count, ".,;:!?")) / len(text)), k / len(found))
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output. Sequences are arrays (time, batch, vector); mask marks real blocks."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN, size: int = PATH + WORDS + EXTRA):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, 0.1, (size, 4 * hidden))
            self.p[f"h{d}"] = r.normal(0, 0.1, (hidden, 4 * hidden))
            self.p[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.p["o"] = r.normal(0, 0.1, 2 * hidden)
        self.p["ob"] = np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        h = self.h
        drive = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        state, cell = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
        out = np.zeros((*x.shape[:2], h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = drive[t] + state @ self.p[f"h{d}"]
            gates, new = _sigmoid(g[:, : 3 * h]), np.tanh(g[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            m = mask[t][:, None]
            before, last = cell, state
            cell = m * (f * before + i * new)
            squash = np.tanh(cell)
            state = m * (o * squash)
            out[t] = state
            if keep is not None:
                keep.append((t, i, f, o, new, before, last, squash, m))
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run("f", x, mask), self._run("b", x, mask)], axis=2)
        return _sigmoid(both @ self.p["o"] + self.p["ob"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept = {"f": [], "b": []}
        both = np.concatenate([self._run(d, x, mask, kept[d]) for d in "fb"], axis=2)
        err = (_sigmoid(both @ self.p["o"] + self.p["ob"]) - y) * mask / mask.sum()
        out = {"o": np.einsum("tb,tbh->h", err, both), "ob": np.array([err.sum()])}
        h = self.h
        for k, d in enumerate("fb"):
            wx, wh = self.p[f"x{d}"], self.p[f"h{d}"]
            push = err[:, :, None] * self.p["o"][k * h : (k + 1) * h]
            gx, gh, gc = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * h, np.float32)
            ds, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for t, i, f, o, new, before, last, squash, m in reversed(kept[d]):
                s = (push[t] + ds) * m
                c = (dc + s * o * (1 - squash**2)) * m
                g = np.concatenate([c * new * i * (1 - i), c * before * f * (1 - f), s * squash * o * (1 - o), c * i * (1 - new**2)], axis=1)
                gx += x[t].T @ g
                gh += last.T @ g
                gc += g.sum(axis=0)
                ds, dc = g @ wh.T, c * f
            out |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        return out

    def fit(self, data: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, batch: int = 16, rate: float = 0.01, seed: int = 7) -> None:
        """Adam over batches of sequences of like length."""
        r = random.Random(seed)
        m, v, t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(rounds):
            data = sorted(data, key=lambda s: len(s[0]) + r.random() * 8)
            parts = [data[k : k + batch] for k in range(0, len(data), batch)]
            r.shuffle(parts)
            for part in parts:
                x, mask = padded([s for s, _ in part])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, labels) in enumerate(part):
                    y[: len(labels), k] = labels
                t += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def dump(self) -> bytes:
        return b"".join(self.p[k].tobytes() for k in sorted(self.p))

    @classmethod
    def load(cls, data: bytes) -> Labeller:
        made, at = cls(), 0
        for k in sorted(made.p):
            shape, n = made.p[k].shape, made.p[k].nbytes
            made.p[k] = np.frombuffer(data[at : at + n], np.float32).reshape(shape)
            at += n
        return made


def padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, seqs))
    x, mask = np.zeros((n, len(seqs), seqs[0].shape[1]), np.float32), np.zeros((n, len(seqs)), np.float32)
    for k, s in enumerate(seqs):
        x[: len(s), k], mask[: len(s), k] = s, 1
    return x, mask


#: Class and id words of page furniture and of main text, as pages in the wild use them.
FURNITURE = "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie disclaimer footer form login menu modal nav navbar navigation newsletter notice popup promo related search share sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
MAIN = "article content entry main post story".split()
_BAD = {f"c:{w}" for w in FURNITURE} | {f"t:{t}" for t in ("nav", "footer", "aside", "form", "button", "select", "textarea", "title", "head", "dialog")}


def structural(path: tuple[str, ...]) -> int:
    """1 for a block in an article or main element (or one named so) and in no furniture."""
    inside = any(p in ("t:article", "t:main") or p[2:] in MAIN and p[0] == "c" for p in path)
    head = "t:header" in path and not ("t:article" in path and path.index("t:article") < path.index("t:header"))
    return int(inside and not head and not any(p in _BAD for p in path))


def layout(r: random.Random, texts: list[str]) -> str:
    """A made-up page around the texts, whose main text starts with _MAIN in each block."""
    say = lambda: " ".join(r.choice(texts).split()[: r.randint(2, 40)])
    short = lambda: " ".join(r.choice(texts).split()[: r.randint(1, 4)])
    wrap = lambda tag, name, inner: f'<{tag} {r.choice(("class", "id"))}="{name}">{inner}</{tag}>'
    par = lambda: "".join(f"<p>{say()}</p>" for _ in range(r.randint(1, 4)))
    links = lambda: "<ul>" + "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(r.randint(2, 7))) + "</ul>"
    told = r.random() < 0.6  # whether names tell main text from furniture
    plain = lambda inner: f"<div>{inner}</div>" if r.random() < 0.6 else wrap("div", r.choice(("a", "b1", "col", "inner", "row", "text", "wrap", "x")), inner)

    def extra() -> str:
        name = r.choice(FURNITURE)
        if r.random() < 0.4:
            name += r.choice(("-box", "-block", " wide", "_item", "-list"))
        kind = r.random()
        if not told and kind < 0.7:  # short and linked, in elements without a telling name
            return plain("".join(plain(f"<a href=/x>{short()}</a>") for _ in range(r.randint(1, 5))) if r.random() < 0.5 else r.choice((links, short))())
        if kind < 0.2:
            return f"<nav>{links()}</nav>"
        if kind < 0.3:
            return f"<aside>{r.choice((par, links))()}</aside>"
        if kind < 0.4:
            return f"<form><label>{short()}</label><input name=q><button>{short()}</button></form>"
        return wrap(r.choice(("div", "section", "div", "ul")), name, r.choice((par, links, say))())

    body = [f"<h1>{_MAIN}{short()}</h1>"] if r.random() < 0.9 else []
    for _ in range(r.randint(1, 10)):
        kind = r.random()
        one = lambda: _MAIN + say()
        body.append(
            (f"<p>{one()}</p>" if told or r.random() < 0.5 else f"<div>{one()}</div>") if kind < 0.5 else f"<p><b>{one()}<br>" if kind < 0.65 else f"<h2>{_MAIN}{short()}</h2>" if kind < 0.72
            else f"<blockquote>{one()}</blockquote>" if kind < 0.78 else f"<ul><li>{one()}</li><li>{one()}</li></ul>" if kind < 0.85 else extra() if kind < 0.95 else f"<div>{one()}</div>"
        )
    inner = "".join(body)
    kind = r.random()
    main = plain(inner) if not told else f"<article>{inner}</article>" if kind < 0.5 else f"<main>{inner}</main>" if kind < 0.65 else f"<main><article>{inner}</article></main>" if kind < 0.75 else wrap(r.choice(("div", "section")), r.choice(MAIN), inner)
    before = "".join(extra() for _ in range(r.randint(0, 3)))
    head = f"<header>{r.choice((short, links))()}</header>" if r.random() < 0.5 else ""
    after = "".join(extra() for _ in range(r.randint(0, 3))) + (wrap("section", r.choice(("comments", "comment-list")), "".join(f"<div class=comment><p>{say()}</p></div>" for _ in range(r.randint(1, 4)))) if r.random() < 0.5 else "")
    foot = f"<footer>{say()}</footer>" if r.random() < 0.7 else ""
    return f"<html><head><title>{short()}</title></head><body>{head}{before}{main}{after}{foot}</body></html>"


def labelled(found: list[tuple[tuple[str, ...], str, float]]) -> tuple[list[tuple[tuple[str, ...], str, float]], list[int]]:
    """The blocks of a made-up layout without their marks, and 1 for each marked one."""
    return [(p, t.replace(_MAIN, ""), link) for p, t, link in found], [int(_MAIN in t) for _, t, _ in found]


def trained(pages: list[str], seed: int = 7) -> Labeller:
    """The model learned from sample pages; without any, from layouts of plain words. All blocks of a page are learned from."""
    r = random.Random(seed)
    data = []

    def add(found: list[tuple], labels: list[int]) -> None:
        if found:
            x, y = vectors(found), np.array(labels, np.float32)
            data.extend((x[k : k + BLOCKS], y[k : k + BLOCKS]) for k in range(0, len(found), BLOCKS))

    for page in pages:
        found = blocks(page)
        labels = [structural(p) for p, _, _ in found]
        if any(labels):  # a page without a marked main text tells nothing
            add(found, labels)
        texts = [t.replace(_MAIN, "") for _, t, _ in found] or ["word"]
        for _ in range(LAYOUTS):
            add(*labelled(blocks(layout(r, texts))))
    for _ in range(max(0, 200 - len(pages))):
        add(*labelled(blocks(layout(r, ["some plain words of a text that goes on, for a while", "more of it here."]))))
    model = Labeller(seed)
    model.fit(data)
    return model


def learn(pages: DataFrame, page_id: str = "page_id", html: str = "html", sample: int = PAGES) -> Labeller:
    """Learned in one task from at most `sample` pages, whatever the table's size."""
    chosen = sampled(pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html")).filter("html is not null"), "page_id", sample, "html")

    def run(batches):
        texts = [t for b in batches for t in b["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([trained(texts).dump()], pa.binary())], names=["model"])

    found = chosen.select("html").coalesce(1).mapInArrow(run, "model binary").collect()
    return Labeller.load(bytes(found[0]["model"])) if found else trained([])


def main_texts(model: Labeller, pages: list[str | None], batch: int = 32) -> list[str]:
    """Main text of each page: its blocks that score 0.5 or more, in page order, joined by an empty line. Pages are read by the
    network in lots of like length and at most AT_ONCE blocks, so memory follows the longest page alone."""
    found = [blocks(p) for p in pages]
    order = sorted((k for k in range(len(pages)) if found[k]), key=lambda k: len(found[k]))
    out = [""] * len(pages)
    lots: list[list[int]] = []
    for k in order:
        if lots and len(lots[-1]) < batch and (len(lots[-1]) + 1) * len(found[k]) <= AT_ONCE:
            lots[-1].append(k)
        else:
            lots.append([k])
    for lot in lots:
        score = model.forward(*padded([vectors(found[k]) for k in lot]))
        for c, k in enumerate(lot):
            out[k] = "\n\n".join(t for (_, t, _), s in zip(found[k], score[:, c]) if s >= 0.5)
    return out


def extracted(pages: DataFrame, model: Labeller, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages. A null or empty page, or one without a block, has the empty text; a
    very long one is read whole. A block that scores just 0.5 stays. Repeated rows and null page_ids are read like others.
    Only the three named columns are read, so others may have any name. Empty pages: no rows."""

    def work():
        def step(rows):
            texts = main_texts(model, rows["html"])
            return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": list(map(len, texts))}

        return step

    plain = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return mapped(plain, work, "page_id long, url string, text string, n_chars long", 128)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, learn(pages))
