"""Folded view of source files: signatures and short parts stay, long bodies and gaps become one line.

Every line of a file gets one state in a table, painted from the symbols' line intervals, the innermost and the earlier of
equals on top. What is written, and the numbers of kept and elided lines, are then read off runs of equal states. Each file
is folded by itself, so any number of files is one mapping step."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines a body, and lines with text a gap, may have and stay; top-level symbols shown.
BODY, GAP, TOP = 2, 8, 800
#: States of a line: outside all shown symbols, shown as it is, left out without a note. From FOLDED on: the head of symbol state - FOLDED.
LOOSE, SHOWN, LEFT_OUT, FOLDED = range(4)
#: What the view says in place of lines and symbols, fixed by its format.
ELIDED, BODY_OF, MORE = "// … {} lines elided", "{{ … {} lines }}", "// … {} more symbol{} elided (max_symbols={})"


@dataclass
class _Part:
    name: str
    kind: str
    start: int
    end: int
    visibility: str
    first: int = 0
    last: int = 0
    head: int = 0
    head_end: int = 0
    doc: int = 0
    number: int = 0
    parts: list[_Part] = field(default_factory=list)
    shown: bool = True

    @property
    def body(self) -> int:
        return max(0, self.last - self.head)


class _Source:
    def __init__(self, content: bytes, lang: str | None):
        self.content = content
        self.lines = content.split(b"\n")
        if self.lines and not self.lines[-1]:
            self.lines.pop()
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.comment = re.compile(rb"#") if lang == "python" else re.compile(rb"//|/\*|\*|.*\*/$") if lang else re.compile(rb"(?!)")

    def line(self, place: int) -> int:
        return max(0, min(bisect.bisect_right(self.starts, min(place, len(self.content))) - 1, len(self.lines) - 1)) if self.lines else 0

    def text(self, k: int) -> str:
        return self.lines[k].decode("utf-8", "replace")

    def measure(self, p: _Part) -> None:
        p.first, p.last = self.line(p.start), self.line(max(p.start, p.end - 1))
        # a signature ends at the first brace or semicolon, or at a colon that ends a line
        body = self.content[p.start : min(p.end, len(self.content))]
        stop = re.search(rb"[{;]|:(?=\n|\Z)", body)
        p.head_end = p.start + (stop.start() if stop else len(body))
        p.head = self.line(p.head_end)
        p.doc = p.first
        while p.doc and self.lines[p.doc - 1].strip() and self.comment.match(self.lines[p.doc - 1].strip()):
            p.doc -= 1


def _nested(parts: list[_Part]) -> list[_Part]:
    """Top-level parts; each part goes into the shortest one strictly around it, or to the top where two such are equally short."""
    top = []
    for p in parts:
        around = [q for q in parts if q.start <= p.start and p.end <= q.end and (q.start, q.end) != (p.start, p.end)]
        size = min((q.end - q.start for q in around), default=None)
        near = [q for q in around if q.end - q.start == size]
        (near[0].parts if len(near) == 1 else top).append(p)
    return top


def _visible(parts: list[_Part], private: bool) -> None:
    """Parts that are shown: all with `private`, else public ones and those around them."""
    for p in parts:
        _visible(p.parts, private)
        p.shown = private or p.visibility == "Public" or any(q.shown for q in p.parts)


def _states(lines: int, parts: list[_Part]) -> list[int]:
    """The state of each line. Parts are painted from the last to the first, so the earlier of two that share a line has it."""
    table = [LOOSE] * lines

    def fill(a: int, b: int, state: int) -> None:
        if a < b:
            table[a:b] = [state] * (b - a)

    def paint(p: _Part) -> None:
        end = p.last + 1
        if not p.shown:
            fill(p.doc, end, LEFT_OUT)
            return
        inner = [q for q in p.parts if q.shown]
        fill(p.doc, end, LOOSE if inner else SHOWN)
        if inner:
            table[p.last] = SHOWN  # an inner part that ends there has the line
            for q in reversed(p.parts):
                paint(q)
            fill(p.doc, min(p.head + 1, end), SHOWN)
        elif p.body > BODY:
            fill(p.head + 1, end, LEFT_OUT)
            table[p.head] = FOLDED + p.number

    for p in reversed(parts):
        paint(p)
    return table


def fold(content: bytes, symbols: list[tuple], lang: str | None = None, private: bool = True, top: int = TOP) -> dict:
    """skeleton, symbols (name, kind, line_start, line_end, body_lines, has_body), kept and elided lines, which add up to
    the file's. symbols: (name, kind, byte_start, byte_end, visibility); top 0: no limit on shown top-level symbols."""
    src = _Source(content, lang)
    parts = [_Part(*s) for s in sorted(symbols, key=lambda s: (s[2], s[3]))]
    for n, p in enumerate(parts):
        src.measure(p)
        p.number = n
    tree = _nested(parts)
    _visible(tree, private)
    beyond = [p for p in tree if p.shown][top:] if top else []
    todo = list(beyond)
    while todo:
        p = todo.pop()
        p.shown = False
        todo += p.parts
    out: list[str] = []
    kept = at = 0
    for state, run in groupby(_states(len(src.lines), tree)):
        first, at = at, at + len(list(run))
        lines = src.lines[first:at]
        if state >= FOLDED:
            p = parts[state - FOLDED]
            out.append(content[src.starts[p.head] : p.head_end].decode("utf-8", "replace") + BODY_OF.format(p.body))
        elif state == LOOSE and sum(map(bool, map(bytes.strip, lines))) > GAP:
            out.append(ELIDED.format(len(lines)))
            continue
        elif state == LEFT_OUT:
            continue
        else:
            out += map(src.text, range(first, at))
        kept += len(lines)
    if beyond:
        out.append(MORE.format(len(beyond), "s" * (len(beyond) != 1), top))
    index = [(p.name, p.kind, p.first + 1, p.last + 1, p.body, p.body > 0) for p in parts if p.shown]
    return {"skeleton": "\n".join(out), "symbols": index, "kept_lines": kept, "elided_lines": len(src.lines) - kept}


OUTLINE = "path string, skeleton string, symbols array<struct<name:string,kind:string,line_start:int,line_end:int,body_lines:int,has_body:boolean>>, kept_lines int, elided_lines int"
_NAMES = ["name", "kind", "line_start", "line_end", "body_lines", "has_body"]


def outlines(files: DataFrame, symbols: DataFrame, private: bool = True, top: int = TOP) -> DataFrame:
    """The folded view of each file (path, lang, content) with its symbols (file, ...)."""
    by = symbols.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("name", "kind", "byte_start", "byte_end", "visibility")).alias("_s"))

    def run(batches):
        for pdf in batches:
            rows = []
            for path, lang, content, found in zip(pdf["path"], pdf["lang"], pdf["content"], pdf["_s"]):
                parts = [] if found is None else [(s["name"], s["kind"], s["byte_start"], s["byte_end"], s["visibility"]) for s in found]
                one = fold(bytes(content or b""), parts, lang, private, top)
                rows.append({"path": path} | one | {"symbols": [dict(zip(_NAMES, s)) for s in one["symbols"]]})
            yield pd.DataFrame(rows, columns=["path", "skeleton", "symbols", "kept_lines", "elided_lines"])

    return files.join(by, "path", "left").select("path", "lang", "content", "_s").mapInPandas(run, OUTLINE)
