"""Facts of external indexers: symbol names made canonical, and places made bytes.

A symbol is `scheme manager package version descriptors` with spaces doubled inside a part, a point for an absent part, or
`local <id>`. Descriptors end in / # . : ! or, for methods, (disambiguator). ; [x] is a type parameter and (x) a
parameter; names between backticks may hold anything, backticks doubled."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

_PART = re.compile(r"((?:[^ ]|  )+) ")
_NAME = re.compile(r"`((?:[^`]|``)*)`|([A-Za-z0-9_+\-$]+)")
_SUFFIX = {"/": "namespace", "#": "type", ".": "term", ":": "meta", "!": "macro"}


@dataclass(frozen=True)
class Symbol:
    scheme: str
    manager: str | None
    package: str | None
    version: str | None
    descriptors: tuple[tuple[str, str, str | None], ...]

    @property
    def id(self) -> int:
        """60 bits of a hash over the parts."""
        parts = [self.scheme, self.manager or "", self.package or "", self.version or ""]
        parts += [x or "" for d in self.descriptors for x in d]
        return int(hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:15], 16)


def parse(text: str) -> Symbol:
    """ValueError where the text isn't a symbol."""
    if text.startswith("local "):
        name = text[6:]
        if not re.fullmatch(r"[A-Za-z0-9_+\-$]+", name):
            raise ValueError(f"bad local symbol: {text}")
        return Symbol("local", None, None, None, ((name, "local", None),))
    at, parts = 0, []
    for _ in range(4):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"too few parts: {text}")
        parts.append(m[1].replace("  ", " "))
        at = m.end()
    found = []
    while at < len(text):
        opened = text[at] if text[at] in "[(" else ""
        m = _NAME.match(text, at + bool(opened))
        if not m:
            raise ValueError(f"bad name: {text}")
        name = m[1].replace("``", "`") if m[1] is not None else m[2]
        at = m.end()
        if opened:
            if text[at : at + 1] != {"[": "]", "(": ")"}[opened]:
                raise ValueError(f"open bracket: {text}")
            found.append((name, "type parameter" if opened == "[" else "parameter", None))
            at += 1
        elif method := re.compile(r"\(([A-Za-z0-9_+\-$]*)\)\.").match(text, at):
            found.append((name, "method", method[1] or None))
            at = method.end()
        elif text[at : at + 1] in _SUFFIX and at < len(text):
            found.append((name, _SUFFIX[text[at]], None))
            at += 1
        else:
            raise ValueError(f"bad end of name: {text}")
    if not found:
        raise ValueError(f"no descriptor: {text}")
    scheme, *rest = parts
    return Symbol(scheme, *(None if p == "." else p for p in rest), tuple(found))


def byte_place(line: bytes, column: int, encoding: str) -> int:
    """Bytes before a column that counts UTF-8, UTF-16 or UTF-32 units; the line's end for one beyond it."""
    if encoding == "utf8":
        return min(column, len(line))
    units, at = 0, 0
    for c in line.decode("utf-8", "replace"):
        if units >= column:
            break
        units += 2 if encoding == "utf16" and ord(c) > 0xFFFF else 1
        at += len(c.encode())
    return at


def _place(starts: list[int], content: bytes, line: int, column: int, encoding: str) -> int | None:
    if line >= len(starts):
        return None
    end = content.find(b"\n", starts[line])
    return starts[line] + byte_place(content[starts[line] : end if end >= 0 else len(content)], column, encoding)


def occurrences(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """raw (path, symbol, start_line, start_col, end_line, end_col, roles, encoding) with lines from 0, as (path, sym, bs, be,
    roles); rows whose symbol or place is malformed are dropped. sources: path, content."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                content = bytes(r.content)
                starts = [0, *(m.end() for m in re.finditer(b"\n", content))]
                a = _place(starts, content, r.start_line, r.start_col, r.encoding)
                b = _place(starts, content, r.end_line, r.end_col, r.encoding)
                try:
                    sym = f"{parse(r.symbol).id:015x}"
                except ValueError:
                    continue
                if a is not None and b is not None and a <= b:
                    rows.append((r.path, sym, a, b, r.roles))
            yield pd.DataFrame(rows, columns=["path", "sym", "bs", "be", "roles"])

    columns = ["path", "content", "symbol", "start_line", "start_col", "end_line", "end_col", "roles", "encoding"]
    return raw.join(sources.select("path", "content"), "path").select(*columns).mapInPandas(run, "path string, sym string, bs long, be long, roles int")
