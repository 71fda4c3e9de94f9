"""Syntactic facts of source files.

Python is read with the interpreter's own parser. The other languages are read by patterns over text whose comments
and strings are blanked out, which finds declarations with braces and calls, and can miss or misplace unusual forms.
All places are byte offsets."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

HOOK = re.compile(r"^(use[A-Z]|createSignal|createEffect|createMemo|createResource)")
_NAME = r"[A-Za-z_$][\w$]*"
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "match", "loop", "fn", "func", "function", "new", "sizeof", "foreach", "using", "lock", "typeof", "await", "else", "do", "def", "pub", "class", "super", "this", "when"}
# Decision words of each language's complexity (with and/or operators besides).
DECISIONS = {
    "rust": r"\b(?:if|while|loop|for)\b|=>|\?(?=[;,.)\s])",
    "javascript": r"\b(?:if|while|do|for|case|catch)\b|\?(?![.?:])",
    "go": r"\b(?:if|for|case)\b",
    "java": r"\b(?:if|while|do|for|case|catch)\b|\?(?![.?:,>])",
    "kotlin": r"\b(?:if|while|do|for|catch)\b|->",
    "csharp": r"\b(?:if|while|do|for|foreach|case|catch)\b|\?(?![.?:,>])",
    "c": r"\b(?:if|while|do|for|case)\b|\?",
    "cpp": r"\b(?:if|while|do|for|case|catch)\b|\?",
}
_MODS = r"(?P<mods>(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|open|data|suspend|inline|partial|readonly|export|default|const|extern|unsafe)\s+)*)"
_TYPE = r"[\w$<>\[\],.?:&*]+(?:\s*[*&])*"
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "rust": [(rf"(?P<mods>pub(?:\s*\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+|extern\s+)*fn\s+(?P<name>{_NAME})", "function")] + [(rf"(?P<mods>pub(?:\s*\([^)]*\))?\s+)?{w}\s+(?P<name>{_NAME})", k) for w, k in (("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("type", "type"), ("mod", "module"))],
    "go": [(rf"func\s+\([^)]*\)\s*(?P<name>{_NAME})", "method"), (rf"func\s+(?P<name>{_NAME})", "function"), (rf"type\s+(?P<name>{_NAME})\s", "type")],
    "java": [(rf"{_MODS}{w}\s+(?P<name>{_NAME})", k) for w, k in (("class", "class"), ("interface", "interface"), ("enum", "enum"), ("record", "record"))] + [(rf"{_MODS}(?:<[^>]*>\s*)?{_TYPE}\s+(?P<name>{_NAME})\s*\([^;{{}}]*\)\s*(?:throws\s+[\w.,\s]+)?(?=\{{)", "method")],
    "kotlin": [(rf"{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<name>{_NAME})", "function"), (rf"{_MODS}(?:class|interface)\s+(?P<name>{_NAME})", "class"), (rf"{_MODS}object\s+(?P<name>{_NAME})", "object")],
    "javascript": [(rf"{_MODS}function\s*\*?\s*(?P<name>{_NAME})", "function"), (rf"{_MODS}class\s+(?P<name>{_NAME})", "class"), (rf"{_MODS}(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:\([^()]*\)|{_NAME})\s*=>", "function"), (rf"(?<=[{{;}}\n)])\s*{_MODS}(?:get\s+|set\s+)?(?P<name>{_NAME})\s*\([^(){{}};]*\)\s*(?::[^{{;]+)?(?=\{{)", "method")],
    "c": [(rf"(?:^|\n)(?P<mods>(?:static\s+|inline\s+|extern\s+)*){_TYPE}\s+\**(?P<name>{_NAME})\s*\([^;{{}}]*\)\s*(?=\{{)", "function"), (rf"struct\s+(?P<name>{_NAME})\s*(?=\{{)", "struct"), (rf"enum\s+(?P<name>{_NAME})\s*(?=\{{)", "enum")],
}
PATTERNS["typescript"] = PATTERNS["javascript"] + [(rf"{_MODS}{w}\s+(?P<name>{_NAME})", k) for w, k in (("interface", "interface"), ("enum", "enum"), ("type", "type"))]
PATTERNS["csharp"] = PATTERNS["java"] + [(rf"{_MODS}struct\s+(?P<name>{_NAME})", "struct")]
PATTERNS["cpp"] = PATTERNS["c"] + [(rf"class\s+(?P<name>{_NAME})[^;{{]*(?=\{{)", "class"), (rf"namespace\s+(?P<name>{_NAME})", "module"), (rf"(?:^|\n){_TYPE}\s+\**(?:{_NAME}::)+(?P<name>~?{_NAME})\s*\([^;{{}}]*\)\s*(?:const\s*)?(?=\{{)", "method")]
_COMPILED = {k: [(re.compile(p), kind) for p, kind in v] for k, v in PATTERNS.items()}
_DECIDE = {k: re.compile(v + r"|&&|\|\|") for k, v in DECISIONS.items()} | {"typescript": re.compile(DECISIONS["javascript"] + r"|&&|\|\|")}
_SKIP = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', re.S)
_CALL = re.compile(rf"(?P<lead>\.|::|->)?\s*(?P<name>{_NAME})\s*\(")
_IMPORT = {"rust": re.compile(r"\buse\s+([^;]+);"), "go": re.compile(r'\bimport\s+(?:\w+\s+)?"([^"]+)"'), "java": re.compile(r"\bimport\s+(?:static\s+)?([\w.*]+)\s*;"), "kotlin": re.compile(r"\bimport\s+([\w.*]+)"), "csharp": re.compile(r"\busing\s+([\w.]+)\s*;"), "c": re.compile(r'#\s*include\s*[<"]([^>"]+)[>"]')}
_IMPORT["cpp"] = _IMPORT["c"]
_IMPORT["javascript"] = _IMPORT["typescript"] = re.compile(r"""\bimport\s+(?:[^'";]*\sfrom\s+)?['"]([^'"]+)['"]""")
_TAG = re.compile(r"<([A-Za-z][\w.-]*)")
_MARK = {"rust": re.compile(r"#!?\[[^\]]*\]"), "csharp": re.compile(r"(?<=[\n{};])\s*\[[^\]]*\]")}
_DECORATOR = re.compile(r"@[A-Za-z_][\w.]*")
FILE_LANGS = ("vue", "svelte", "astro")


def empty() -> dict[str, list]:
    return {"decls": [], "imports": [], "calls": [], "renders": [], "hooks": []}


def python_facts(source: bytes) -> dict[str, list]:
    """Functions (methods too) and classes with decorators, imports and calls. A file that doesn't parse has no facts."""
    out = empty()
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return out
    starts = [0]
    for line in source.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    at = lambda n: (starts[n.lineno - 1] + n.col_offset, starts[n.end_lineno - 1] + n.end_col_offset)

    def dotted(n) -> str:
        return f"{dotted(n.value)}.{n.attr}" if isinstance(n, ast.Attribute) else n.id if isinstance(n, ast.Name) else dotted(n.func) if isinstance(n, ast.Call) else ""

    def decisions(n) -> int:
        total = 0
        for c in ast.iter_child_nodes(n):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            total += isinstance(c, (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.IfExp, ast.match_case)) + decisions(c)
            total += len(c.values) - 1 if isinstance(c, ast.BoolOp) else len(c.ifs) if isinstance(c, ast.comprehension) else 0
        return total

    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            a, b = at(n)
            kind = "class" if isinstance(n, ast.ClassDef) else "function"
            marks = [d for d in map(dotted, n.decorator_list) if d]
            out["decls"].append((kind, n.name, a, b, "Unknown", marks, decisions(n) + 1 if kind == "function" else 0))
        elif isinstance(n, ast.Import):
            out["imports"] += [(x.name, *at(n)) for x in n.names]
        elif isinstance(n, ast.ImportFrom):
            out["imports"].append(("." * n.level + (n.module or ""), *at(n)))
        elif isinstance(n, ast.Call):
            if isinstance(n.func, ast.Name):
                out["calls"].append((n.func.id, "free", *at(n)))
            elif isinstance(n.func, ast.Attribute):
                out["calls"].append((n.func.attr, "method", *at(n)))
    return _ordered(out)


def _ordered(out: dict[str, list]) -> dict[str, list]:
    out["decls"].sort(key=lambda d: (d[2], d[3]))
    for k, place in (("imports", 1), ("calls", 2), ("renders", 1), ("hooks", 1)):
        out[k].sort(key=lambda x, p=place: x[p:])
    return out


def _closing(text: str, start: int) -> int:
    """Place after the brace that closes the first one at or after start; a declaration without one ends at ; or the line's end."""
    depth, i = 0, start
    while i < len(text):
        c = text[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + 1
        elif c == ";" and not depth:
            return i + 1
        i += 1
    return len(text)


def text_facts(lang: str, source: bytes, shift: int = 0) -> dict[str, list]:
    """Facts of the other languages by pattern; shift is added to every place."""
    key = {"tsx": "typescript"}.get(lang, lang)
    out = empty()
    if key not in _COMPILED:
        return out
    raw = source.decode("latin-1")  # one character a byte, so places are byte places
    text = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), raw)
    marks = list((_MARK.get(key) or _DECORATOR).finditer(text))
    seen = set()
    for pattern, kind in _COMPILED[key]:
        for m in pattern.finditer(text):
            name = m["name"]
            if name in _CONTROL or m.start("name") in seen:
                continue
            seen.add(m.start("name"))
            mods = (m.groupdict().get("mods") or "").strip()
            a = m.start("mods") if mods else m.start() + len(m[0]) - len(m[0].lstrip())
            b = _closing(text, m.end())
            near, edge = [], a
            for mark in reversed(marks):  # marks right above it
                if mark.end() <= edge and not text[mark.end() : edge].strip():
                    near.append(re.sub(r"^[#!\[@\s]+", "", raw[mark.start() : mark.end()]))
                    edge = mark.start()
            names = [w for w in (re.match(r"[\w.:]*", x)[0] for x in reversed(near)) if w]
            out["decls"].append((kind, _utf8(name), a + shift, b + shift, _visible(key, name, mods, kind), names, 0))
    spans = [(d[2] - shift, d[3] - shift, k) for k, d in enumerate(out["decls"])]
    counts = [0] * len(spans)
    for m in _DECIDE[key].finditer(text):
        inside = [(b - a, k) for a, b, k in spans if a <= m.start() and m.end() <= b]
        if inside:
            counts[min(inside)[1]] += 1
    out["decls"] = [(*d[:6], counts[k] + 1 if d[0] in ("function", "method", "component") else 0) for k, d in enumerate(out["decls"])]
    for m in _CALL.finditer(text):
        name = m["name"]
        if name in _CONTROL or m.start("name") in seen:
            continue
        shape = {"::": "path", None: "free"}.get(m["lead"], "method")
        place = (m.start("name") + shift, m.end("name") + shift)
        out["calls"].append((_utf8(name), shape, *place))
        if shape == "free" and key in ("javascript", "typescript") and HOOK.match(name):
            out["hooks"].append((_utf8(name), *place))
    for m in _IMPORT[key].finditer(raw):
        if text[m.start() : m.start() + 3].strip():
            out["imports"].append((_utf8(m[1].strip()), m.start() + shift, m.end() + shift))
    if lang in ("tsx", "javascript"):
        for m in _TAG.finditer(text):
            if m[1][0].isupper():
                out["renders"].append((_utf8(m[1]), m.start() + shift, m.end() + shift))
        tags = [m.start() for m in _TAG.finditer(text)] if re.search(r"return\s*\(?\s*<|=>\s*\(?\s*<", text) else []
        out["decls"] = [("component", *d[1:6], d[6]) if d[0] in ("function", "variable") and any(d[2] - shift <= t < d[3] - shift for t in tags) else d for d in out["decls"]]
    return _ordered(out)


def _utf8(text: str) -> str:
    return text.encode("latin-1").decode("utf-8", "replace")


def _visible(key: str, name: str, mods: str, kind: str) -> str:
    words = set(re.findall(r"\w+", mods))
    if key == "rust":
        return "Public" if mods == "pub" else "Restricted" if mods.startswith("pub") else "Private"
    if key == "go":
        return "Public" if name[:1].isupper() else "Private"
    if key in ("c", "cpp"):
        return "Private" if "static" in words else "Public" if kind == "function" else "Unknown"
    if "public" in words or "export" in words:
        return "Public"
    return "Restricted" if words & {"protected", "internal"} else "Private" if "private" in words else "Unknown"


def injected_facts(lang: str, source: bytes) -> dict[str, list]:
    """Component files: script blocks (all as one layer, in the strongest of their languages) or frontmatter, at their own
    places; capitalised tags of the rest are renders."""
    raw = source.decode("latin-1")
    found = [(m.start(2), m.end(2), m[1]) for m in re.finditer(r"<script([^>]*)>(.*?)</script\s*>", raw, re.S | re.I)]
    if lang == "astro" and (m := re.match(r"\s*---\n(.*?)\n---", raw, re.S)):
        found, inner = [(m.start(1), m.end(1), "")], "typescript"
    else:
        marks = " ".join(x[2] for x in found)
        inner = "tsx" if "tsx" in marks else "typescript" if re.search(r"lang\s*=\s*[\"']?ts", marks) else "javascript"
    layer = bytearray(b" " * len(source))
    for a, b, _ in found:
        layer[a:b] = source[a:b]
    out = text_facts(inner, bytes(layer))
    body = raw
    for a, b, _ in found:
        body = body[:a] + " " * (b - a) + body[b:]
    out["renders"] = [(_utf8(m[1]), m.start(), m.end()) for m in _TAG.finditer(body) if m[1][0].isupper()]
    return _ordered(out)


def facts_of(lang: str, source: bytes) -> dict[str, list]:
    if lang == "python":
        return python_facts(source)
    return injected_facts(lang, source) if lang in FILE_LANGS else text_facts(lang, source)


KINDS = {
    "decls": ("kind string, name string, def_bs long, def_be long, visibility string, attributes array<string>, complexity long", ["kind", "name", "def_bs", "def_be", "visibility", "attributes", "complexity"]),
    "imports": ("name string, bs long, be long", ["name", "bs", "be"]),
    "calls": ("callee string, shape string, bs long, be long", ["callee", "shape", "bs", "be"]),
    "renders": ("name string, bs long, be long", ["name", "bs", "be"]),
    "hooks": ("name string, bs long, be long", ["name", "bs", "be"]),
}


def extract(files: DataFrame, reader: Callable[[str, bytes], dict] = facts_of) -> DataFrame:
    """(path, decls, imports, calls, renders, hooks) of files (path, lang, content); arrays of structs, to be exploded by `table`."""
    schema = "path string, " + ", ".join(f"{k} array<struct<{', '.join(f'{f.split()[0]}:{f.split()[1]}' for f in spec.split(', '))}>>" for k, (spec, _) in KINDS.items())

    def run(batches):
        for pdf in batches:
            rows = []
            for path, lang, content in zip(pdf["path"], pdf["lang"], pdf["content"]):
                found = reader(lang, bytes(content or b""))
                rows.append({"path": path} | {k: [dict(zip(names, row)) for row in found[k]] for k, (_, names) in KINDS.items()})
            yield pd.DataFrame(rows, columns=["path", *KINDS])

    return files.select("path", "lang", "content").mapInPandas(run, schema)


def table(facts: DataFrame, name: str) -> DataFrame:
    """One of the five fact tables, a row a fact."""
    return facts.selectExpr("path", f"inline({name})")
