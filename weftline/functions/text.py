"""Patterns and codecs: globs, identifiers, cursors."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable


def glob_regex(glob: str) -> str:
    """Regular expression of a path glob: * and ? also match /, ** any run, [..] a set, {a,b} either."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            out += ".*"
            while glob.startswith("**", i):
                i += 1
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"bad glob: {glob}")
    return f"(?s)^{out}$"


def fnv1a(data: bytes) -> int:
    """FNV-1a of 64 bits."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def paths_fingerprint(paths: Iterable[str]) -> int:
    """The same for any order of the paths."""
    out = 0
    for p in set(paths):
        out ^= fnv1a(p.encode())
    return out


def encode_cursor(revision: int, offsets: list[int], fingerprint: int | None = None) -> str:
    """Hex of revision u32, number u32, offsets u64 (little-endian), and the fingerprint u64 of a diff's paths if given."""
    tail = b"" if fingerprint is None else struct.pack("<Q", fingerprint)
    return (struct.pack("<II", revision, len(offsets)) + struct.pack(f"<{len(offsets)}Q", *offsets) + tail).hex()


def decode_cursor(text: str, revision: int, lists: int = 1, fingerprint: int | None = None) -> list[int]:
    """Offsets of a cursor. ValueError if it is malformed, of another revision or of another diff."""
    try:
        data = bytes.fromhex(text)
        seen, n = struct.unpack_from("<II", data)
        offsets = list(struct.unpack_from(f"<{n}Q", data, 8))
    except (ValueError, struct.error) as e:
        raise ValueError("malformed cursor") from e
    if n != lists or len(data) != 8 + 8 * n + (8 if fingerprint is not None else 0):
        raise ValueError("malformed cursor")
    if seen != revision:
        raise ValueError("stale cursor: the data has changed")
    if fingerprint is not None and struct.unpack_from("<Q", data, 8 + 8 * n)[0] != fingerprint:
        raise ValueError("stale cursor: the diff has changed")
    return offsets


def truncation_note(shown: int, total: int, noun: str) -> str:
    return f"Showing {shown} of {total} {noun} — call again with next_cursor for more." if shown < total else ""
