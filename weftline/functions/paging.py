"""Pages of ordered results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import decode_cursor, encode_cursor, truncation_note


def page(df: DataFrame, order: list, limit: int = 50, cursor: str | None = None, revision: int = 0, noun: str = "rows", fingerprint: int | None = None) -> dict:
    """rows, total, next_cursor (None at the end) and note. A limit of 0 gives an empty page without a cursor.
    Only the page's rows reach the driver."""
    return pages({"rows": (df, order)}, limit, cursor, revision, noun, fingerprint) if cursor or limit else {"rows": [], "total": df.count(), "next_cursor": None, "note": ""}


def pages(lists: dict[str, tuple[DataFrame, list]], limit: int = 50, cursor: str | None = None, revision: int = 0, noun: str = "rows", fingerprint: int | None = None) -> dict:
    """A page of each of several lists under one cursor; a list that is at its end stays empty."""
    at = decode_cursor(cursor, revision, len(lists), fingerprint) if cursor else [0] * len(lists)
    out, after, shown, total = {}, [], 0, 0
    more = False
    for start, (name, (df, order)) in zip(at, lists.items()):
        n = df.count()
        out[name] = df.orderBy(*order).offset(start).limit(limit).collect() if start < n and limit else []
        after.append(start + len(out[name]))
        more |= after[-1] < n
        shown, total = shown + len(out[name]), total + n
    out["total"] = total
    out["next_cursor"] = encode_cursor(revision, after, fingerprint) if more and limit else None
    out["note"] = truncation_note(shown, total, noun)
    return out


def ranked(df: DataFrame, order: list[Column], offset: int = 0, limit: int | None = None, name: str = "place") -> DataFrame:
    """The page as a DataFrame with each row's place in the order."""
    from pyspark.sql import Window

    out = df.orderBy(*order).limit(offset + limit) if limit is not None else df
    return out.withColumn(name, F.row_number().over(Window.orderBy(*order))).filter(F.col(name) > offset)


def verbosity(df: DataFrame, detailed: bool, only_detailed: list[str]) -> DataFrame:
    """Concise results have null for ids and byte places."""
    if detailed:
        return df
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.lit(None).cast(kinds[c]) for c in only_detailed})
