"""Interval joins: overlap, innermost containment, the next start after a place, lines of byte places.

Joins key on the file and on buckets of places, so a large file is many keys. A range goes to the buckets of a width that
follows its own length, so it meets three of them at most, and a place looks into one bucket of each width there is. The next
start is a sort by place and a running value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.lineage import cut
from weftline.operators.rules import first_match


def overlaps(hunks: DataFrame, ranges: DataFrame, width: int = 256) -> DataFrame:
    """hunks (path, start_line, end_line, ...) with each range (path, first_line, last_line, ...) of the path that shares a line.

    Both sides are dealt to buckets of `width` lines; a pair is kept in the first bucket that both are in."""

    def dealt(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.filter(F.col(a) <= F.col(b)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))

    h, r = dealt(hunks, "start_line", "end_line"), dealt(ranges, "first_line", "last_line")
    both = h.join(r, ["path", "_b"]).filter("start_line <= last_line and first_line <= end_line")
    return both.filter(F.col("_b") == F.floor(F.greatest("start_line", "first_line") / width)).drop("_b")


def _around(places: DataFrame, at: str, end: str, ranges: DataFrame, start: str, stop: str) -> DataFrame:
    """Rows of places (path, at, end, ...) with each of ranges (path, start, stop, ...) of the path around them."""
    size = F.ceil(F.log2(F.greatest(F.col(stop) - F.col(start), F.lit(1)))).cast("int")
    dealt = ranges.filter(F.col(start) <= F.col(stop)).withColumn("_w", size)
    widths = [r["_w"] for r in dealt.select("_w").distinct().collect()]  # 64 at most
    bucket = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_w")))
    dealt = dealt.withColumn("_b", F.explode(F.sequence(bucket(start), bucket(stop))))
    probes = places.withColumn("_w", F.explode(F.array(*map(F.lit, widths)) if widths else F.array().cast("array<int>"))).withColumn("_b", bucket(at))
    return probes.join(dealt, ["path", "_w", "_b"]).filter((F.col(start) <= F.col(at)) & (F.col(stop) >= F.col(end))).drop("_w", "_b")


def _spans(decls: DataFrame) -> DataFrame:
    """(path, def_bs, def_be, decl_id, _d): one row for all declarations of a span, the least decl_id with its columns."""
    rest = [c for c in decls.columns if c not in ("path", "def_bs", "def_be")]
    by = decls.groupBy("path", "def_bs", "def_be").agg(F.min_by(F.struct(*rest), F.struct("decl_id")).alias("_d"))
    return by.select("path", "def_bs", "def_be", "_d.decl_id", "_d")


def _each(marks: DataFrame, decls: DataFrame, mark: str, found: DataFrame, order: list[Column]) -> DataFrame:
    """Marks with what was found for their places, one row a mark."""
    own, rest = [c for c in marks.columns if c not in ("path", mark)], [c for c in decls.columns if c not in ("path", "def_bs", "def_be")]
    keys = F.struct(*(k.alias(f"k{n}") for n, k in enumerate(order)))
    placed = found.select("path", "bs", "be", F.struct("def_bs", "def_be", "_d").alias("_f"), keys.alias("_k"))
    both = marks.join(placed, ["path", "bs", "be"])
    first = both.groupBy(mark).agg(F.min_by(F.struct("path", *own, "_f"), "_k").alias("_m"))
    return first.select("_m.path", mark, *(f"_m.{c}" for c in own), "_m._f.def_bs", "_m._f.def_be", *(f"_m._f._d.{c}" for c in rest))


_PLACE = ["path", "bs", "be"]


def innermost(sites: DataFrame, decls: DataFrame, site: str = "site_id", places: DataFrame | None = None) -> DataFrame:
    """Each site (path, bs, be) with the shortest declaration (decl_id, path, def_bs, def_be) around it; the first in the
    source on ties. Sites in none are left out. Each place is looked up once, among spans that differ, for all its sites.
    places (path, bs, be): those of the sites and maybe more, where they are had for less than from the sites."""
    order = [F.col("def_be") - F.col("def_bs"), F.col("def_bs"), F.col("decl_id")]
    both = _around((sites if places is None else places).select(_PLACE).distinct(), "bs", "be", cut(_spans(decls)), "def_bs", "def_be")
    return _each(sites, decls, site, cut(first_match(both, _PLACE, order)), order)


def container_or_largest(marks: DataFrame, decls: DataFrame, mark: str = "mark_id", places: DataFrame | None = None) -> DataFrame:
    """Each mark (path, bs, be) with the smallest declaration around it, else the largest inside it. places: as in innermost."""
    size = F.col("def_be") - F.col("def_bs")
    spans, places = cut(_spans(decls)), cut((marks if places is None else places).select(_PLACE).distinct())
    around = cut(first_match(_around(places, "bs", "be", spans, "def_bs", "def_be"), _PLACE, [size, F.col("def_bs"), F.col("decl_id")]))
    rest = cut(places.join(around, _PLACE, "left_anti"))
    inside = first_match(_around(spans, "def_bs", "def_be", rest, "bs", "be"), _PLACE, [-size, F.col("def_bs"), F.col("decl_id")])
    found = cut(around.withColumn("_in", F.lit(False)).unionByName(inside.withColumn("_in", F.lit(True))))
    return _each(marks, decls, mark, found, [F.col("_in"), F.when(F.col("_in"), -size).otherwise(size), F.col("def_bs"), F.col("decl_id")])


def next_start(marks: DataFrame, decls: DataFrame, mark: str = "mark_id") -> DataFrame:
    """Each mark (path, be) with the declaration of its path that starts first at or after its end, the least decl_id of several."""
    rest = [c for c in decls.columns if c != "path"]
    own = [c for c in marks.columns if c != "path"]
    starts = decls.filter("def_bs is not null").groupBy("path", F.col("def_bs").alias("_at")).agg(F.min_by(F.struct(*rest), "decl_id").alias("_d")).withColumn("_m", F.lit(None))
    rows = marks.filter("be is not null").select("path", F.col("be").alias("_at"), F.struct(*own).alias("_m")).unionByName(starts, allowMissingColumns=True)
    # from the last place to the first; at one place a start comes before the marks
    order = Window.partitionBy("path").orderBy(F.desc("_at"), F.col("_m").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_d", F.last("_d", True).over(order)).filter("_m is not null and _d is not null")
    return found.select("path", "_m.*", "_d.*")


def line_starts(content: Column) -> Column:
    """Byte places where lines start, from 0."""
    import numpy as np
    import pandas as pd

    def starts(found):
        return pd.Series([None if x is None else [0, *(np.flatnonzero(np.frombuffer(x, np.uint8) == 10) + 1).tolist()] for x in found])

    starts.__annotations__ = {"found": pd.Series, "return": pd.Series}
    return F.pandas_udf(starts, "array<int>")(content.cast("binary"))


def line_of(starts: Column, place: Column) -> Column:
    """1-based line of a byte place: the number of lines that start at or before it, 1 at least."""
    return F.greatest(F.size(F.filter(starts, lambda s: s <= place)), F.lit(1))


def line_ranges(spans: DataFrame) -> DataFrame:
    """spans (path, line_starts, symbol_id, byte_start, byte_end) as symbol_id, path, first_line, last_line."""
    last = F.greatest(F.col("byte_end") - 1, F.col("byte_start"))
    return spans.select("symbol_id", "path", line_of(F.col("line_starts"), F.col("byte_start")).alias("first_line"), line_of(F.col("line_starts"), last).alias("last_line"))
