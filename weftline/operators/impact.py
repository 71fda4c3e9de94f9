"""What a diff reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.lineage import cut
from weftline.operators.graph import LOCAL, callers, musts_by_steps
from weftline.operators.intervals import overlaps


def fresh_spans(spans: DataFrame, indexed: DataFrame, disk: DataFrame) -> DataFrame:
    """Spans of files whose content on disk is what was indexed. indexed, disk: path, content_hash."""
    same = indexed.join(disk.select("path", F.col("content_hash").alias("_h")), "path").filter(F.col("content_hash") == F.col("_h"))
    return spans.join(same.select("path"), "path", "left_semi")


def seeds(hunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """(seed, path): symbols with a changed line."""
    return overlaps(hunks.select("path", "start_line", "end_line"), ranges).select(F.col("symbol_id").alias("seed"), "path").distinct()


def _reach(steps: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node): all within depth hops of a seed other than itself. Of the seeds that lead to a node, the least and the greatest
    tell whether there is another one, so a node has one row however many seeds there are."""
    label = seeds.select(F.col("seed").alias("node"), F.col("seed").alias("a"), F.col("seed").alias("b"))
    for _ in range(max(1, depth)):
        came = label.join(steps, label["node"] == steps["dst"]).select(F.col("src").alias("node"), "a", "b")
        label = cut(label.unionAll(came).groupBy("node").agg(F.min("a").alias("a"), F.max("b").alias("b")))
    return label.filter("a <> node or b <> node").select("node")


def _steps(edges: DataFrame) -> DataFrame:
    return cut(edges.select("src", "dst").filter("src <> dst").distinct())


def diff_reach(edges: DataFrame, hunks: DataFrame, ranges: DataFrame, depth: int = 3) -> DataFrame:
    """(part, symbol_id): seeds of the diff and all reached, as diff_blast has them without telling must from may."""
    start = cut(seeds(hunks, ranges).select("seed").distinct())
    reach = _reach(_steps(edges), start, depth)
    return start.select(F.lit("seed").alias("part"), F.col("seed").alias("symbol_id")).unionAll(reach.select(F.lit("reached"), "node"))


def _twice(steps: DataFrame, start: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): those of nodes, none a direct caller of a seed, with two ways of two steps to one seed."""
    first = steps.join(nodes, steps["src"] == nodes["node"]).select("node", F.col("dst").alias("mid"))
    last = steps.join(start, steps["dst"] == start["seed"]).select(F.col("src").alias("mid"), "seed")
    by = first.join(last, "mid").filter("node <> seed").groupBy("node", "seed").agg(F.count("*").alias("n"))
    return by.filter("n > 1").select("node").distinct()


def diff_blast(edges: DataFrame, hunks: DataFrame, ranges: DataFrame, changed: DataFrame, depth: int = 3, local: int = LOCAL) -> DataFrame:
    """(part, symbol_id, path): seeds of the diff, what must and may change with them, and changed paths without a seed.
    may leaves out what some seed's must has.

    Direct callers of a seed are its must, and so are nodes with two ways of two steps to it; a node that depends on one other
    alone is none. For the nodes left, the seed that stands before a node alone is the one that the node, in the graph turned
    round, stands before alone; so work is done once for each seed or once for each such node, whichever are fewer."""
    found = cut(seeds(hunks, ranges))
    start = cut(found.select("seed").distinct())
    steps = _steps(edges)
    reach = cut(_reach(steps, start, depth))
    direct = cut(steps.join(start, steps["dst"] == start["seed"], "left_semi").select(F.col("src").alias("node")).distinct())
    rest = cut(reach.join(direct, "node", "left_anti"))
    twice = cut(_twice(steps, start, rest))
    several = steps.join(rest.select(F.col("node").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("node")).count().filter("count > 1")
    rest = cut(several.select("node").join(twice, "node", "left_anti"))
    direct = direct.unionAll(twice)
    many = rest.count()
    if many and many <= start.count():
        back = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        ends = rest.select(F.col("node").alias("seed"))
        pairs = callers(back, ends, max(1, depth)).join(musts_by_steps(back, ends, local), ["seed", "node"])
        more = pairs.join(start.select(F.col("seed").alias("node")), "node", "left_semi").select(F.col("seed").alias("node"))
    else:
        more = callers(steps, start, max(1, depth)).join(rest, "node", "left_semi").join(musts_by_steps(steps, start, local), ["seed", "node"]).select("node")
    must = cut(direct.unionAll(more).distinct() if many else direct).select(F.col("node").alias("symbol_id"))
    may = reach.select(F.col("node").alias("symbol_id")).join(must, "symbol_id", "left_anti")
    none = F.lit(None).cast("string")
    parts = [(start.select(F.col("seed").alias("symbol_id")), "seed"), (must, "must"), (may, "may")]
    out = None
    for df, name in parts:
        part = df.select(F.lit(name).alias("part"), "symbol_id", none.alias("path"))
        out = part if out is None else out.unionAll(part)
    lost = changed.select("path").distinct().join(found.select("path").distinct(), "path", "left_anti")
    return out.unionAll(lost.select(F.lit("unresolved").alias("part"), F.lit(None).cast("long").alias("symbol_id"), "path"))


def affected_tests(blast: DataFrame, tests: DataFrame) -> DataFrame:
    """(symbol_id): test symbols among a diff's seeds and all it reaches (diff_blast or diff_reach); a changed test is affected
    itself."""
    reached = blast.filter("part <> 'unresolved'").select("symbol_id").distinct()
    return reached.join(tests.select("symbol_id"), "symbol_id", "left_semi").orderBy("symbol_id")
