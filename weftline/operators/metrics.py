"""Coupling, cohesion, complexity, history and refactoring metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.graph import degrees


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def _sides(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """edges with the module of each end (null: in none)."""
    a = modules.select(F.col("symbol_id").alias("src"), F.col("module").alias("src_module"))
    b = modules.select(F.col("symbol_id").alias("dst"), F.col("module").alias("dst_module"))
    return edges.join(a, "src", "left").join(b, "dst", "left")


def coupling(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, members, ca, ce, instability, abstractness, distance). modules: module, symbol_id, is_abstract.

    ca and ce count the different outside symbols that point in or are pointed to; a symbol of no module is outside."""
    sides = _sides(edges, modules.select("module", "symbol_id"))
    apart = F.coalesce(F.col("src_module") != F.col("dst_module"), F.lit(True))
    ca = sides.filter(F.col("dst_module").isNotNull() & apart).groupBy(F.col("dst_module").alias("module")).agg(F.countDistinct("src").alias("ca"))
    ce = sides.filter(F.col("src_module").isNotNull() & apart).groupBy(F.col("src_module").alias("module")).agg(F.countDistinct("dst").alias("ce"))
    by = modules.groupBy("module").agg(F.count("*").alias("members"), F.count(F.when(F.col("is_abstract"), 1)).alias("_abstract"))
    out = by.join(ca, "module", "left").join(ce, "module", "left").fillna(0, ["ca", "ce"])
    out = out.withColumn("instability", ratio(F.col("ce"), F.col("ca") + F.col("ce"))).withColumn("abstractness", ratio(F.col("_abstract"), F.col("members")))
    return out.withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1)).drop("_abstract")


def cohesion(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, cohesion): edges inside a module over all that touch it; an edge between two modules counts for both."""
    sides = _sides(edges, modules.select("module", "symbol_id"))
    same = F.col("src_module") == F.col("dst_module")
    touch = sides.select(F.explode(F.when(same, F.array(F.struct(F.col("src_module").alias("module"), F.lit(1).alias("inner")))).otherwise(F.array(F.struct(F.col("src_module").alias("module"), F.lit(0).alias("inner")), F.struct(F.col("dst_module").alias("module"), F.lit(0).alias("inner"))))).alias("t"))
    by = touch.select("t.module", "t.inner").filter("module is not null").groupBy("module").agg(F.sum("inner").alias("i"), F.count("*").alias("n"))
    return modules.select("module").distinct().join(by, "module", "left").select("module", ratio(F.coalesce("i", F.lit(0)), F.coalesce("n", F.lit(0))).alias("cohesion"))


def file_complexity(symbols: DataFrame) -> DataFrame:
    """(path, complexity): sum over the file's symbols."""
    return symbols.groupBy(F.col("file").alias("path")).agg(F.sum("complexity").alias("complexity"))


def complexity_ranking(symbols: DataFrame, grain: str = "file", limit: int | None = None) -> DataFrame:
    """Files (path) or symbols (symbol_id, name, file) by complexity, greatest first, then by key."""
    if grain == "file":
        by, key = file_complexity(symbols), "path"
    elif grain == "symbol":
        by, key = symbols.select("symbol_id", "name", F.col("file").alias("path"), "complexity"), "symbol_id"
    else:
        raise ValueError(f"no grain {grain}")
    out = by.orderBy(F.desc("complexity"), key)
    return out.limit(limit) if limit is not None else out


def file_churn(commit_files: DataFrame) -> DataFrame:
    """(path, commits, authors, last_changed). commit_files: commit_id, author, ts, path, one row a file and commit."""
    return commit_files.groupBy("path").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"), F.max("ts").alias("last_changed"))


def co_change_counts(commit_files: DataFrame, max_files: int = 50) -> DataFrame:
    """(a, b, count), a < b: commits that change both. Commits of more than max_files files are left out before pairing."""
    size = commit_files.groupBy("commit_id").agg(F.count("*").alias("n")).filter(F.col("n").between(2, max_files)).select("commit_id")
    few = commit_files.select("commit_id", "path").join(size, "commit_id")
    pairs = few.groupBy("commit_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    # at most max_files paths a commit: its pairs are made in the row, without a self-join
    both = F.flatten(F.transform("paths", lambda x, i: F.transform(F.slice("paths", i + 2, F.greatest(F.size("paths") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return pairs.select(F.explode(both).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("count"))


def co_change(pairs: DataFrame, churn: DataFrame, min_revs: int = 5, min_shared: int = 5, min_degree: float = 0.30) -> DataFrame:
    """(a, b, count, degree): degree is the shared commits over the mean of both files' commits; pairs without both are dropped."""
    ca = churn.select(F.col("path").alias("a"), F.col("commits").alias("ra")).filter(F.col("ra") >= min_revs)
    cb = churn.select(F.col("path").alias("b"), F.col("commits").alias("rb")).filter(F.col("rb") >= min_revs)
    out = pairs.filter(F.col("count") >= min_shared).join(ca, "a").join(cb, "b").withColumn("degree", ratio(F.col("count"), (F.col("ra") + F.col("rb")) / 2))
    return out.filter(F.col("degree") >= min_degree).select("a", "b", "count", "degree").orderBy(F.desc("degree"), "a", "b")


def hotspots(churn: DataFrame, complexity: DataFrame, key: str = "path") -> DataFrame:
    """(key, commits, complexity, score): product of both measures, each over its maximum among the churned; 0 where that is 0."""
    both = churn.select(key, "commits").join(complexity.select(key, "complexity"), key, "left").fillna(0, ["complexity"])
    most = both.agg(F.max("commits").alias("_c"), F.max("complexity").alias("_x"))
    out = both.crossJoin(F.broadcast(most))  # one row
    return out.select(key, "commits", "complexity", (ratio(F.col("commits"), F.col("_c")) * ratio(F.col("complexity"), F.col("_x"))).alias("score")).orderBy(F.desc("score"), key)


def file_risk(churn: DataFrame, complexity: DataFrame, path: str) -> float | None:
    """The hotspot score of one file: None without any churn, 0 for a file without."""
    most = churn.agg(F.max("commits")).first()[0]
    if most is None:
        return None
    row = hotspots(churn, complexity).filter(F.col("path") == path).first()
    return row["score"] if row else 0.0


def symbol_churn(hunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """(symbol_id, commits): commits with a hunk over the symbol's lines. hunks: commit_id, path, start_line, end_line;
    ranges: symbol_id, path, first_line, last_line; lines count from 1, both ends belong."""
    from weftline.operators.intervals import overlaps

    # symbols on the same lines have the same commits, and hunks on the same lines the same symbols: classes meet, not rows
    same = ranges.select("path", "first_line", "last_line").distinct()
    lines = hunks.select("path", "start_line", "end_line").distinct()
    met = overlaps(lines, same)
    commits = hunks.distinct().join(met, ["path", "start_line", "end_line"]).select("commit_id", "path", "first_line", "last_line").distinct()
    by = commits.groupBy("path", "first_line", "last_line").agg(F.count("*").alias("commits"))
    return ranges.join(by, ["path", "first_line", "last_line"]).select("symbol_id", "commits")


def god_modules(modules: DataFrame, edges: DataFrame, min_ce: int = 8, max_cohesion: float = 0.3, top: int = 5) -> DataFrame:
    """(module, ce, cohesion, outbound, share, suggestion): modules with ce above min_ce and cohesion below max_cohesion.
    outbound lists the members with most edges that leave the module as (symbol_id, edges); share is what the first of
    them has of all such edges, in percent."""
    sides = _sides(edges, modules.select("module", "symbol_id")).filter("src_module is not null")
    leaving = sides.filter(F.coalesce(F.col("src_module") != F.col("dst_module"), F.lit(True)))
    by = leaving.groupBy(F.col("src_module").alias("module"), F.col("src").alias("symbol_id")).agg(F.count("*").alias("edges"))
    w = Window.partitionBy("module").orderBy(F.desc("edges"), "symbol_id")
    every = by.groupBy("module").agg(F.sum("edges").alias("_all"), F.max("edges").alias("_most"))
    few = by.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top).groupBy("module").agg(F.array_sort(F.collect_list(F.struct("_n", "symbol_id", "edges"))).alias("_o"))
    found = coupling(modules, edges).join(cohesion(modules, edges), "module").filter((F.col("ce") > min_ce) & (F.col("cohesion") < max_cohesion)).join(every, "module").join(few, "module")
    share = F.round(100 * F.col("_most") / F.col("_all")).cast("long")
    lists = F.transform("_o", lambda x: F.struct(x["symbol_id"].alias("symbol_id"), x["edges"].alias("edges")))
    text = F.concat(F.lit("move out symbol "), F.col("_o")[0]["symbol_id"].cast("string"), F.lit(": it has "), share.cast("string"), F.lit(" % of the edges that leave "), "module")
    return found.select("module", "ce", "cohesion", lists.alias("outbound"), share.alias("share"), text.alias("suggestion"))


def wide_modules(modules: DataFrame, edges: DataFrame, min_ce: int = 15) -> DataFrame:
    """(module, ce): modules of library files with ce above min_ce, widest first."""
    from weftline.operators.rules import library_target

    return coupling(modules, edges).filter((F.col("ce") > min_ce) & library_target(F.col("module"))).select("module", "ce").orderBy(F.desc("ce"), "module")


def misplaced(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbol_id, from_module, to_module, ratio): symbols that one foreign module calls or imports over twice as often as
    their own does; of foreign modules, the one that does most, then the first by name."""
    sides = _sides(edges.filter(F.col("kind").isin("Calls", "Imports")), modules.select("module", "symbol_id")).filter("src_module is not null and dst_module is not null")
    by = sides.groupBy(F.col("dst").alias("symbol_id"), F.col("dst_module").alias("from_module"), F.col("src_module").alias("to_module")).agg(F.count("*").alias("n"))
    own = by.filter("from_module = to_module").select("symbol_id", F.col("n").alias("own"))
    w = Window.partitionBy("symbol_id").orderBy(F.desc("n"), "to_module")
    best = by.filter("from_module <> to_module").withColumn("_k", F.row_number().over(w)).filter("_k = 1").join(own, "symbol_id", "left").fillna(0, ["own"])
    return best.filter("n > 2 * own").select("symbol_id", "from_module", "to_module", (F.col("n") / F.greatest("own", F.lit(1))).alias("ratio"))


def neighbours(modules: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """(module, side, symbol_id, n, place): for each module the outside symbols with most edges in (callers) or out (callees)."""
    sides = _sides(edges, modules.select("module", "symbol_id"))
    apart = F.coalesce(F.col("src_module") != F.col("dst_module"), F.lit(True))
    into = sides.filter(F.col("dst_module").isNotNull() & apart).select(F.col("dst_module").alias("module"), F.lit("callers").alias("side"), F.col("src").alias("symbol_id"))
    out = sides.filter(F.col("src_module").isNotNull() & apart).select(F.col("src_module").alias("module"), F.lit("callees").alias("side"), F.col("dst").alias("symbol_id"))
    by = into.unionAll(out).groupBy("module", "side", "symbol_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("module", "side").orderBy(F.desc("n"), "symbol_id")
    return by.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def synopsis(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: crates, layers, symbols, edges with both ends in scope, languages (sorted). files: path, lang, crate, layer in scope."""
    ids = symbols.join(files.select(F.col("path").alias("file")), "file", "left_semi").select("symbol_id")
    inner = edges.join(ids.withColumnRenamed("symbol_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("symbol_id", "dst"), "dst", "left_semi")
    one = files.agg(F.countDistinct("crate").alias("crates"), F.countDistinct("layer").alias("layers"), F.array_sort(F.collect_set("lang")).alias("languages"))
    return one.crossJoin(ids.agg(F.count("*").alias("symbols"))).crossJoin(inner.agg(F.count("*").alias("edges")))


def dominant_layer(files: DataFrame) -> DataFrame:
    """(crate, layer): the layer of most of a crate's files; ties in the order Domain, Adapter, Interior."""
    order = F.when(F.col("layer") == "Domain", 0).when(F.col("layer") == "Adapter", 1).otherwise(2)
    by = files.filter("crate is not null").groupBy("crate", "layer").agg(F.count("*").alias("n"))
    return by.groupBy("crate").agg(F.max_by("layer", F.struct(F.col("n"), -order)).alias("layer"))


def merge_churn(old: DataFrame, new: DataFrame) -> DataFrame:
    """History added up: (path, commits, author_keys, last_changed); commits add, author sets unite, the later time stays."""
    both = old.unionByName(new)
    return both.groupBy("path").agg(F.sum("commits").alias("commits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("author_keys")))).alias("author_keys"), F.max("last_changed").alias("last_changed"))


def merge_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("a", "b").agg(F.sum("count").alias("count"))
