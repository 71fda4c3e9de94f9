"""Queries over the driver's tables and the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.lineage import cut
from weftline.functions.paging import ranked
from weftline.operators import derive, graph, impact, intervals, metrics, navigate, rules
from weftline.plans import documents
from weftline.plans.bridge import Bridge
from weftline.plans.oracles import SQL
from weftline.plans.outline import outlines
from weftline.plans.store import stale
from weftline.streaming.live import last_events, reconcile

__all__ = ["QUERIES", "SQL"]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def tops(edges: DataFrame) -> DataFrame:
    """The three symbols most depended on, as seeds."""
    return edges.groupBy(F.col("dst").alias("seed")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "seed").limit(3).select("seed")


def diff(b: Bridge) -> tuple[DataFrame, DataFrame]:
    """Hunks and changed paths of the first commits, taken as a diff."""
    hunks = b.hunks.filter("commit_id < 8").select("path", "start_line", "end_line").distinct()
    return hunks, hunks.select("path").distinct()


def _references(b: Bridge) -> DataFrame:
    seed = tops(b.edges).agg(F.min("seed")).first()[0]
    return navigate.find_references(b.symbols, b.stored_edges, seed).select(F.lit(seed).cast("long").alias("seed"), "*")


def _file_deps(b: Bridge) -> DataFrame:
    """Evidence here is the target's file, so that it differs from the source's."""
    at = b.symbols.select(F.col("symbol_id").alias("dst"), F.col("file"))
    return navigate.file_summary(b.symbols, b.stored_edges.drop("file").join(at, "dst"), "Brand#1")[1]


def _god(b: Bridge) -> DataFrame:
    found = metrics.god_modules(b.modules, b.edges)
    return found.select("module", "ce", F.round("cohesion", 9).alias("cohesion"), F.col("outbound")[0]["symbol_id"].alias("first_symbol"), "share")


def _blast(kinds=None):
    def run(b: Bridge) -> DataFrame:
        edges = cut(b.edges)
        return graph.blast_radius(edges, cut(tops(edges)), kinds)

    return run


def _plan(b: Bridge) -> DataFrame:
    edges = cut(b.edges)
    seed = tops(b.edges).agg(F.min("seed")).first()[0]
    return graph.plan_assist(edges, b.symbols, seed).select("file", F.round("certainty", 9).alias("certainty"), F.size("reasons").cast("long").alias("members"))


def _dead(b: Bridge) -> DataFrame:
    roots = b.symbols.filter(rules.is_root())
    return graph.dead_code(b.symbols, b.edges, roots).select("symbol_id", "name")


def _with_cycles(make):
    def run(b: Bridge) -> DataFrame:
        edges = cut(b.edges)
        return make(b, edges, cut(graph.cycles(edges)))

    return run


def _clusters(b: Bridge, edges: DataFrame, found: DataFrame) -> DataFrame:
    return graph.cycle_clusters(found, b.symbols).withColumn("representatives", F.array_join(F.col("representatives").cast("array<string>"), ","))


def _diff_blast(b: Bridge) -> DataFrame:
    hunks, changed = diff(b)
    return impact.diff_blast(b.edges, hunks, b.ranges, changed)


def _affected(b: Bridge) -> DataFrame:
    hunks, _ = diff(b)
    return impact.affected_tests(impact.diff_reach(b.edges, hunks, b.ranges), b.symbols.filter(rules.is_test()))


def _pairs(b: Bridge, *pairs: tuple[str, str]) -> DataFrame:
    return b.spark.createDataFrame(list(pairs), "from_layer string, to_layer string")


def _fitness(b: Bridge) -> DataFrame:
    found = rules.fitness(b.symbols, cut(b.edges), b.files, _pairs(b, ("core", "ui")), 0, 0.5)
    return rounded(found.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ",")), "instability")


def _merged(b: Bridge) -> DataFrame:
    """History of two halves, merged."""

    def half(df: DataFrame) -> DataFrame:
        return df.groupBy("path").agg(F.count("*").alias("commits"), F.collect_set("author").alias("author_keys"), F.max("ts").alias("last_changed"))

    c = b.commit_files
    out = metrics.merge_churn(half(c.filter("commit_id % 2 = 0")), half(c.filter("commit_id % 2 = 1")))
    return out.select("path", "commits", F.size("author_keys").cast("long").alias("authors"), "last_changed")


def _live(b: Bridge) -> DataFrame:
    """Files that the event stream leaves in place: a user is a path, a purchase its removal."""
    kind = F.when(F.col("event_type") == "purchase", "Removed").otherwise("Modified")
    last = last_events(b.raw("events").select(F.col("user_id").cast("string").alias("path"), kind.alias("kind"), "ts"))
    return last.filter("kind <> 'Removed'")


def _outlines(b: Bridge) -> DataFrame:
    """Outlines of the documents as files without symbols."""
    files = b.raw("documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(None).cast("string").alias("lang"), F.col("text").cast("binary").alias("content"))
    none = b.spark.createDataFrame([], "file string, name string, kind string, byte_start long, byte_end long, visibility string")
    return outlines(files, none).select("path", "kept_lines", "elided_lines")


def _disk(b: Bridge) -> tuple[DataFrame, DataFrame]:
    """Files as indexed and as on disk: ui files have changed, and data files have never been indexed."""
    files = b.files.select("path", F.col("layer").alias("content_hash"))
    return files.filter("content_hash <> 'data'"), files.withColumn("content_hash", F.when(F.col("content_hash") == "ui", "new").otherwise(F.col("content_hash")))


def _longer(marks: DataFrame) -> DataFrame:
    return marks.withColumn("be", F.col("be") + 60)


def _declared(b: Bridge) -> DataFrame:
    files = b.decls.select("path").distinct().withColumn("size", F.lit(0).cast("long"))
    return derive.symbols(b.decls, files)


def _scoped(b: Bridge) -> DataFrame:
    none = b.spark.createDataFrame([], "path string, name string, bs long, be long")
    return derive.scoped_edges(_declared(b), b.sites.select("path", "callee", "shape", "bs", "be"), none, none).select("src", "dst", "kind", "file", "byte_start")


def _occurrences(b: Bridge) -> DataFrame:
    return derive.occurrence_edges(_declared(b), b.sites.select("path", "sym", "bs", "be", "roles"), b.relationships).select("src", "dst", "kind")


def _crate_files(b: Bridge) -> DataFrame:
    path = F.col("file")
    return b.crate_symbols.select(path.alias("path"), "lang", rules.crate_of(path).alias("crate"), rules.layer_of(path).alias("layer")).distinct()


def _synopsis(b: Bridge) -> DataFrame:
    return metrics.synopsis(_crate_files(b), b.crate_symbols, b.edges).withColumn("languages", F.array_join("languages", ","))


def _architecture(b: Bridge) -> DataFrame:
    out = documents.architecture(b.crate_symbols, b.edges).filter("crate <> ''")
    return rounded(out.select("crate", "layer", "ca", "ce", "instability"), "instability")


def _pair_halves(b: Bridge) -> DataFrame:
    c = b.commit_files
    return metrics.merge_pairs(metrics.co_change_counts(c.filter("commit_id % 2 = 0")), metrics.co_change_counts(c.filter("commit_id % 2 = 1")))


_PLANS = {
    "list_symbols": lambda b: navigate.list_symbols(b.symbols, "ring", "ECONOMY").select("symbol_id", "name", "kind", "file"),
    "find_definition": lambda b: navigate.find_definition(b.symbols, "small ring").select("symbol_id", "name", "kind", "file"),
    "find_references": _references,
    "search_code": lambda b: navigate.search_code(b.symbols, "red widget", lang="GO", glob="Brand#1*").select("symbol_id", "name", "lang", "visibility", "file", "rank"),
    "search_regex": lambda b: navigate.search_code(b.symbols, "^(red|blue).*g$", regex=True).select("symbol_id", "name", "file"),
    "file_summary": lambda b: navigate.file_summary(b.symbols, b.stored_edges, "Brand#1")[0].select("symbol_id", "name", "kind", "byte_start", "fan_in", "fan_out"),
    "file_deps": _file_deps,
    "project_status": lambda b: navigate.project_status(b.files, b.symbols, b.stored_edges),
    "graph_edges": lambda b: b.edges,
    "degrees": lambda b: graph.degrees(b.symbols.select("symbol_id"), b.edges),
    "coupling": lambda b: rounded(metrics.coupling(b.modules, b.edges), "instability", "abstractness", "distance"),
    "cohesion": lambda b: rounded(metrics.cohesion(b.modules, b.edges), "cohesion"),
    "file_complexity": lambda b: metrics.complexity_ranking(b.symbols),
    "symbol_complexity": lambda b: metrics.complexity_ranking(b.symbols, "symbol", 50),
    "file_churn": lambda b: metrics.file_churn(b.commit_files),
    "co_change_counts": lambda b: metrics.co_change_counts(b.commit_files),
    "co_change": lambda b: rounded(metrics.co_change(metrics.co_change_counts(b.commit_files), metrics.file_churn(b.commit_files), min_degree=0.15), "degree"),
    "hotspots": lambda b: rounded(metrics.hotspots(metrics.file_churn(b.commit_files), metrics.file_complexity(b.symbols)), "score"),
    "symbol_churn": lambda b: metrics.symbol_churn(b.hunks, b.ranges),
    "symbol_hotspots": lambda b: rounded(metrics.hotspots(metrics.symbol_churn(b.hunks, b.ranges), b.symbols, "symbol_id"), "score"),
    "god_modules": _god,
    "wide_modules": lambda b: metrics.wide_modules(b.modules, b.edges),
    "misplaced": lambda b: rounded(metrics.misplaced(b.modules, b.edges), "ratio"),
    "neighbours": lambda b: metrics.neighbours(b.modules, b.edges),
    "reverse_bfs": lambda b: graph.callers(graph.of_kinds(b.edges, ["Calls", "Imports"]), tops(b.edges), 3),
    "blast_radius": _blast(),
    "blast_radius_calls": _blast(["Calls"]),
    "dominator_depths": lambda b: graph.dominators(cut(b.edges), tops(b.edges)),
    "plan_assist": _plan,
    "cycles": lambda b: graph.cycles(b.edges),
    "dead_code": _dead,
    "cycle_breaks": _with_cycles(lambda b, e, c: rounded(graph.cycle_breaks(e, b.symbols, c), "score")),
    "suggested_cuts": _with_cycles(lambda b, e, c: graph.suggested_cuts(e, c)),
    "cycle_clusters": _with_cycles(_clusters),
    "diff_blast": _diff_blast,
    "affected_tests": _affected,
    "roots": lambda b: b.symbols.select("symbol_id", rules.is_root().alias("root"), rules.is_test().alias("test")),
    "forbidden_edges": lambda b: rules.forbidden_edges(b.symbols, b.edges, b.files, _pairs(b, ("core", "ui"), ("data", "ui"))),
    "fitness": _fitness,
    "api_diff": lambda b: rules.api_diff(b.surface(1996), b.surface(1997)),
    "semver": lambda b: rules.semver(rules.api_diff(b.surface(1996), b.surface(1997))),
    "merge_history": _merged,
    "doc_kinds": lambda b: b.raw("pages").select("page_id", rules.doc_kind(F.col("url")).alias("doc_kind")),
    "live_files": _live,
    "outline_lines": _outlines,
    "reconcile": lambda b: reconcile(*_disk(b)),
    "fresh_spans": lambda b: impact.fresh_spans(b.ranges, *_disk(b)),
    "under": lambda b: navigate.under(rounded(metrics.hotspots(metrics.file_churn(b.commit_files), metrics.file_complexity(b.symbols)), "score"), "Brand#1", "path").select("path", "score"),
    "weak_spots": lambda b: rules.weak_spots(b.symbols, b.modules, b.edges, "Brand#1"),
    "symbol_ids": lambda b: _declared(b).select("symbol_id", "file", "kind", "name", "byte_start"),
    "scoped_edges": _scoped,
    "occurrence_edges": _occurrences,
    "innermost": lambda b: intervals.innermost(b.marks, b.wide_decls, places=b.mark_rows).select("site_id", "decl_id"),
    "container_or_largest": lambda b: intervals.container_or_largest(_longer(b.marks), b.wide_decls, "site_id", _longer(b.mark_rows)).select("site_id", "decl_id"),
    "next_start": lambda b: intervals.next_start(b.marks, b.wide_decls, "site_id").select("site_id", "decl_id"),
    "crate_paths": lambda b: b.crate_symbols.select("symbol_id", rules.crate_of(F.col("file")).alias("crate"), rules.layer_of(F.col("file")).alias("layer"), rules.role(F.col("kind"), F.col("file")).alias("role")),
    "boundary_violations": lambda b: rules.boundary_violations(b.crate_symbols, b.edges, "c1"),
    "crate_edges": lambda b: documents.crate_edges(b.crate_symbols, b.edges),
    "dominant_layer": lambda b: metrics.dominant_layer(_crate_files(b).select("path", "crate", "layer").distinct()),
    "synopsis": _synopsis,
    "architecture": _architecture,
    "layering": lambda b: graph.layers(cut(b.edges), b.symbols),
    "page": lambda b: ranked(b.symbols.select("symbol_id", "complexity"), [F.desc("complexity"), F.col("symbol_id")], 20, 10),
    "stale_keys": lambda b: stale(b.symbols, b.symbols.filter("complexity % 3 = 0"), ["symbol_id"]),
    "merge_pairs": _pair_halves,
}


def _over(make):
    return lambda spark, folder: make(Bridge(spark, folder))


QUERIES: dict = {name: _over(make) for name, make in _PLANS.items()}
