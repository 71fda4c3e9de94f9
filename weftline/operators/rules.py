"""Classifiers of paths and symbols, architecture rules and comparison of API surfaces."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.graph import LOCAL, cycles, dead_code
from weftline.operators.metrics import coupling, wide_modules

# File extensions of each language.
LANGUAGES = {
    "rust": ["rs"],
    "typescript": ["ts", "mts", "cts"],
    "tsx": ["tsx"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "vue": ["vue"],
    "svelte": ["svelte"],
    "astro": ["astro"],
    "python": ["py", "pyi"],
    "go": ["go"],
    "java": ["java"],
    "kotlin": ["kt", "kts"],
    "csharp": ["cs"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "c++", "hpp", "hh", "hxx"],
}
SCRIPT_LANGUAGES = ["javascript", "typescript", "tsx", "vue", "svelte", "astro"]
# Order of visibilities, least visible first.
VISIBILITIES = ["Unknown", "Private", "Restricted", "Public"]


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name up to its last point; a name without one is its own stem."""
    return F.regexp_replace(file_name(path), r"(?s)\.[^.]*$", "")


def language(path: Column) -> Column:
    """Language by extension, case as it is; null for others."""
    ext = F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lang, names in LANGUAGES.items():
        out = out.when(ext.isin(names), lang)
    return out


def last_segment(name: Column) -> Column:
    """What follows the last :: or point."""
    return F.regexp_replace(name, r"(?s)^.*(?:::|\.)", "")


def crate_of(path: Column) -> Column:
    """<x> of crates/<x>/...; null elsewhere."""
    found = F.regexp_extract(path, r"^crates/([^/]+)", 1)
    return F.when(found != "", found)


def layer_of(path: Column, domain_crates: list[str] | None = None) -> Column:
    """Domain, Adapter or Interior by src/domain and src/adapters; whole crates can be declared Domain."""
    out = F.when(crate_of(path).isin(domain_crates), "Domain") if domain_crates else F.when(F.lit(False), F.lit(None).cast("string"))
    return out.when(path.contains("src/domain"), "Domain").when(path.contains("src/adapters"), "Adapter").otherwise("Interior")


def doc_kind(path: Column) -> Column:
    """Vendored, Generated, Fixture, Test, Config or Source: the first that fits, in this order."""

    def under(name: str) -> Column:
        return path.contains(f"/{name}/") | path.startswith(f"{name}/")

    return (
        F.when(path.contains("node_modules/") | path.endswith(".min.js"), "Vendored")
        .when(under("target") | path.endswith(".pb.rs"), "Generated")
        .when(under("fixtures"), "Fixture")
        .when(under("tests") | under("benches") | path.contains("_test.") | path.endswith("/tests.rs"), "Test")
        .when(path.contains(".claude/") | F.lower(path).rlike(r"[^/]\.(toml|lock|json|yaml|yml)$"), "Config")
        .otherwise("Source")
    )


def in_scope(path: Column, excludes: list[str] | None = None) -> Column:
    """Source paths that hold none of the strings."""
    out = doc_kind(path) == "Source"
    for x in excludes or []:
        out &= ~path.contains(x)
    return out


def library_target(path: Column) -> Column:
    """Neither build.rs nor under tests, benches or examples."""
    return (file_name(path) != "build.rs") & ~path.rlike(r"(^|/)(tests|benches|examples)/")


def role(kind: Column, path: Column) -> Column:
    """One line on a symbol: its kind, crate and layer."""
    layer = F.lower(layer_of(path))
    return F.concat(kind, F.lit(" in the "), F.coalesce(F.concat(crate_of(path), F.lit(" ")), F.lit("")), layer, F.lit(" layer"))


def _leaf(attributes: Column, names: list[str], any_case: bool = False) -> Column:
    wanted = [n.lower() for n in names] if any_case else names
    return F.coalesce(F.exists(attributes, lambda a: (F.lower(last_segment(F.regexp_replace(a, ":", "::"))) if any_case else last_segment(a)).isin(wanted)), F.lit(False))


def is_root(lang: str = "lang", visibility: str = "visibility", attributes: str = "attributes", kind: str = "kind", name: str = "name") -> Column:
    """Whether a symbol is an entry that nothing need call, by its language's conventions."""
    lang, public, attrs, kind, leaf = F.col(lang), F.col(visibility) == "Public", F.col(attributes), F.col(kind), last_segment(F.col(name))
    starts = F.coalesce(F.exists(attrs, lambda a: a.rlike(r"^(pytest|click|fastapi|app)\.") | a.isin("fixture", "task")), F.lit(False))
    out = (
        F.when(lang == "rust", public | _leaf(attrs, ["test", "bench", "no_mangle", "export_name"]) | (leaf == "main"))
        .when(lang == "go", public | (leaf == "main") | leaf.rlike("^(Test|Benchmark)"))
        .when(lang == "python", (leaf == "__main__") | leaf.rlike("^(test_|Test)") | starts)
        .when(lang.isin(SCRIPT_LANGUAGES), public)
        .when(lang.isin("java", "kotlin"), public | _leaf(attrs, ["Test", "ParameterizedTest", "RepeatedTest"]) | ((leaf == "main") & (kind != "field")))
        .when(lang == "csharp", public | _leaf(attrs, ["Fact", "Theory", "Test", "TestMethod"]) | ((leaf == "Main") & (kind != "field")) | (leaf == "main"))
        .when(lang.isin("c", "cpp"), public | (leaf == "main"))
    )
    return F.coalesce(out, F.lit(False))


def is_test(lang: str = "lang", path: str = "file", attributes: str = "attributes", kind: str = "kind", name: str = "name") -> Column:
    """Whether a symbol is a test, by its language's conventions for markers, files and names."""
    lang, path, attrs, name, callable_ = F.col(lang), F.col(path), F.col(attributes), F.col(name), F.col(kind).isin("function", "method")
    snake = file_name(path).startswith("test_") | stem(path).endswith("_test")
    out = (
        F.when(lang == "rust", _leaf(attrs, ["test"], True))
        .when(lang == "go", path.endswith("_test.go") & name.rlike("^(Test|Benchmark|Fuzz)"))
        .when(lang.isin("java", "kotlin"), _leaf(attrs, ["Test", "Fact"], True) | path.contains("src/test/") | stem(path).endswith("Test"))
        .when(lang == "csharp", _leaf(attrs, ["Test", "Fact", "Theory"], True) | stem(path).rlike("Tests?$"))
        .when(lang.isin("python", "c"), snake | (callable_ & name.startswith("test")))
        .when(lang == "cpp", snake | (callable_ & name.rlike("^(test|Test|TEST)")))
        .when(lang.isin(SCRIPT_LANGUAGES), file_name(path).contains(".test.") | file_name(path).contains(".spec."))
    )
    return F.coalesce(out, F.lit(False))


def layered(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """files (path) with the layer of the first (name, glob) that fits; null for none."""
    from weftline.functions.text import glob_regex

    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, glob in rules:
        out = out.when(F.col("path").rlike(glob_regex(glob)), name)
    return files.withColumn("layer", out)


def forbidden_edges(symbols: DataFrame, edges: DataFrame, files: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(from_file, to_file, from_layer, to_layer): file pairs with an edge from a layer to one that forbidden
    (from_layer, to_layer) names. files: path, layer."""
    at = symbols.select("symbol_id", F.col("file").alias("path")).join(files.select("path", "layer"), "path").filter("layer is not null")
    a = at.select(F.col("symbol_id").alias("src"), F.col("path").alias("from_file"), F.col("layer").alias("from_layer"))
    b = at.select(F.col("symbol_id").alias("dst"), F.col("path").alias("to_file"), F.col("layer").alias("to_layer"))
    pairs = edges.join(a, "src").join(b, "dst").filter("from_file <> to_file").select("from_file", "to_file", "from_layer", "to_layer").distinct()
    return pairs.join(forbidden, ["from_layer", "to_layer"], "left_semi")


def fitness(symbols: DataFrame, edges: DataFrame, files: DataFrame, forbidden: DataFrame, max_cycles: int = 0, max_instability: float | None = None, local: int = LOCAL) -> DataFrame:
    """Violations (rank, rule, from_file, to_file, members, instability): forbidden layer edges; every cycle once there are
    more than max_cycles; files less stable than allowed. Ordered by rank, then file or members."""
    none_s, none_a, none_d = F.lit(None).cast("string"), F.lit(None).cast("array<bigint>"), F.lit(None).cast("double")
    a = forbidden_edges(symbols, edges, files, forbidden).select(F.lit(0).alias("rank"), F.lit("forbidden").alias("rule"), "from_file", "to_file", none_a.alias("members"), none_d.alias("instability"))
    rings = cycles(edges, local).groupBy("cycle").agg(F.array_sort(F.collect_list("node")).alias("members"))
    many = rings.agg(F.count("*").alias("n")).filter(F.col("n") > max_cycles)
    b = rings.crossJoin(F.broadcast(many)).select(F.lit(1).alias("rank"), F.lit("cycle").alias("rule"), none_s.alias("from_file"), none_s.alias("to_file"), F.col("members").cast("array<bigint>").alias("members"), none_d.alias("instability"))
    out = a.unionAll(b)
    if max_instability is not None:
        modules = symbols.select(F.col("file").alias("module"), "symbol_id", F.lit(False).alias("is_abstract"))
        c = coupling(modules, edges).filter(F.col("instability") > max_instability)
        out = out.unionAll(c.select(F.lit(2).alias("rank"), F.lit("instability").alias("rule"), F.col("module").alias("from_file"), none_s.alias("to_file"), none_a.alias("members"), "instability"))
    return out.orderBy("rank", "from_file", "to_file", "members")


def boundary_violations(symbols: DataFrame, edges: DataFrame, core_crate: str | None = None, domain_crates: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """(src, dst, reason): edges between source files from domain to adapter, from the core crate to another, or between
    adapters of two crates; the first reason that fits."""
    at = symbols.filter(in_scope(F.col("file"), excludes)).select("symbol_id", crate_of(F.col("file")).alias("crate"), layer_of(F.col("file"), domain_crates).alias("layer"))
    a = at.select(F.col("symbol_id").alias("src"), F.col("crate").alias("ca"), F.col("layer").alias("la"))
    b = at.select(F.col("symbol_id").alias("dst"), F.col("crate").alias("cb"), F.col("layer").alias("lb"))
    core = (F.col("ca") == core_crate) & (F.col("cb") != core_crate) if core_crate else F.lit(False)
    reason = (
        F.when((F.col("la") == "Domain") & (F.col("lb") == "Adapter"), "domain to adapter")
        .when(core, "core to other crate")
        .when((F.col("la") == "Adapter") & (F.col("lb") == "Adapter") & (F.col("ca") != F.col("cb")), "adapter to adapter of another crate")
    )
    return edges.join(a, "src").join(b, "dst").select("src", "dst", reason.alias("reason")).filter("reason is not null").distinct()


def api_diff(base: DataFrame, head: DataFrame, order: str = "pos") -> DataFrame:
    """(name, kind, change, base_signature, head_signature): added, removed and changed public symbols. Of symbols with one
    name and kind, the last by `order` counts."""

    def last(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("name", "kind").agg(F.max_by("signature", order).alias(name))

    both = last(base, "base_signature").withColumn("_b", F.lit(1)).join(last(head, "head_signature").withColumn("_h", F.lit(1)), ["name", "kind"], "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_h").isNull(), "removed").when(~F.col("base_signature").eqNullSafe(F.col("head_signature")), "changed")
    return both.withColumn("change", change).filter("change is not null").select("name", "kind", "change", "base_signature", "head_signature").orderBy("name", "kind")


def semver(diff: DataFrame) -> DataFrame:
    """One row: verdict major, minor or none, the greatest any change asks for."""
    need = F.max(F.when(F.col("change").isin("removed", "changed"), 3).when(F.col("change") == "added", 2).otherwise(0))
    return diff.agg(need.alias("n")).select(F.when(F.col("n") == 3, "major").when(F.col("n") == 2, "minor").otherwise("none").alias("verdict"))


def visibility(lang: str, text: Column) -> Column:
    """Visibility that a declaration's modifier text gives by the language's words; Unknown where it gives none."""
    text = F.trim(text)

    def word(*names: str) -> Column:
        return text.rlike(r"(^|[^\p{L}\p{N}_])(" + "|".join(names) + r")([^\p{L}\p{N}_]|$)")

    if lang == "rust":
        return F.when(text == "pub", "Public").when(text.startswith("pub("), "Restricted").otherwise("Private")
    if lang in ("java", "kotlin", "csharp"):
        return F.when(word("public"), "Public").when(word("protected", "internal"), "Restricted").when(word("private"), "Private").otherwise("Unknown")
    if lang in ("typescript", "tsx", "javascript"):
        return F.when((text == "public") | text.startswith("export"), "Public").when(text == "protected", "Restricted").when(text == "private", "Private").otherwise("Unknown")
    if lang in ("c", "cpp"):
        return F.when(text.isin("public:", "public"), "Public").when(text.isin("protected:", "protected"), "Restricted").when(text.isin("static", "private:", "private"), "Private").otherwise("Unknown")
    return F.lit("Unknown")


def strongest(marks: DataFrame, keys: list[str], column: str = "visibility") -> DataFrame:
    """Of several visibilities of a declaration, the most visible."""
    rank = F.array_position(F.array(*map(F.lit, VISIBILITIES)), F.col(column))
    return marks.groupBy(*keys).agg(F.max_by(column, rank).alias(column))


def attribute_name(text: Column) -> Column:
    """The bare name of an attribute or decorator: without #[, #![ or @ before it and arguments after it."""
    return F.regexp_extract(text, r"^\s*#*!*\[*@*\s*([\p{L}\p{N}_.:]*)", 1)


def first_match(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def valid_pattern(pattern: str) -> str:
    """The pattern, once the session's own compiler, which will run it, has taken it; ValueError otherwise."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:
        raise ValueError(f"bad pattern: {e}") from None
    return pattern


def weak_spots(symbols: DataFrame, modules: DataFrame, edges: DataFrame, prefix: str = "", min_ce: int = 15, local: int = LOCAL) -> DataFrame:
    """(part, symbol_id, cycle, module, ce): members of cycles (part cycle), library modules with ce above min_ce (part module),
    and symbols without an incoming edge that are no root (part dead; tests count as dead). The prefix narrows modules alone."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    ring = cycles(edges, local).select(F.lit("cycle").alias("part"), F.col("node").alias("symbol_id"), "cycle", none("string", "module"), none("long", "ce"))
    wide = wide_modules(modules, edges, min_ce).filter(F.col("module").startswith(prefix))
    wide = wide.select(F.lit("module").alias("part"), none("long", "symbol_id"), none("long", "cycle"), "module", F.col("ce").cast("long").alias("ce"))
    dead = dead_code(symbols.select("symbol_id"), edges, symbols.filter(is_root()))
    dead = dead.select(F.lit("dead").alias("part"), "symbol_id", none("long", "cycle"), none("string", "module"), none("long", "ce"))
    return ring.unionAll(wide).unionAll(dead)
