"""Symbols and edges from syntactic facts and from an indexer's occurrences.

Fact tables: decls (path, kind, name, def_bs, def_be, visibility, attributes, complexity), calls (path, callee, shape, bs, be),
renders and hooks (path, name, bs, be), occurrences (path, sym, bs, be, roles), relationships (path, from_key, to_key,
is_impl, is_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.intervals import innermost
from weftline.operators.navigate import kind_tag, nth
from weftline.operators.rules import crate_of, first_match, language, stem

COMPONENT_FILES = ["vue", "svelte", "astro"]
#: Bits of an occurrence's roles.
DEFINITION, IMPORT, WRITE, READ = 0x1, 0x2, 0x4, 0x8


def symbol_id(path: Column, kind: Column, name: Column, nth: Column) -> Column:
    """60 bits of SHA-256 over the parts: the same wherever and whenever the symbol is met, whatever else is in the file."""
    return F.conv(F.substring(F.sha2(F.concat_ws("#", path, kind, name, nth.cast("string")), 256), 1, 15), 16, 10).cast("long")


def symbols(decls: DataFrame, files: DataFrame) -> DataFrame:
    """One symbol a declaration; files of component languages also have a component over the whole file, named by its stem.
    files: path, size."""
    whole = files.withColumn("lang", language(F.col("path"))).filter(F.col("lang").isin(COMPONENT_FILES)).select(
        "path", F.lit("component").alias("kind"), stem(F.col("path")).alias("name"), F.lit(0).cast("long").alias("def_bs"), F.col("size").cast("long").alias("def_be"),
        F.lit("Public").alias("visibility"), F.array().cast("array<string>").alias("attributes"), F.lit(0).cast("long").alias("complexity"), F.lit(0).alias("_first"),
    )
    own = decls.select("path", "kind", "name", F.col("def_bs").cast("long").alias("def_bs"), F.col("def_be").cast("long").alias("def_be"), "visibility", "attributes", F.col("complexity").cast("long").alias("complexity"), F.lit(1).alias("_first"))
    numbered = nth(whole.unionByName(own), ["path", "name", "kind"], ["_first", "def_bs", "def_be"])
    out = numbered.withColumn("symbol_id", symbol_id(F.col("path"), F.col("kind"), F.col("name"), F.col("nth")))
    return out.select("symbol_id", "name", "kind", F.col("path").alias("file"), F.col("def_bs").alias("byte_start"), F.col("def_be").alias("byte_end"), "visibility", "attributes", "complexity", language(F.col("path")).alias("lang"))


def package(path: Column) -> Column:
    return F.coalesce(crate_of(path), F.lit(""))


def _around(sites: DataFrame, found: DataFrame) -> DataFrame:
    """sites with src, the innermost symbol around each."""
    spans = found.select(F.col("symbol_id").alias("decl_id"), F.col("file").alias("path"), F.col("byte_start").alias("def_bs"), F.col("byte_end").alias("def_be"))
    return innermost(sites, spans).withColumnRenamed("decl_id", "src").drop("def_bs", "def_be")


def scoped_edges(found: DataFrame, calls: DataFrame, renders: DataFrame, hooks: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, file, byte_start, byte_end) of calls, renders and hooks by name: a definition in the same file
    first, then one in the same package, then the only one there is. Method and path calls look in their file alone.
    Unresolved sites and self-calls give none; of sites with one edge, the first stays."""
    sites = (
        calls.select("path", F.col("callee").alias("name"), "bs", "be", F.lit("References").alias("kind"), (F.col("shape") == "free").alias("wide"), F.lit(0).alias("_o"))
        .unionByName(renders.select("path", "name", "bs", "be", F.lit("Renders").alias("kind"), F.lit(True).alias("wide"), F.lit(1).alias("_o")))
        .unionByName(hooks.select("path", "name", "bs", "be", F.lit("UsesHook").alias("kind"), F.lit(True).alias("wide"), F.lit(2).alias("_o")))
        .withColumn("site_id", F.struct("path", "_o", "bs", "be", "name", "wide"))
    )
    sites = _around(sites, found)
    # of each name: the first symbol of each file, of each package, and the only one overall
    order = F.struct("file", "byte_start", "symbol_id")
    by_file = found.groupBy("name", F.col("file").alias("path")).agg(F.min_by("symbol_id", order).alias("d1"))
    by_package = found.groupBy("name", package(F.col("file")).alias("package")).agg(F.min_by("symbol_id", order).alias("d2"))
    alone = found.groupBy("name").agg(F.count("*").alias("_n"), F.min("symbol_id").alias("d3")).filter("_n = 1").drop("_n")
    both = sites.withColumn("package", package(F.col("path"))).join(by_file, ["name", "path"], "left").join(by_package, ["name", "package"], "left").join(alone, "name", "left")
    dst = F.coalesce("d1", F.when(F.col("wide"), F.coalesce("d2", "d3")))
    edges = both.withColumn("dst", dst).filter("dst is not null and dst <> src")
    out = first_match(edges, ["src", "kind", "dst"], [F.col("path"), F.col("_o"), F.col("bs")])
    return out.select("src", "dst", "kind", F.col("path").alias("file"), F.col("bs").alias("byte_start"), F.col("be").alias("byte_end"))


def role_kind(roles: Column) -> Column:
    return F.when(roles.bitwiseAND(IMPORT) != 0, "Imports").when(roles.bitwiseAND(WRITE) != 0, "Writes").when(roles.bitwiseAND(READ) != 0, "Reads").otherwise("References")


def occurrence_edges(found: DataFrame, occurrences: DataFrame, relationships: DataFrame) -> DataFrame:
    """Edges of an indexer's facts: definitions map a key to the symbol around them (the first by path and place wins), other
    occurrences lead from the symbol around them; relationships give Implements and TypeOf, each for its own flag."""
    sites = _around(occurrences.withColumn("site_id", F.struct("path", "bs", "be", "sym", "roles")).distinct(), found)
    defs = sites.filter(F.col("roles").bitwiseAND(DEFINITION) != 0).groupBy("sym").agg(F.min_by(F.struct("src", "path", "bs", "be"), F.struct("path", "bs", "be")).alias("d"))
    at = defs.select("sym", F.col("d.src").alias("dst"))
    uses = sites.filter(F.col("roles").bitwiseAND(DEFINITION) == 0).join(at, "sym").select("src", "dst", role_kind(F.col("roles")).alias("kind"), F.col("path").alias("file"), F.col("bs").alias("byte_start"), F.col("be").alias("byte_end"))
    a = defs.select(F.col("sym").alias("from_key"), F.col("d.src").alias("src"), F.col("d.path").alias("file"), F.col("d.bs").alias("byte_start"), F.col("d.be").alias("byte_end"))
    b = at.withColumnRenamed("sym", "to_key")
    kinds = F.explode(F.filter(F.array(F.when(F.col("is_impl"), F.lit("Implements")), F.when(F.col("is_type"), F.lit("TypeOf"))), lambda k: k.isNotNull()))
    related = relationships.join(a, "from_key").join(b, "to_key").select("src", "dst", kinds.alias("kind"), "file", "byte_start", "byte_end")
    edges = uses.unionByName(related).filter("src <> dst")
    return first_match(edges, ["src", "kind", "dst"], [F.col("file"), F.col("byte_start"), F.col("byte_end")])


def gated_edges(found: DataFrame, facts: dict[str, DataFrame], occurrences: DataFrame, relationships: DataFrame, files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Edges of every file from one source: the indexer's facts where its hash is the file's present one, else by name.
    files: path, content_hash; indexed: path, indexed_hash."""
    fresh = files.join(indexed, "path").filter(F.col("content_hash") == F.col("indexed_hash")).select("path")
    rest = {k: v.join(fresh, "path", "left_anti") for k, v in facts.items()}
    by_name = scoped_edges(found, rest["calls"], rest["renders"], rest["hooks"])
    by_index = occurrence_edges(found, occurrences.join(fresh, "path", "left_semi"), relationships.join(fresh, "path", "left_semi"))
    return first_match(by_name.unionByName(by_index), ["src", "kind", "dst"], [F.col("file"), F.col("byte_start")])


def merged_facts(layers: list[DataFrame], order: list[str]) -> DataFrame:
    """Facts of several layers of a file as one list in place order, without repeats next to each other."""
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    w = Window.partitionBy("path").orderBy(*order)
    row = F.struct(*layers[0].columns)
    return out.withColumn("_p", F.lag(row).over(w)).filter(~row.eqNullSafe(F.col("_p"))).drop("_p")


def components(decls: DataFrame, tags: DataFrame) -> DataFrame:
    """Functions and variables whose span holds a markup tag become components. tags: path, bs, be."""
    hold = decls.filter(F.col("kind").isin("function", "variable")).join(tags.select("path", F.col("bs").alias("_b"), F.col("be").alias("_e")), "path").filter("def_bs <= _b and def_be >= _e").select("path", "def_bs", "def_be", "name", F.lit(True).alias("_c")).distinct()
    both = decls.join(hold, ["path", "def_bs", "def_be", "name"], "left")
    return both.withColumn("kind", F.when(F.col("_c"), "component").otherwise(F.col("kind"))).drop("_c")


def complexity(decls: DataFrame, decisions: DataFrame) -> DataFrame:
    """decls with complexity: decisions (path, bs, be) in their own span, not in a declaration inside it, and one more;
    0 for what isn't a function, method or component."""
    spans = decls.withColumn("decl_id", F.struct("def_bs", "def_be", "name"))
    hit = innermost(decisions.withColumn("site_id", F.struct("path", "bs", "be")), spans.select("decl_id", "path", "def_bs", "def_be")).groupBy("path", "decl_id").agg(F.count("*").alias("_n"))
    n = F.when(F.col("kind").isin("function", "method", "component"), F.coalesce("_n", F.lit(0)) + 1).otherwise(0)
    return spans.drop("complexity").join(hit, ["path", "decl_id"], "left").withColumn("complexity", n.cast("long")).drop("_n", "decl_id")


def public_surface(found: DataFrame, sources: DataFrame) -> DataFrame:
    """(name, kind, signature, pos) of public symbols; the signature is the text before the first brace (Python: up to the
    last colon of the header line), white space made single. sources: path, content."""
    both = found.filter("visibility = 'Public'").join(sources, found["file"] == sources["path"])
    text = F.decode(F.substring(F.col("content"), F.col("byte_start").cast("int") + 1, (F.col("byte_end") - F.col("byte_start")).cast("int")), "UTF-8")
    line = F.substring_index(text, "\n", 1)
    python = F.when(line.contains(":"), F.regexp_extract(line, r"^(.*):", 1)).otherwise(line)
    head = F.when(F.col("lang") == "python", python).otherwise(F.substring_index(text, "{", 1))
    return both.select("name", "kind", F.trim(F.regexp_replace(head, r"\s+", " ")).alias("signature"), F.struct("file", "byte_start").alias("pos"))


def last_kind(stored: DataFrame) -> DataFrame:
    """Of edges between two symbols, that of the last stored kind."""
    return first_match(stored, ["src", "dst"], [kind_tag(F.col("kind")).desc()])
