"""Search and navigation over symbols, stored edges and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import glob_regex
from weftline.operators.graph import KIND_TAGS, degrees, graph_edges
from weftline.operators.rules import first_match, valid_pattern


def list_symbols(symbols: DataFrame, query: str | None = None, kind: str | None = None, limit: int = 64) -> DataFrame:
    """Symbols whose name holds the text (any case) and of the kind, by id, the first `limit` (1 at least)."""
    out = symbols
    if query:
        out = out.filter(F.lower("name").contains(query.lower()))
    if kind:
        out = out.filter(F.col("kind") == kind)
    return out.orderBy("symbol_id").limit(max(1, limit))


def find_definition(symbols: DataFrame, name: str) -> DataFrame:
    """The symbol of that name; of several, that of least id."""
    return symbols.filter(F.col("name") == name).orderBy("symbol_id").limit(1)


def definition(symbols: DataFrame, name: str):
    """The row of find_definition; LookupError without one."""
    row = find_definition(symbols, name).first()
    if row is None:
        raise LookupError(f"no symbol {name}")
    return row


def kind_tag(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KIND_TAGS)), kind)


def find_references(symbols: DataFrame, stored: DataFrame, symbol_id: int) -> DataFrame:
    """(caller, caller_name, kind, file, byte_start): one row for each caller of the symbol, with its edge of the last kind;
    ordered by file, place and name. Edges have kind, file and byte_start."""
    into = first_match(stored.filter(F.col("dst") == symbol_id), ["src"], [kind_tag(F.col("kind")).desc()])
    names = symbols.select(F.col("symbol_id").alias("src"), F.col("name"))
    out = into.join(names, "src", "left").select(F.col("src").alias("caller"), F.coalesce("name", F.lit("<unknown>")).alias("caller_name"), "kind", F.coalesce("file", F.lit("")).alias("file"), "byte_start")
    return out.orderBy("file", "byte_start", "caller_name")


def search_code(symbols: DataFrame, query: str, regex: bool = False, kind: str | None = None, lang: str | None = None, visibility: str | None = None, glob: str | None = None, limit: int = 64) -> DataFrame:
    """Symbols by text or pattern in the name (any case) and filters; exact names first, then prefixes, then others, each by
    name and id."""
    name, q = F.lower("name"), query.lower()
    out = symbols.filter(F.col("name").rlike("(?i)" + valid_pattern(query)) if regex else name.contains(q))
    for column, value, exact in (("kind", kind, True), ("lang", lang, False), ("visibility", visibility, False)):
        if value is not None:
            out = out.filter(F.col(column) == value if exact else F.lower(column) == value.lower())
    if glob is not None:
        out = out.filter(F.col("file").rlike(glob_regex(glob)))
    rank = F.when(name == q, 0).when(name.startswith(q), 1).otherwise(2)
    return out.withColumn("rank", rank).orderBy("rank", "name", "symbol_id").limit(limit)


def read_symbol(symbols: DataFrame, sources: DataFrame, name: str, file: str | None = None, mode: str = "full", context: int = 3) -> DataFrame:
    """(symbol_id, name, file, text, stale, alternatives): the symbol's source. sources: path, content (bytes).

    mode full: its bytes; signature: up to its first brace or line end; context: with lines around it. stale: the span
    ends beyond the file. alternatives: the other files that define the name."""
    found = symbols.filter(F.col("name") == name)
    chosen = found.filter(F.col("file") == file) if file else found
    one = chosen.orderBy("symbol_id").limit(1)
    others = found.agg(F.array_sort(F.collect_set("file")).alias("_files"))
    both = one.join(sources, one["file"] == sources["path"]).crossJoin(F.broadcast(others))
    size = F.octet_length("content")
    start, end = F.least("byte_start", size), F.least("byte_end", size)

    def cut(a: Column, b: Column) -> Column:
        return F.decode(F.substring(F.col("content"), a.cast("int") + 1, F.greatest(b - a, F.lit(0)).cast("int")), "UTF-8")

    whole = cut(start, end)
    text = {
        "full": whole,
        "signature": F.regexp_extract(whole, r"(?s)^([^\n{]*)", 1),
        "context": F.concat(F.regexp_extract(cut(F.lit(0), start), rf"(?s)((?:[^\n]*\n){{0,{context}}}[^\n]*)$", 1), whole, F.regexp_extract(cut(end, size), rf"(?s)^([^\n]*(?:\n[^\n]*){{0,{context}}})", 1)),
    }
    if mode not in text:
        raise ValueError(f"no mode {mode}")
    return both.select("symbol_id", "name", "file", text[mode].alias("text"), (F.col("byte_end") > size).alias("stale"), F.array_remove("_files", F.col("file")).alias("alternatives"))


def file_summary(symbols: DataFrame, stored: DataFrame, file: str, deps: int = 5) -> tuple[DataFrame, DataFrame]:
    """Symbols of a file by place, with graph degrees; and (dep, n): the files that edges from its symbols have as evidence,
    other than itself, most edges first."""
    own = symbols.filter(F.col("file") == file)
    edges = graph_edges(stored)
    listed = degrees(own, edges).orderBy("byte_start", "symbol_id")
    out = stored.join(own.select(F.col("symbol_id").alias("src")), "src", "left_semi").withColumnRenamed("file", "dep").filter(F.col("dep") != file)
    return listed, out.groupBy("dep").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dep").limit(deps)


def component_graph(symbols: DataFrame, stored: DataFrame) -> DataFrame:
    """(symbol_id, name, renders, hooks): for each component the sorted names of what it renders and the hooks it uses."""
    names = symbols.select(F.col("symbol_id").alias("dst"), F.col("name").alias("_n"))
    uses = stored.filter(F.col("kind").isin("Renders", "UsesHook")).join(names, "dst", "left").withColumn("_n", F.coalesce("_n", F.lit("<unknown>")))
    by = uses.groupBy(F.col("src").alias("symbol_id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "Renders", F.col("_n")))).alias("renders"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "UsesHook", F.col("_n")))).alias("hooks"),
    )
    none = F.array().cast("array<string>")
    parts = symbols.filter(F.col("kind") == "component").select("symbol_id", "name").join(by, "symbol_id", "left")
    return parts.select("symbol_id", "name", F.coalesce("renders", none).alias("renders"), F.coalesce("hooks", none).alias("hooks"))


def project_status(files: DataFrame, symbols: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: files, symbols, graph edges."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(files, "files").crossJoin(n(symbols, "symbols")).crossJoin(n(graph_edges(stored), "edges"))


def under(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """Rows one of whose columns starts with the prefix. Scores come first: this filters a finished ranking."""
    keep = F.lit(False)
    for c in columns:
        keep |= F.col(c).startswith(prefix)
    return df.filter(keep)


def nth(df: DataFrame, keys: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """Place of each row among those of its keys, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
