"""Generated text on symbols, modules and projects, drawn from small collected results."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import graph, metrics, rules
from weftline.operators.navigate import definition

ROWS, REFERENCES = 10, 16


def _list(df: DataFrame, order: list, line, limit: int = ROWS, none: str = "None.") -> str:
    """The first rows as a list, with a note on how many more there are. No more than limit + 1 rows are collected."""
    rows = df.orderBy(*order).limit(limit).collect()
    if not rows:
        return none
    more = df.count() - len(rows)
    return "\n".join([*(f"- {line(r)}" for r in rows), *([f"- … and {more} more"] if more > 0 else [])])


def doc_for(symbols: DataFrame, edges: DataFrame, churn: DataFrame, name: str) -> dict:
    """Role, risk of the file, callers that must and may change with the symbol (to depth 3), and references in scope."""
    row = definition(symbols, name)
    seed = symbols.sparkSession.createDataFrame([(row["symbol_id"],)], "seed long")
    reach = graph.blast_radius(edges, seed, None, 3)
    n = {r["must"]: r["n"] for r in reach.groupBy("must").agg(F.count("*").alias("n")).collect()}
    refs = reach.filter("must").join(symbols.select(F.col("symbol_id").alias("node"), "name", "file"), "node").filter(rules.in_scope(F.col("file")))
    role = symbols.filter(F.col("symbol_id") == row["symbol_id"]).select(rules.role(F.col("kind"), F.col("file"))).first()[0]
    return {
        "name": row["name"],
        "kind": row["kind"],
        "file": row["file"],
        "role": role,
        "file_risk": metrics.file_risk(churn, metrics.file_complexity(symbols), row["file"]),
        "must": n.get(True, 0),
        "may": n.get(False, 0),
        "references": [r["name"] for r in refs.orderBy("node").limit(REFERENCES).collect()],
    }


def doc_for_module(symbols: DataFrame, edges: DataFrame, churn: DataFrame, module: str) -> str:
    """Markdown on one file as a module: role, neighbours, coupling, cycles, unused symbols, risk."""
    own = symbols.filter(F.col("file") == module)
    if own.isEmpty():
        raise LookupError(f"no module {module}")
    modules = symbols.select(F.col("file").alias("module"), "symbol_id", F.lit(False).alias("is_abstract"))
    names = symbols.select("symbol_id", "name")
    near = metrics.neighbours(modules, edges).filter(F.col("module") == module).join(names, "symbol_id")
    c = metrics.coupling(modules, edges).filter(F.col("module") == module).first()
    rings = graph.cycles(edges)
    mine = rings.join(own.select(F.col("symbol_id").alias("node"), "name"), "node")
    dead = graph.dead_code(own, edges, own.filter(rules.is_root()))
    risk = metrics.file_risk(churn, metrics.file_complexity(symbols), module)
    side = lambda s: _list(near.filter(F.col("side") == s), ["place"], lambda r: f"`{r['name']}` ({r['n']})")
    return "\n\n".join(
        [
            f"# {module}",
            f"{own.count()} symbols.",
            "## Callers",
            side("callers"),
            "## Callees",
            side("callees"),
            "## Coupling",
            f"in {c['ca']}, out {c['ce']}, instability {c['instability']:.2f}",
            "## Cycles",
            _list(mine, ["cycle", "node"], lambda r: f"`{r['name']}` in cycle {r['cycle']}"),
            "## Unused",
            _list(dead, ["symbol_id"], lambda r: f"`{r['name']}`"),
            "## Risk",
            "no history" if risk is None else f"{risk:.2f}",
        ]
    )


def architecture(symbols: DataFrame, edges: DataFrame, domain_crates: list[str] | None = None) -> DataFrame:
    """(crate, layer, ca, ce, instability, text) of crates with source files in scope; coupling is over all crates."""
    crate = F.coalesce(rules.crate_of(F.col("file")), F.lit(""))
    modules = symbols.select(crate.alias("module"), "symbol_id", F.lit(False).alias("is_abstract"))
    files = symbols.filter(rules.in_scope(F.col("file"))).select(F.col("file").alias("path"), crate.alias("crate"), rules.layer_of(F.col("file"), domain_crates).alias("layer")).distinct()
    out = metrics.coupling(modules, edges).withColumnRenamed("module", "crate").join(metrics.dominant_layer(files), "crate")
    text = F.when(F.col("instability") < 0.3, "stable: much depends on it").when(F.col("instability") > 0.7, "unstable: it depends on much").otherwise("between")
    return out.select("crate", "layer", "ca", "ce", "instability", text.alias("text"))


def crate_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_crate, to_crate): different crates with an edge between them."""
    at = symbols.select("symbol_id", rules.crate_of(F.col("file")).alias("c")).filter("c is not null")
    a, b = at.select(F.col("symbol_id").alias("src"), F.col("c").alias("from_crate")), at.select(F.col("symbol_id").alias("dst"), F.col("c").alias("to_crate"))
    return edges.join(a, "src").join(b, "dst").filter("from_crate <> to_crate").select("from_crate", "to_crate").distinct()


def doc_for_project(symbols: DataFrame, edges: DataFrame, churn: DataFrame, core_crate: str | None = None, domain_crates: list[str] | None = None) -> str:
    """Markdown on the whole: numbers, crates, boundary violations, cycles, risky files."""
    crate = F.coalesce(rules.crate_of(F.col("file")), F.lit(""))
    files = symbols.filter(rules.in_scope(F.col("file"))).select(F.col("file").alias("path"), "lang", crate.alias("crate"), rules.layer_of(F.col("file"), domain_crates).alias("layer")).distinct()
    s = metrics.synopsis(files, symbols, edges).first()
    names = symbols.select("symbol_id", "name")
    broken = rules.boundary_violations(symbols, edges, core_crate, domain_crates).join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst")
    rings = graph.cycles(edges)
    scope = symbols.filter(rules.in_scope(F.col("file")))
    clusters = graph.cycle_clusters(rings, scope)
    risky = metrics.hotspots(churn, metrics.file_complexity(symbols)).filter(rules.in_scope(F.col("path")))
    return "\n\n".join(
        [
            "# Project",
            f"{s['crates']} crates, {s['layers']} layers, {s['symbols']} symbols, {s['edges']} edges; {', '.join(s['languages'])}.",
            "## Architecture",
            _list(architecture(symbols, edges, domain_crates), ["crate"], lambda r: f"`{r['crate'] or '(root)'}` {r['layer']}: in {r['ca']}, out {r['ce']}, {r['text']}"),
            "## Boundary violations",
            _list(broken, ["src", "dst"], lambda r: f"`{r['a']}` to `{r['b']}`: {r['reason']}"),
            "## Cycles",
            _list(clusters, [F.desc("size"), "cycle"], lambda r: f"{r['size']} symbols: {', '.join(map(str, r['representatives']))}"),
            "## Risk",
            _list(risky, [F.desc("score"), "path"], lambda r: f"`{r['path']}` {r['score']:.2f}"),
        ]
    )


def digest(symbols: DataFrame, edges: DataFrame, files: int, overview: str = "", limit: int = 8, size: int = 600) -> str:
    """Numbers, the most coupled modules and the start of an overview."""
    modules = symbols.select(F.col("file").alias("module"), "symbol_id", F.lit(False).alias("is_abstract"))
    top = metrics.coupling(modules, edges).orderBy((F.col("ca") + F.col("ce")).desc(), "module").limit(limit).collect()
    lines = [f"{files} files, {symbols.count()} symbols, {edges.count()} edges", *(f"- {r['module']}: in {r['ca']}, out {r['ce']}" for r in top)]
    return "\n".join(lines + ([overview[:size]] if overview else []))


def diagram(nodes: list[str], links: list[tuple[str, str]], layer: dict[str, int], most: int = 24) -> str:
    """SVG of the nodes of greatest degree on a grid by layer, with a note on how many were left out."""
    degree = {n: sum(n in e for e in links) for n in nodes}
    kept = sorted(nodes, key=lambda n: (-degree[n], n))[:most]
    rows: dict[int, list[str]] = {}
    for n in sorted(kept):
        rows.setdefault(layer.get(n, 0), []).append(n)
    at = {n: (20 + 180 * k, 20 + 80 * y) for y, level in enumerate(sorted(rows, reverse=True)) for k, n in enumerate(rows[level])}
    width, height = 40 + 180 * max((len(r) for r in rows.values()), default=1), 60 + 80 * max(1, len(rows))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">']
    out += [f'<line x1="{at[a][0] + 75}" y1="{at[a][1] + 20}" x2="{at[b][0] + 75}" y2="{at[b][1] + 20}" stroke="gray"/>' for a, b in sorted(links) if a in at and b in at]
    out += [f'<g><rect x="{x}" y="{y}" width="150" height="40" fill="white" stroke="black"/><text x="{x + 8}" y="{y + 24}">{escape(n)}</text></g>' for n, (x, y) in sorted(at.items())]
    if len(nodes) > len(kept):
        out.append(f'<text x="20" y="{height - 10}">{len(nodes) - len(kept)} more not shown</text>')
    return "\n".join([*out, "</svg>"])


def slug(text: str) -> str:
    return "-".join("".join(c.lower() if c.isalnum() else " " for c in text).split())
