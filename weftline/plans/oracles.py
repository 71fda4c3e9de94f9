"""DuckDB SQL of the registered queries; the common tables are the bridge's twins."""

from __future__ import annotations

TABLES = {
    "symbols": """SELECT p_partkey AS symbol_id, p_name AS name, p_type AS kind, p_brand AS file, CAST(10 * p_size AS BIGINT) AS byte_start,
 CAST(10 * p_size + 40 AS BIGINT) AS byte_end, CASE p_partkey % 7 WHEN 0 THEN 'Public' WHEN 1 THEN 'Restricted' ELSE 'Private' END AS visibility,
 CASE p_partkey % 11 WHEN 0 THEN ['tokio::test'] WHEN 1 THEN ['Test', 'app.route'] ELSE [] END AS attributes,
 ['rust','go','python','java','csharp','cpp','typescript','c'][CAST(p_partkey % 8 AS INT) + 1] AS lang, CAST(p_size AS BIGINT) AS complexity FROM part""",
    "hops": """SELECT l_orderkey, l_partkey, min(l_linenumber) AS n, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2""",
    "pairs": """SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY n, l_partkey) AS dst,
 CASE flag WHEN 'A' THEN 'References' WHEN 'N' THEN 'Imports' ELSE 'TypeOf' END AS kind, n FROM hops""",
    "stored": """SELECT src, dst, kind, CAST(min(n) * 10 AS BIGINT) AS byte_start, any_value(p_brand) AS file FROM pairs JOIN part ON p_partkey = src
 WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst, kind""",
    "edges": """SELECT DISTINCT src, dst, CASE WHEN kind IN ('Defines','Imports','Reads','Writes','TypeOf') THEN kind WHEN kind = 'Implements' THEN 'Overrides' ELSE 'Calls' END AS kind FROM stored""",
    "modules": "SELECT file AS module, symbol_id, symbol_id % 5 = 0 AS is_abstract FROM symbols",
    "sides": """SELECT e.*, a.module AS src_module, b.module AS dst_module FROM edges e LEFT JOIN modules a ON a.symbol_id = src LEFT JOIN modules b ON b.symbol_id = dst""",
    "fan": """SELECT s.symbol_id, (SELECT count(*) FROM edges WHERE dst = s.symbol_id) AS fan_in, (SELECT count(*) FROM edges WHERE src = s.symbol_id) AS fan_out FROM symbols s""",
    "coupled": """SELECT m.module, count(*) AS members,
 coalesce((SELECT count(DISTINCT src) FROM sides WHERE dst_module = m.module AND src_module IS DISTINCT FROM dst_module), 0) AS ca,
 coalesce((SELECT count(DISTINCT dst) FROM sides WHERE src_module = m.module AND src_module IS DISTINCT FROM dst_module), 0) AS ce,
 count(*) FILTER (is_abstract) AS abs FROM modules m GROUP BY m.module""",
    "coupling": """SELECT module, members, ca, ce, CASE WHEN ca + ce = 0 THEN 0.0 ELSE CAST(ce AS DOUBLE) / (ca + ce) END AS instability, CAST(abs AS DOUBLE) / members AS abstractness FROM coupled""",
    "cohesion": """SELECT m.module, CASE WHEN count(e.src) = 0 THEN 0.0 ELSE CAST(count(*) FILTER (e.src_module = e.dst_module) AS DOUBLE) / count(e.src) END AS cohesion
 FROM (SELECT DISTINCT module FROM modules) m LEFT JOIN sides e ON e.src_module = m.module OR e.dst_module = m.module GROUP BY m.module""",
    "commit_files": """SELECT DISTINCT l_orderkey AS commit_id, o_custkey AS author, o_orderdate AS ts, p_brand AS path FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""",
    "churn": "SELECT path, count(*) AS commits, count(DISTINCT author) AS authors, max(ts) AS last_changed FROM commit_files GROUP BY path",
    "sized": "SELECT commit_id FROM commit_files GROUP BY commit_id HAVING count(*) <= 50",
    "co": """SELECT x.path AS a, y.path AS b, count(*) AS count FROM commit_files x JOIN commit_files y ON x.commit_id = y.commit_id AND x.path < y.path
 WHERE x.commit_id IN (SELECT commit_id FROM sized) GROUP BY 1, 2""",
    "file_complexity": "SELECT file AS path, CAST(sum(complexity) AS BIGINT) AS complexity FROM symbols GROUP BY file",
    "hunks": """SELECT l_orderkey AS commit_id, p_brand AS path, CAST(7 * l_linenumber AS INT) AS start_line, CAST(7 * l_linenumber + CAST(l_quantity AS INT) AS INT) AS end_line FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "ranges": "SELECT p_partkey AS symbol_id, p_brand AS path, p_size AS first_line, p_size + 3 AS last_line FROM part",
    "diff_hunks": "SELECT DISTINCT path, start_line, end_line FROM hunks WHERE commit_id < 8",
    "diff_seeds": "SELECT DISTINCT symbol_id AS seed, path FROM diff_hunks JOIN ranges USING (path) WHERE start_line <= last_line AND first_line <= end_line",
    # seeds of the single-symbol queries: the three symbols most depended on
    "tops": "SELECT dst AS seed FROM (SELECT dst, count(*) AS n FROM edges GROUP BY dst ORDER BY n DESC, dst LIMIT 3)",
    "reach": """SELECT seed, node, min(hop) AS hop FROM walk WHERE node <> seed GROUP BY seed, node""",
    "layers": """SELECT DISTINCT p_brand AS path, CASE CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 3 WHEN 0 THEN 'ui' WHEN 1 THEN 'core' ELSE 'data' END AS layer FROM part""",
    "base_api": "SELECT CAST(l_partkey AS VARCHAR) AS name, l_returnflag AS kind, CAST(CAST(max(l_quantity) AS INT) AS VARCHAR) AS signature FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1, 2",
    "head_api": "SELECT CAST(l_partkey AS VARCHAR) AS name, l_returnflag AS kind, CAST(CAST(max(l_quantity) AS INT) AS VARCHAR) AS signature FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1, 2",
    "api": """SELECT coalesce(b.name, h.name) AS name, coalesce(b.kind, h.kind) AS kind, CASE WHEN b.name IS NULL THEN 'added' WHEN h.name IS NULL THEN 'removed' ELSE 'changed' END AS change,
 b.signature AS base_signature, h.signature AS head_signature FROM base_api b FULL JOIN head_api h ON b.name = h.name AND b.kind = h.kind
 WHERE b.name IS NULL OR h.name IS NULL OR b.signature <> h.signature""",
    "leaf": "SELECT *, regexp_replace(name, '^.*(::|\\.)', '') AS seg, list_transform(attributes, lambda x: regexp_replace(x, '^.*(::|\\.)', '')) AS segs FROM symbols",
    "marked": """SELECT symbol_id, CASE lang WHEN 'rust' THEN visibility = 'Public' OR list_has_any(segs, ['test','bench','no_mangle','export_name']) OR seg = 'main'
 WHEN 'go' THEN visibility = 'Public' OR seg = 'main' OR seg LIKE 'Test%' OR seg LIKE 'Benchmark%'
 WHEN 'python' THEN seg = '__main__' OR starts_with(seg, 'test_') OR seg LIKE 'Test%' OR len(list_filter(attributes, lambda a: starts_with(a, 'pytest.') OR starts_with(a, 'click.') OR starts_with(a, 'fastapi.') OR starts_with(a, 'app.') OR a IN ('fixture', 'task'))) > 0
 WHEN 'java' THEN visibility = 'Public' OR list_has_any(segs, ['Test','ParameterizedTest','RepeatedTest']) OR seg = 'main' AND kind <> 'field'
 WHEN 'csharp' THEN visibility = 'Public' OR list_has_any(segs, ['Fact','Theory','Test','TestMethod']) OR seg = 'Main' AND kind <> 'field' OR seg = 'main'
 WHEN 'typescript' THEN visibility = 'Public' ELSE visibility = 'Public' OR seg = 'main' END AS root,
 CASE lang WHEN 'rust' THEN list_contains(list_transform(segs, lambda x: lower(x)), 'test') WHEN 'go' THEN file LIKE '%\\_test.go' ESCAPE '\\' AND name SIMILAR TO '(Test|Benchmark|Fuzz).*'
 WHEN 'java' THEN list_has_any(list_transform(segs, lambda x: lower(x)), ['test','fact']) OR file LIKE '%src/test/%'
 WHEN 'csharp' THEN list_has_any(list_transform(segs, lambda x: lower(x)), ['test','fact','theory'])
 WHEN 'typescript' THEN file LIKE '%.test.%' OR file LIKE '%.spec.%' ELSE kind IN ('function','method') AND starts_with(name, 'test') END AS test FROM leaf""",
    "crate_symbols": """SELECT * REPLACE (CASE WHEN n % 7 = 0 THEN 'tools/' ELSE 'crates/c' || (n % 4) || '/' END || CASE n % 3 WHEN 0 THEN 'src/domain' WHEN 1 THEN 'src/adapters' ELSE 'src' END || '/' || file || '.rs' AS file)
 FROM (SELECT *, CAST(regexp_extract(file, '(\\d+)$', 1) AS INT) AS n FROM symbols)""",
    "crates": """SELECT *, nullif(regexp_extract(file, '^crates/([^/]+)', 1), '') AS crate, CASE WHEN contains(file, 'src/domain') THEN 'Domain' WHEN contains(file, 'src/adapters') THEN 'Adapter' ELSE 'Interior' END AS layer FROM crate_symbols""",
    "declared": """SELECT CAST('0x' || substr(sha256(concat_ws('#', file, kind, name, CAST(nth AS VARCHAR))), 1, 15) AS BIGINT) AS symbol_id, * FROM
 (SELECT p_brand AS file, p_type AS kind, p_name AS name, 100 * p_partkey AS bs, row_number() OVER (PARTITION BY p_brand, p_type, p_name ORDER BY p_partkey) - 1 AS nth, p_partkey FROM part)""",
    "sites": """SELECT DISTINCT a.p_brand AS path, 100 * l_partkey + l_linenumber AS bs, b.p_name AS callee, CASE l_returnflag WHEN 'A' THEN 'free' WHEN 'N' THEN 'method' ELSE 'path' END AS shape,
 'k' || (l_suppkey % 50) AS sym, CASE l_linenumber % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 0 END AS roles FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey""",
    "placed": "SELECT s.*, d.symbol_id AS src FROM sites s JOIN declared d ON d.p_partkey = s.bs // 100",
    "resolved": """SELECT src, path, bs, coalesce((SELECT arg_min(symbol_id, bs) FROM declared d WHERE d.name = callee AND d.file = path),
 CASE WHEN shape = 'free' THEN (SELECT arg_min(symbol_id, struct_pack(f := file, b := bs)) FROM declared d WHERE d.name = callee) END) AS dst FROM placed""",
    "defs": "SELECT sym, arg_min(src, struct_pack(p := path, b := bs)) AS dst FROM placed WHERE roles % 2 = 1 GROUP BY sym",
    "wide": "SELECT p_partkey AS decl_id, p_brand AS path, 10 * p_size AS def_bs, 10 * p_size + 40 * (p_partkey % 5 + 1) AS def_be FROM part",
    "marks": """SELECT site_id, m.p AS path, m.b AS bs, m.b + 5 AS be FROM (SELECT 100 * l_orderkey + 10 * l_linenumber AS site_id, min(struct_pack(p := p_brand, b := 60 * l_linenumber + CAST(l_quantity AS INT))) AS m
 FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)""",
}
#: Recursive tables: reachability along callers from `tops`, and all pairs over the edges without direction of kinds.
WALK = """walk AS (SELECT seed, seed AS node, 0 AS hop FROM tops UNION SELECT w.seed, e.src, w.hop + 1 FROM walk w JOIN edges e ON e.dst = w.node {kinds} WHERE w.hop < 3)"""
CLOSURE = "closure AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT c.a, e.dst FROM closure c JOIN edges e ON e.src = c.b)"
CYCLE = "cycle AS (SELECT a AS node, least(a, min(b)) AS cycle FROM closure x WHERE a <> b AND EXISTS (SELECT 1 FROM closure y WHERE y.a = x.b AND y.b = x.a) GROUP BY a)"
#: All callers of a seed, to any depth, and for each node d who reaches the seed's side without d.
ANCESTORS = "anc AS (SELECT seed, seed AS node FROM {seeds} UNION SELECT a.seed, e.src FROM anc a JOIN edges e ON e.dst = a.node)"
AVOIDS = """avoids AS (SELECT DISTINCT d.seed, d.node AS d, e.src AS x FROM anc d JOIN edges e ON e.dst = d.seed WHERE d.node <> d.seed AND e.src <> d.node AND e.src <> d.seed
 UNION SELECT v.seed, v.d, e.src FROM avoids v JOIN edges e ON e.dst = v.x WHERE e.src <> v.d AND e.src <> v.seed)"""
TREE = """tree AS (SELECT a.seed, a.node, 1 + (SELECT count(*) FROM anc d WHERE d.seed = a.seed AND d.node NOT IN (d.seed, a.node)
 AND NOT EXISTS (SELECT 1 FROM avoids v WHERE v.seed = a.seed AND v.d = d.node AND v.x = a.node)) AS depth FROM anc a WHERE a.node <> a.seed)"""


def sql(body: str, *recursive: str) -> str:
    """The query with the common tables it needs before it."""
    import re

    parts = {re.match(r"\w+", r)[0]: r for r in recursive}
    order: list[str] = []

    def need(text: str) -> None:
        for name in [*TABLES, *parts]:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need(TABLES[name] if name in TABLES else re.sub(rf"\b(?:FROM|JOIN)\s+{name}\b", "", parts[name]))
                if name not in order:
                    order.append(name)

    need(body)
    ctes = ",\n".join(f"{n} AS ({TABLES[n]})" if n in TABLES else parts[n] for n in order)
    return f"WITH RECURSIVE {ctes}\n{body}" if ctes else body


_TREE3 = (ANCESTORS.format(seeds="tops"), AVOIDS, TREE)
_DIFF_WALK = "dwalk AS (SELECT seed, seed AS node, 0 AS hop FROM diff_seeds UNION SELECT w.seed, e.src, w.hop + 1 FROM dwalk w JOIN edges e ON e.dst = w.node WHERE w.hop < 3)"
_DIFF = (ANCESTORS.format(seeds="diff_seeds"), AVOIDS, TREE, _DIFF_WALK, "dmust AS (SELECT DISTINCT t.node FROM tree t JOIN dwalk w ON w.seed = t.seed AND w.node = t.node WHERE depth = 1)")
_DIFF_BODY = """SELECT DISTINCT 'seed' AS part, seed AS symbol_id, CAST(NULL AS VARCHAR) AS path FROM diff_seeds
UNION ALL SELECT 'must', node, NULL FROM dmust
UNION ALL SELECT DISTINCT 'may', node, NULL FROM dwalk WHERE node <> seed AND node NOT IN (SELECT node FROM dmust)
UNION ALL SELECT 'unresolved', NULL, path FROM (SELECT DISTINCT path FROM diff_hunks WHERE path NOT IN (SELECT path FROM diff_seeds))"""

SQL = {
    "list_symbols": sql("SELECT symbol_id, name, kind, file FROM symbols WHERE contains(lower(name), 'ring') AND kind = 'ECONOMY' ORDER BY symbol_id LIMIT 64"),
    "find_definition": sql("SELECT symbol_id, name, kind, file FROM symbols WHERE name = 'small ring' ORDER BY symbol_id LIMIT 1"),
    "find_references": sql("""SELECT t.seed, r.src AS caller, s.name AS caller_name, r.kind, r.file, r.byte_start FROM (SELECT * FROM tops ORDER BY seed LIMIT 1) t,
 LATERAL (SELECT *, row_number() OVER (PARTITION BY src ORDER BY list_position(['Defines','References','Imports','Reads','Writes','Implements','TypeOf'], kind) DESC) AS k FROM stored WHERE dst = t.seed) r JOIN symbols s ON s.symbol_id = r.src WHERE k = 1"""),
    "search_code": sql("""SELECT symbol_id, name, lang, visibility, file, CASE WHEN lower(name) = 'red widget' THEN 0 WHEN starts_with(lower(name), 'red widget') THEN 1 ELSE 2 END AS rank FROM symbols
 WHERE contains(lower(name), 'red widget') AND lang = 'go' AND file LIKE 'Brand#1%' ORDER BY rank, name, symbol_id LIMIT 64"""),
    "search_regex": sql("SELECT symbol_id, name, file FROM symbols WHERE regexp_matches(lower(name), '^(red|blue).*g$') ORDER BY CASE WHEN lower(name) = '^(red|blue).*g$' THEN 0 WHEN starts_with(lower(name), '^(red|blue).*g$') THEN 1 ELSE 2 END, name, symbol_id LIMIT 64"),
    "file_summary": sql("SELECT s.symbol_id, s.name, s.kind, s.byte_start, fan_in, fan_out FROM symbols s JOIN fan USING (symbol_id) WHERE file = 'Brand#1'"),
    "file_deps": sql("SELECT p.p_brand AS dep, count(*) AS n FROM stored JOIN part p ON p.p_partkey = dst WHERE file = 'Brand#1' AND p.p_brand <> 'Brand#1' GROUP BY 1 ORDER BY n DESC, dep LIMIT 5"),
    "project_status": sql("SELECT (SELECT count(*) FROM layers) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges"),
    "graph_edges": sql("SELECT src, dst, kind FROM edges"),
    "degrees": sql("SELECT symbol_id, fan_in, fan_out FROM fan"),
    "coupling": sql("SELECT module, members, ca, ce, round(instability, 9) AS instability, round(abstractness, 9) AS abstractness, round(abs(abstractness + instability - 1), 9) AS distance FROM coupling"),
    "cohesion": sql("SELECT module, round(cohesion, 9) AS cohesion FROM cohesion"),
    "file_complexity": sql("SELECT path, complexity FROM file_complexity"),
    "symbol_complexity": sql("SELECT symbol_id, name, file AS path, complexity FROM symbols ORDER BY complexity DESC, symbol_id LIMIT 50"),
    "file_churn": sql("SELECT path, commits, authors, last_changed FROM churn"),
    "co_change_counts": sql("SELECT a, b, count FROM co"),
    "co_change": sql("""SELECT a, b, count, round(count / ((x.commits + y.commits) / 2.0), 9) AS degree FROM co JOIN churn x ON x.path = a JOIN churn y ON y.path = b
 WHERE x.commits >= 5 AND y.commits >= 5 AND count >= 5 AND count / ((x.commits + y.commits) / 2.0) >= 0.15"""),
    "hotspots": sql("""SELECT path, commits, coalesce(complexity, 0) AS complexity, round((CAST(commits AS DOUBLE) / max(commits) OVER ()) * (CAST(coalesce(complexity, 0) AS DOUBLE) / nullif(max(coalesce(complexity, 0)) OVER (), 0)), 9) AS score FROM churn LEFT JOIN file_complexity USING (path)"""),
    "symbol_churn": sql("SELECT symbol_id, count(DISTINCT commit_id) AS commits FROM hunks JOIN ranges USING (path) WHERE start_line <= last_line AND first_line <= end_line GROUP BY symbol_id"),
    "symbol_hotspots": sql("""SELECT symbol_id, commits, complexity, round((CAST(commits AS DOUBLE) / max(commits) OVER ()) * (CAST(complexity AS DOUBLE) / max(complexity) OVER ()), 9) AS score
 FROM (SELECT symbol_id, count(DISTINCT commit_id) AS commits FROM hunks JOIN ranges USING (path) WHERE start_line <= last_line AND first_line <= end_line GROUP BY symbol_id) JOIN symbols USING (symbol_id)"""),
    "god_modules": sql("""SELECT c.module, ce, round(cohesion, 9) AS cohesion, first AS first_symbol, share FROM coupling c JOIN cohesion USING (module) JOIN
 (SELECT module, arg_max(symbol_id, struct_pack(n := n, i := -symbol_id)) AS first, CAST(round(100.0 * max(n) / sum(n)) AS BIGINT) AS share FROM
 (SELECT src_module AS module, src AS symbol_id, count(*) AS n FROM sides WHERE src_module IS NOT NULL AND src_module IS DISTINCT FROM dst_module GROUP BY 1, 2) GROUP BY 1) USING (module)
 WHERE ce > 8 AND cohesion < 0.3"""),
    "wide_modules": sql("SELECT module, ce FROM coupling WHERE ce > 15"),
    "misplaced": sql("""SELECT symbol_id, from_module, to_module, round(n / greatest(own, 1), 9) AS ratio FROM
 (SELECT a.*, coalesce(o.n, 0) AS own, row_number() OVER (PARTITION BY a.symbol_id ORDER BY a.n DESC, a.to_module) AS k FROM
 (SELECT dst AS symbol_id, dst_module AS from_module, src_module AS to_module, count(*) AS n FROM sides WHERE kind IN ('Calls','Imports') GROUP BY 1, 2, 3) a LEFT JOIN
 (SELECT dst AS symbol_id, count(*) AS n FROM sides WHERE kind IN ('Calls','Imports') AND src_module = dst_module GROUP BY 1) o USING (symbol_id) WHERE from_module <> to_module) WHERE k = 1 AND n > 2 * own"""),
    "neighbours": sql("""SELECT module, side, symbol_id, n, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY module, side ORDER BY n DESC, symbol_id) AS INT) AS place FROM
 (SELECT dst_module AS module, 'callers' AS side, src AS symbol_id, count(*) AS n FROM sides WHERE src_module IS DISTINCT FROM dst_module GROUP BY 1, 3
 UNION ALL SELECT src_module, 'callees', dst, count(*) FROM sides WHERE src_module IS DISTINCT FROM dst_module GROUP BY 1, 3)) WHERE place <= 10"""),
    "reverse_bfs": sql("SELECT seed, node, hop FROM reach", WALK.format(kinds="AND e.kind IN ('Calls', 'Imports')")),
    "blast_radius": sql("SELECT r.seed, r.node, hop, depth = 1 AS must FROM reach r JOIN tree t ON t.seed = r.seed AND t.node = r.node", WALK.format(kinds=""), *_TREE3),
    "blast_radius_calls": sql("SELECT r.seed, r.node, hop, depth = 1 AS must FROM reach r JOIN tree t ON t.seed = r.seed AND t.node = r.node", WALK.format(kinds="AND e.kind = 'Calls'"), *_TREE3),
    "dominator_depths": sql("SELECT seed, node, depth FROM tree", *_TREE3),
    "plan_assist": sql("""SELECT file, round(sum(1.0 / depth), 9) AS certainty, count(*) AS members FROM tree t JOIN symbols ON symbol_id = t.node
 WHERE t.seed = (SELECT min(seed) FROM tops) GROUP BY file ORDER BY certainty DESC, file LIMIT 16""", *_TREE3),
    "cycles": sql("SELECT node, cycle FROM cycle", CLOSURE, CYCLE),
    "dead_code": sql("SELECT symbol_id, name FROM symbols WHERE symbol_id NOT IN (SELECT dst FROM edges) AND symbol_id NOT IN (SELECT symbol_id FROM marked WHERE root)"),
    "cycle_breaks": sql("""SELECT src, dst, kind, a.cycle, round(1.0 / greatest(x.fan_in, y.fan_out, 1), 9) AS score FROM edges JOIN cycle a ON a.node = src JOIN cycle b ON b.node = dst AND a.cycle = b.cycle
 JOIN fan x ON x.symbol_id = src JOIN fan y ON y.symbol_id = dst""", CLOSURE, CYCLE),
    "suggested_cuts": sql("SELECT a.cycle, arg_min(src, struct_pack(s := src, d := dst)) AS src, arg_min(dst, struct_pack(s := src, d := dst)) AS dst FROM edges JOIN cycle a ON a.node = src JOIN cycle b ON b.node = dst AND a.cycle = b.cycle GROUP BY a.cycle", CLOSURE, CYCLE),
    "cycle_clusters": sql("SELECT cycle, count(*) AS size, array_to_string(list_sort(list(node))[1:6], ',') AS representatives FROM cycle GROUP BY cycle", CLOSURE, CYCLE),
    "diff_blast": sql(_DIFF_BODY, *_DIFF),
    "affected_tests": sql(f"SELECT DISTINCT d.symbol_id FROM ({_DIFF_BODY}) d JOIN marked m ON m.symbol_id = d.symbol_id WHERE m.test", *_DIFF),
    "roots": sql("SELECT symbol_id, root, test FROM marked"),
    "forbidden_edges": sql("""SELECT DISTINCT x.path AS from_file, y.path AS to_file, x.layer AS from_layer, y.layer AS to_layer FROM edges JOIN symbols a ON a.symbol_id = src JOIN symbols b ON b.symbol_id = dst
 JOIN layers x ON x.path = a.file JOIN layers y ON y.path = b.file WHERE x.path <> y.path AND (x.layer = 'core' AND y.layer = 'ui' OR x.layer = 'data' AND y.layer = 'ui')"""),
    "fitness": sql("""SELECT 0 AS rank, 'forbidden' AS rule, from_file, to_file, CAST(NULL AS VARCHAR) AS members, CAST(NULL AS DOUBLE) AS instability FROM (SELECT DISTINCT x.path AS from_file, y.path AS to_file FROM edges JOIN symbols a ON a.symbol_id = src JOIN symbols b ON b.symbol_id = dst
 JOIN layers x ON x.path = a.file JOIN layers y ON y.path = b.file WHERE x.path <> y.path AND x.layer = 'core' AND y.layer = 'ui')
 UNION ALL SELECT 1, 'cycle', NULL, NULL, array_to_string(list_sort(list(node)), ','), NULL FROM cycle GROUP BY cycle
 UNION ALL SELECT 2, 'instability', module, NULL, NULL, round(instability, 9) FROM coupling WHERE instability > 0.5""", CLOSURE, CYCLE),
    "api_diff": sql("SELECT name, kind, change, base_signature, head_signature FROM api"),
    "semver": sql("SELECT CASE max(CASE change WHEN 'added' THEN 2 ELSE 3 END) WHEN 3 THEN 'major' WHEN 2 THEN 'minor' ELSE 'none' END AS verdict FROM api"),
    "merge_history": sql("SELECT path, commits, authors, last_changed FROM churn"),
    "doc_kinds": """SELECT page_id, CASE WHEN contains(p, 'node_modules/') OR ends_with(p, '.min.js') THEN 'Vendored' WHEN starts_with(p, 'target/') OR contains(p, '/target/') OR ends_with(p, '.pb.rs') THEN 'Generated'
 WHEN contains(p, '/fixtures/') OR starts_with(p, 'fixtures/') THEN 'Fixture' WHEN contains(p, '/tests/') OR starts_with(p, 'tests/') OR contains(p, '/benches/') OR starts_with(p, 'benches/') OR contains(p, '_test.') OR ends_with(p, '/tests.rs') THEN 'Test'
 WHEN contains(p, '.claude/') OR regexp_matches(lower(p), '[^/]\\.(toml|lock|json|yaml|yml)$') THEN 'Config' ELSE 'Source' END AS doc_kind FROM (SELECT page_id, url AS p FROM pages)""",
    "live_files": """SELECT path, kind FROM (SELECT CAST(user_id AS VARCHAR) AS path, arg_max(kind, struct_pack(t := ts, r := kind = 'Removed')) AS kind FROM
 (SELECT *, CASE WHEN event_type = 'purchase' THEN 'Removed' ELSE 'Modified' END AS kind FROM events) GROUP BY 1) WHERE kind <> 'Removed'""",
    "outline_lines": r"""SELECT path, CAST(CASE WHEN filled > 8 THEN 0 ELSE n END AS INT) AS kept_lines, CAST(CASE WHEN filled > 8 THEN n ELSE 0 END AS INT) AS elided_lines FROM
 (SELECT CAST(doc_id AS VARCHAR) AS path, len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END AS n, len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS filled
 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))""",
    "reconcile": r"""SELECT 'HashDrift' AS kind, path, CASE WHEN layer = 'ui' THEN 'ui' END AS old_hash, CASE WHEN layer = 'ui' THEN 'new' ELSE layer END AS new_hash FROM
 (SELECT DISTINCT p_brand AS path, CASE CAST(regexp_extract(p_brand, '(\d+)$', 1) AS INT) % 3 WHEN 0 THEN 'ui' WHEN 1 THEN 'core' ELSE 'data' END AS layer FROM part) WHERE layer <> 'core'""",
    "fresh_spans": r"""SELECT p_partkey AS symbol_id, p_brand AS path, CAST(p_size AS INT) AS first_line, CAST(p_size + 3 AS INT) AS last_line FROM part WHERE CAST(regexp_extract(p_brand, '(\d+)$', 1) AS INT) % 3 = 1""",
    "under": sql("""SELECT path, score FROM (SELECT path, round((CAST(commits AS DOUBLE) / max(commits) OVER ()) * (CAST(coalesce(complexity, 0) AS DOUBLE) / nullif(max(coalesce(complexity, 0)) OVER (), 0)), 9) AS score
 FROM churn LEFT JOIN file_complexity USING (path)) WHERE starts_with(path, 'Brand#1')"""),
    "weak_spots": sql("""SELECT 'cycle' AS part, node AS symbol_id, cycle, CAST(NULL AS VARCHAR) AS module, CAST(NULL AS BIGINT) AS ce FROM cycle
 UNION ALL SELECT 'module', NULL, NULL, module, CAST(ce AS BIGINT) FROM coupling WHERE ce > 15 AND starts_with(module, 'Brand#1')
 UNION ALL SELECT 'dead', symbol_id, NULL, NULL, NULL FROM symbols WHERE symbol_id NOT IN (SELECT dst FROM edges) AND symbol_id NOT IN (SELECT symbol_id FROM marked WHERE root)""", CLOSURE, CYCLE),
    "symbol_ids": sql("SELECT symbol_id, file, kind, name, bs AS byte_start FROM declared"),
    "scoped_edges": sql("SELECT src, dst, 'References' AS kind, file, byte_start FROM (SELECT src, dst, path AS file, bs AS byte_start, row_number() OVER (PARTITION BY src, dst ORDER BY path, bs) AS k FROM resolved WHERE dst IS NOT NULL AND dst <> src) WHERE k = 1"),
    "occurrence_edges": sql("""SELECT DISTINCT src, dst, CASE roles WHEN 2 THEN 'Imports' WHEN 4 THEN 'Writes' WHEN 8 THEN 'Reads' ELSE 'References' END AS kind FROM placed JOIN defs USING (sym) WHERE roles <> 1 AND src <> dst
 UNION SELECT a.dst, b.dst, k FROM (SELECT 'k' || n_nationkey AS f, 'k' || n_regionkey AS t, unnest(list_filter([CASE WHEN n_nationkey % 2 = 0 THEN 'Implements' END, CASE WHEN n_nationkey % 3 = 0 THEN 'TypeOf' END], lambda x: x IS NOT NULL)) AS k FROM nation)
 JOIN defs a ON a.sym = f JOIN defs b ON b.sym = t WHERE a.dst <> b.dst"""),
    "innermost": sql("SELECT site_id, decl_id FROM (SELECT site_id, decl_id, row_number() OVER (PARTITION BY site_id ORDER BY def_be - def_bs, def_bs, decl_id) AS k FROM marks m JOIN wide w ON w.path = m.path AND def_bs <= bs AND def_be >= be) WHERE k = 1"),
    "container_or_largest": sql("""SELECT site_id, decl_id FROM (SELECT site_id, decl_id, row_number() OVER (PARTITION BY site_id ORDER BY o DESC, CASE WHEN o THEN def_be - def_bs ELSE def_bs - def_be END, def_bs, decl_id) AS k FROM
 (SELECT *, def_bs <= bs AND def_be >= be AS o, bs <= def_bs AND be >= def_be AS i FROM (SELECT site_id, m.path, bs, be + 60 AS be FROM marks m) x JOIN wide w ON w.path = x.path) WHERE o OR i) WHERE k = 1"""),
    "next_start": sql("SELECT site_id, decl_id FROM (SELECT site_id, decl_id, row_number() OVER (PARTITION BY site_id ORDER BY def_bs, decl_id) AS k FROM marks m JOIN wide w ON w.path = m.path AND def_bs >= be) WHERE k = 1"),
    "crate_paths": sql("SELECT symbol_id, crate, layer, kind || ' in the ' || coalesce(crate || ' ', '') || lower(layer) || ' layer' AS role FROM crates"),
    "boundary_violations": sql("""SELECT DISTINCT src, dst, CASE WHEN a.layer = 'Domain' AND b.layer = 'Adapter' THEN 'domain to adapter' WHEN a.crate = 'c1' AND b.crate <> 'c1' THEN 'core to other crate' ELSE 'adapter to adapter of another crate' END AS reason
 FROM edges JOIN crates a ON a.symbol_id = src JOIN crates b ON b.symbol_id = dst WHERE a.layer = 'Domain' AND b.layer = 'Adapter' OR a.crate = 'c1' AND b.crate <> 'c1' OR a.layer = 'Adapter' AND b.layer = 'Adapter' AND a.crate <> b.crate"""),
    "crate_edges": sql("SELECT DISTINCT a.crate AS from_crate, b.crate AS to_crate FROM edges JOIN crates a ON a.symbol_id = src JOIN crates b ON b.symbol_id = dst WHERE a.crate <> b.crate"),
    "dominant_layer": sql("SELECT crate, arg_max(layer, struct_pack(n := n, o := CASE layer WHEN 'Domain' THEN 0 WHEN 'Adapter' THEN -1 ELSE -2 END)) AS layer FROM (SELECT crate, layer, count(DISTINCT file) AS n FROM crates WHERE crate IS NOT NULL GROUP BY 1, 2) GROUP BY crate"),
    "synopsis": sql("SELECT count(DISTINCT crate) AS crates, count(DISTINCT layer) AS layers, count(DISTINCT symbol_id) AS symbols, (SELECT count(*) FROM edges) AS edges, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM crates"),
    "architecture": sql("""SELECT m.crate, d.layer, ca, ce, round(CASE WHEN ca + ce = 0 THEN 0.0 ELSE CAST(ce AS DOUBLE) / (ca + ce) END, 9) AS instability FROM
 (SELECT c.crate, (SELECT count(DISTINCT src) FROM edges JOIN crates x ON x.symbol_id = src JOIN crates y ON y.symbol_id = dst WHERE y.crate = c.crate AND x.crate IS DISTINCT FROM c.crate) AS ca,
 (SELECT count(DISTINCT dst) FROM edges JOIN crates x ON x.symbol_id = src JOIN crates y ON y.symbol_id = dst WHERE x.crate = c.crate AND y.crate IS DISTINCT FROM c.crate) AS ce FROM (SELECT DISTINCT crate FROM crates WHERE crate IS NOT NULL) c) m
 JOIN (SELECT crate, arg_max(layer, struct_pack(n := n, o := CASE layer WHEN 'Domain' THEN 0 WHEN 'Adapter' THEN -1 ELSE -2 END)) AS layer FROM (SELECT crate, layer, count(DISTINCT file) AS n FROM crates WHERE crate IS NOT NULL GROUP BY 1, 2) GROUP BY crate) d ON d.crate = m.crate"""),
    "layering": sql("""SELECT node, max(d) AS layer FROM level JOIN named ON named.c = level.c GROUP BY node""", CLOSURE, CYCLE,
        "named AS (SELECT symbol_id AS node, coalesce(cycle, symbol_id) AS c FROM symbols LEFT JOIN cycle ON node = symbol_id)",
        "up AS (SELECT DISTINCT x.c AS a, y.c AS b FROM edges JOIN named x ON x.node = src JOIN named y ON y.node = dst WHERE x.c <> y.c)",
        "level AS (SELECT DISTINCT c, 0 AS d FROM named UNION SELECT up.a, d + 1 FROM level JOIN up ON up.b = level.c)"),
    "page": sql("SELECT symbol_id, complexity, CAST(place AS INT) AS place FROM (SELECT symbol_id, complexity, row_number() OVER (ORDER BY complexity DESC, symbol_id) AS place FROM symbols) WHERE place > 20 AND place <= 30"),
    "stale_keys": sql("SELECT symbol_id FROM symbols WHERE complexity % 3 <> 0"),
    "merge_pairs": sql("SELECT a, b, count FROM co"),
}

#: SQL that is too slow on whole tables beyond the smallest (every changed symbol's reach without each other one): tests alone run it.
SLOW = {name: SQL.pop(name) for name in ("diff_blast", "affected_tests")}
