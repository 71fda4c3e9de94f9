"""Graph operators over edges (src, dst, kind): src depends on dst.

Bounded traversals are joins. Traversals to a fixpoint, dominators and strong components run in one task where the
edges are counted and found to be few (LOCAL), and as rounds of joins over written tables beyond that."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.lineage import cut

#: Edges up to which one task holds a whole graph (two ids of 8 bytes an edge, and the adjacency built of them).
LOCAL = 2_000_000
#: Kinds as stored and as the graph sees them; all others are Calls.
GRAPH_KINDS = {"Defines": "Defines", "Imports": "Imports", "Reads": "Reads", "Writes": "Writes", "Implements": "Overrides", "TypeOf": "TypeOf"}
#: Order of the stored kinds.
KIND_TAGS = ["Defines", "References", "Imports", "Reads", "Writes", "Implements", "TypeOf", "Renders", "UsesHook"]


def graph_kind(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for stored, seen in GRAPH_KINDS.items():
        out = out.when(kind == stored, seen)
    return out.otherwise("Calls")


def graph_edges(stored: DataFrame) -> DataFrame:
    """Stored edges as the graph has them: kinds collapsed, one edge for each (src, dst, kind)."""
    return stored.select("src", "dst", graph_kind(F.col("kind")).alias("kind")).dropDuplicates(["src", "dst", "kind"])


def of_kinds(edges: DataFrame, kinds: Iterable[str] | None) -> DataFrame:
    """Edges of the kinds, all for None. The name Inherits stands for Overrides."""
    if kinds is None:
        return edges
    return edges.filter(F.col("kind").isin(["Overrides" if k == "Inherits" else k for k in kinds]))


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "symbol_id") -> DataFrame:
    """nodes with fan_in and fan_out (0 without edges)."""
    into = edges.groupBy(F.col("dst").alias(node)).agg(F.count("*").alias("fan_in"))
    out = edges.groupBy(F.col("src").alias(node)).agg(F.count("*").alias("fan_out"))
    return nodes.join(into, node, "left").join(out, node, "left").fillna(0, ["fan_in", "fan_out"])


def callers(edges: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """(seed, node, hop): all that reach a seed along edges, with the fewest hops; the seed itself is left out.

    With a depth, one join a hop; without, until nothing is new, each round written."""
    steps = edges.select("src", "dst")  # each hop's rows are made distinct
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    front, hop = seen, 0
    while depth is None or hop < depth:
        hop += 1
        new = front.join(steps, front["node"] == steps["dst"]).select("seed", F.col("src").alias("node")).distinct()
        new = new.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        if depth is None or hop % 4 == 0:
            new = cut(new)
            if new.isEmpty():
                break
        front, seen = new, seen.unionAll(new)
    return seen.filter("hop > 0")


def _back(src, dst) -> dict:
    """Callers of each node."""
    back: dict = {}
    for a, b in zip(src.tolist(), dst.tolist()):
        back.setdefault(b, []).append(a)
    return back


def _local_dominators(start, back: dict) -> tuple[list, list]:
    """Nodes that reach start over any kinds, and their depth in the dominator tree of the callers' graph rooted at start
    (iterating over reverse postorder until nothing changes)."""
    order, state = [], [(start, iter(back.get(start, ())))]
    seen = {start}
    while state:
        node, rest = state[-1]
        for nxt in rest:
            if nxt not in seen:
                seen.add(nxt)
                state.append((nxt, iter(back.get(nxt, ()))))
                break
        else:
            order.append(node)
            state.pop()
    order.reverse()
    rank = {n: k for k, n in enumerate(order)}
    into: list[list[int]] = [[] for _ in order]
    for n in order:
        for c in back.get(n, ()):
            into[rank[c]].append(rank[n])
    idom = [-1] * len(order)
    idom[0] = 0
    changed = True
    while changed:
        changed = False
        for k in range(1, len(order)):
            new = -1
            for p in into[k]:
                if idom[p] < 0:
                    continue
                if new < 0:
                    new = p
                    continue
                a, b = p, new
                while a != b:
                    while a > b:
                        a = idom[a]
                    while b > a:
                        b = idom[b]
                new = a
            if idom[k] != new:
                idom[k], changed = new, True
    depth = [0] * len(order)
    for k in range(1, len(order)):
        depth[k] = depth[idom[k]] + 1
    return order[1:], depth[1:]


def _spread(region: DataFrame, steps: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, a, b): the least and greatest root whose callers, without passing another root, include node."""
    inner = region.join(roots.select(F.col("root").alias("node")), "node", "left_anti")
    label = roots.select(F.col("root").alias("node"), F.col("root").alias("a"), F.col("root").alias("b"))
    links = cut(steps.join(inner.select(F.col("node").alias("src")), "src", "left_semi"))
    while True:
        came = label.join(links, label["node"] == links["dst"]).groupBy(F.col("src").alias("node")).agg(F.min("a").alias("a"), F.max("b").alias("b"))
        new = label.unionAll(came).groupBy("node").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        new = cut(new)
        if new.exceptAll(label).isEmpty():
            return new
        label = new


def _dominated(region: DataFrame, steps: DataFrame, start: DataFrame) -> DataFrame:
    """(node, top): the child of start in the dominator tree that dominates node, node itself where start is its immediate
    dominator. Roots begin as start's callers; a node that two roots reach and that has a caller-side neighbour reached
    by one root alone has two disjoint ways to start, and becomes a root, until each node is reached by one root."""
    first = steps.join(start.select(F.col("seed").alias("dst")), "dst", "left_semi").select(F.col("src").alias("root")).distinct()
    roots = cut(first.join(start, first["root"] == start["seed"], "left_anti"))
    links = steps.join(start.select(F.col("seed").alias("src")), "src", "left_anti")
    while True:
        label = _spread(region, links, roots)
        two = label.filter("a <> b")
        if two.isEmpty():
            return label.select("node", F.col("a").alias("top"))
        one = label.filter("a = b").select(F.col("node").alias("dst"))
        more = links.join(one, "dst", "left_semi").select(F.col("src").alias("node")).join(two, "node", "left_semi").select(F.col("node").alias("root")).distinct()
        roots = cut(roots.unionAll(more).distinct())


def dominators(edges: DataFrame, seeds: DataFrame, local: int = LOCAL) -> DataFrame:
    """(seed, node, depth): for all that reach a seed over any kinds, the depth in the dominator tree of the callers' graph
    rooted at the seed. Depth 1: the seed itself is the immediate dominator."""
    steps = edges.select("src", "dst").distinct()
    if steps.count() <= local:
        spark = edges.sparkSession
        table = steps.toPandas()  # counted just now
        shared = spark.sparkContext.broadcast((table["src"].to_numpy(), table["dst"].to_numpy()))

        def run(batches):
            back = None
            for pdf in batches:
                back = back or _back(*shared.value)
                for seed in pdf["seed"]:
                    nodes, depth = _local_dominators(seed, back)
                    yield pd.DataFrame({"seed": seed, "node": nodes, "depth": depth}, dtype="int64")

        dealt = seeds.select("seed").distinct().repartition(spark.sparkContext.defaultParallelism)
        return dealt.mapInPandas(run, "seed long, node long, depth long")
    out = None
    for row in seeds.select("seed").distinct().toLocalIterator():
        start = edges.sparkSession.createDataFrame([(row["seed"],)], "seed long")
        found = _dominator_depths(steps, start)
        part = found.select(F.lit(row["seed"]).alias("seed"), "node", "depth")
        out = part if out is None else out.unionAll(part)
    return out


def _dominator_depths(steps: DataFrame, start: DataFrame) -> DataFrame:
    """Peels the tree: children of each root, then, all regions at once, children of those."""
    region = cut(callers(steps, start, None).select("node"))
    depth, out = 1, None
    now = start.select(F.col("seed").alias("top"))
    inside = region.withColumn("top", F.lit(start.first()["seed"]))
    while True:
        # only edges inside one region count; its root is the only way in
        member = inside.unionAll(now.select(F.col("top").alias("node"), "top"))
        own = steps.join(member.select(F.col("node").alias("src"), F.col("top").alias("_s")), "src").join(member.select(F.col("node").alias("dst"), F.col("top").alias("_d")), "dst").filter("_s = _d").select("src", "dst")
        label = cut(_dominated(inside.select("node"), cut(own), now.select(F.col("top").alias("seed"))))
        tops = label.filter("node = top").select("node", F.lit(depth).cast("long").alias("depth"))
        out = tops if out is None else out.unionAll(tops)
        inside = label.filter("node <> top")
        if inside.isEmpty():
            return out
        now, depth = tops.select(F.col("node").alias("top")), depth + 1


class _Callers:
    """The callers' graph in arrays; edges lie by the node they lead to."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        self.names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        to, start = at[: len(src)], at[len(src) :]
        order = np.argsort(to, kind="stable")
        self.to, self.start = to[order], start[order]
        self.cut = np.flatnonzero(np.diff(self.to, prepend=-1))
        self.heads = self.to[self.cut]

    def musts(self, seed: int) -> np.ndarray:
        """Nodes whose immediate dominator is the seed. Roots begin as the seed's callers; each node takes the least and the
        greatest root that lead to it, and one between two roots, next to a node of a single one, is a root as well."""
        s = int(np.searchsorted(self.names, seed))
        if s == len(self.names) or self.names[s] != seed:
            return self.names[:0]
        n = len(self.names)
        root = np.zeros(n, bool)
        root[self.to[self.start == s]] = True
        root[s] = False
        inner = self.start != s
        while True:
            low, high = np.where(root, np.arange(n), n), np.where(root, np.arange(n), -1)
            while True:
                a = np.minimum.reduceat(np.where(inner, low[self.start], n), self.cut)
                b = np.maximum.reduceat(np.where(inner, high[self.start], -1), self.cut)
                free = ~root[self.heads] & (self.heads != s)
                a, b = np.where(free, np.minimum(a, low[self.heads]), low[self.heads]), np.where(free, np.maximum(b, high[self.heads]), high[self.heads])
                if (a == low[self.heads]).all() and (b == high[self.heads]).all():
                    break
                low[self.heads], high[self.heads] = a, b
            two, one = (low < high) & (high >= 0), low == high
            more = self.to[inner & two[self.to] & one[self.start]]
            if not two.any():
                return self.names[root]
            root[more] = True


def _tree(steps: DataFrame, start: DataFrame) -> DataFrame:
    """(seed, node, top): all that reach a seed, each with the direct caller of the seed that it is led to by a tree of fewest hops."""
    seen = front = cut(steps.join(start, steps["dst"] == start["seed"]).select("seed", F.col("src").alias("node"), F.col("src").alias("top")))
    rounds = 0
    while not front.isEmpty():
        new = front.join(steps, front["node"] == steps["dst"]).filter("src <> seed").groupBy("seed", F.col("src").alias("node")).agg(F.min("top").alias("top"))
        front = cut(new.join(seen, ["seed", "node"], "left_anti"))
        seen, rounds = seen.unionAll(front), rounds + 1
        if rounds % 8 == 0:
            seen = cut(seen)
    return cut(seen)


def _settled(links: DataFrame, must: DataFrame) -> DataFrame:
    """(seed, node): the musts among the sources of links (seed, src, dst). Each takes the least and the greatest must that it
    leads to by links; one between two, next to a node of a single one, is a must as well."""
    roots, out = cut(must.join(links.select("seed", F.col("dst").alias("node")), ["seed", "node"], "left_semi")), None
    while True:
        inner = cut(links.join(roots.withColumnRenamed("node", "src"), ["seed", "src"], "left_anti"))
        label = roots.select("seed", "node", F.col("node").alias("a"), F.col("node").alias("b"))
        while True:
            came = label.withColumnRenamed("node", "dst").join(inner, ["seed", "dst"]).select("seed", F.col("src").alias("node"), "a", "b")
            new = cut(label.unionAll(came).groupBy("seed", "node").agg(F.min("a").alias("a"), F.max("b").alias("b")))
            if new.exceptAll(label).isEmpty():
                break
            label = new
        two = label.filter("a <> b").select("seed", F.col("node").alias("src"))
        next_one = label.filter("a = b").select("seed", F.col("node").alias("dst"))
        more = cut(inner.join(next_one, ["seed", "dst"], "left_semi").join(two, ["seed", "src"], "left_semi").select("seed", F.col("src").alias("node")).distinct())
        if more.isEmpty():
            return roots.limit(0) if out is None else out
        roots, out = cut(roots.unionAll(more)), more if out is None else out.unionAll(more)


def _musts_by_rounds(steps: DataFrame, seeds: DataFrame, local: int) -> DataFrame:
    """musts for all seeds at once. Direct callers are some, and so is a node next to one of another branch of the tree: the two
    ways to the seed share nothing. The others are decided by the edges of those nodes alone, where a must stands for its ways
    to the seed: one task a seed takes them, or rounds beyond `local` of them."""
    tree = _tree(steps, seeds.select("seed").distinct())
    away = tree.select("seed", F.col("node").alias("dst"), F.col("top").alias("_t"))
    across = tree.join(steps, tree["node"] == steps["src"]).select("seed", "node", "top", "dst").join(away, ["seed", "dst"])
    must = cut(across.filter("_t <> top").select("seed", "node").unionAll(tree.filter("node = top").select("seed", "node")).distinct())
    seen = cut(tree.select("seed", "node").join(must, ["seed", "node"], "left_anti"))
    if seen.isEmpty():
        return must
    links = seen.join(steps, seen["node"] == steps["src"]).select("seed", "src", "dst")
    known = must.select("seed", F.col("node").alias("dst"), F.lit(True).alias("sure")).unionAll(seen.select("seed", F.col("node").alias("dst"), F.lit(False)))
    links = cut(links.join(known, ["seed", "dst"]).select("seed", "src", "dst", "sure"))
    most = links.groupBy("seed").count().agg(F.max("count")).first()[0]
    if most > local:
        return must.unionAll(_settled(links.drop("sure"), must))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, ends = pdf["seed"].iloc[0], np.unique(pdf["dst"].to_numpy()[pdf["sure"].to_numpy()])
        src, dst = np.concatenate([pdf["src"].to_numpy(), ends]), np.concatenate([pdf["dst"].to_numpy(), np.full(len(ends), seed)])
        found = np.setdiff1d(_Callers(src, dst).musts(seed), ends)
        return pd.DataFrame({"seed": seed, "node": found}, dtype="int64")

    return must.unionAll(links.groupBy("seed").applyInPandas(run, "seed long, node long"))


def musts(edges: DataFrame, seeds: DataFrame, local: int = LOCAL) -> DataFrame:
    """(seed, node): nodes that reach a seed over any kinds and that no single other node stands before."""
    return musts_by_steps(cut(edges.select("src", "dst").filter("src <> dst").distinct()), seeds, local)


def musts_by_steps(steps: DataFrame, seeds: DataFrame, local: int = LOCAL) -> DataFrame:
    """musts over a written table of distinct steps (src, dst) without loops."""
    if steps.count() > local:
        return _musts_by_rounds(steps, seeds, local)
    spark = steps.sparkSession
    table = steps.toPandas()  # counted just now
    shared = spark.sparkContext.broadcast((table["src"].to_numpy(), table["dst"].to_numpy()))

    def run(batches):
        graph = None
        for pdf in batches:
            for seed in pdf["seed"] if len(shared.value[0]) else ():
                graph = graph or _Callers(*shared.value)
                yield pd.DataFrame({"seed": seed, "node": graph.musts(seed)}, dtype="int64")

    dealt = seeds.select("seed").distinct().repartition(spark.sparkContext.defaultParallelism)
    return dealt.mapInPandas(run, "seed long, node long")


def blast_radius(edges: DataFrame, seeds: DataFrame, kinds: Iterable[str] | None = None, depth: int = 3, local: int = LOCAL) -> DataFrame:
    """(seed, node, hop, must): all within depth hops of a seed along edges of the kinds. must: over all kinds and any
    depth, only the seed itself dominates the node in the callers' graph."""
    near = callers(of_kinds(edges, kinds), seeds, max(1, depth))
    first = musts(edges, seeds, local).withColumn("_must", F.lit(True))
    return near.join(first, ["seed", "node"], "left").select("seed", "node", "hop", F.coalesce("_must", F.lit(False)).alias("must"))


def plan_assist(edges: DataFrame, symbols: DataFrame, seed: int, max_files: int = 16, local: int = LOCAL) -> DataFrame:
    """(file, certainty, reasons, place): files with callers of the seed over Calls, Imports, TypeOf and Inherits, to any
    depth; certainty sums 1 / dominator depth of the members reached."""
    start = edges.sparkSession.createDataFrame([(seed,)], "seed long")
    some = of_kinds(edges, ["Calls", "Imports", "TypeOf", "Inherits"])
    reached = dominators(some, start, local).select("node")
    tree = dominators(edges, start, local).select("node", "depth")
    both = reached.join(tree, "node").join(symbols.select(F.col("symbol_id").alias("node"), "file"), "node")
    by = both.groupBy("file").agg(F.sum(1 / F.col("depth")).alias("certainty"), F.array_sort(F.collect_set("node")).alias("reasons"))
    top = by.orderBy(F.round("certainty", 9).desc(), "file").limit(max_files)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.round("certainty", 9).desc(), "file")))


def _local_components(src, dst) -> tuple[list, list]:
    """Strong components of two or more nodes: (node, least member)."""
    out: dict = {}
    for a, b in zip(src, dst):
        out.setdefault(a, []).append(b)
    index: dict = {}
    low: dict = {}
    on, stack, nodes, labels = set(), [], [], []
    for first in out:
        if first in index:
            continue
        index[first] = low[first] = len(index)
        stack.append(first)
        on.add(first)
        work = [(first, iter(out.get(first, ())))]
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out.get(nxt, ()))))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    at = place(stack, node)
                    members = stack[at:]
                    del stack[at:]
                    on.difference_update(members)
                    if len(members) > 1:
                        nodes += members
                        labels += [min(members)] * len(members)
    return nodes, labels


def place(stack: list, node) -> int:
    """Place of node on the stack, searched from its end."""
    at = len(stack) - 1
    while stack[at] != node:
        at -= 1
    return at


def cycles(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, cycle): members of strong components of two or more nodes over all kinds; cycle is the least member.

    Beyond `local` edges: ends without a way in or out are trimmed, then the greatest id spreads forwards as a colour
    and a way back within its colour settles one component a colour a round."""
    steps = edges.filter("src <> dst").select("src", "dst").distinct()
    if steps.count() <= local:

        def run(batches):
            src, dst = [], []
            for pdf in batches:
                src += pdf["src"].tolist()
                dst += pdf["dst"].tolist()
            nodes, labels = _local_components(src, dst)
            yield pd.DataFrame({"node": nodes, "cycle": labels}, dtype="int64")

        return steps.coalesce(1).mapInPandas(run, "node long, cycle long")
    spark, done = edges.sparkSession, None
    left = cut(steps)
    while True:
        while True:  # trim
            keep = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            keep = keep.join(keep.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            keep, before = cut(keep), left.count()
            left = keep
            if left.count() == before:
                break
        if left.isEmpty():
            break
        colour = cut(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("c", F.col("node")))
        while True:
            came = left.join(colour, left["src"] == colour["node"]).select(F.col("dst").alias("node"), "c")
            new = cut(colour.unionAll(came).groupBy("node").agg(F.max("c").alias("c")))
            if new.exceptAll(colour).isEmpty():
                break
            colour = new
        same = cut(left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        found = cut(colour.filter("node = c").select("node", "c"))
        front = found
        while True:
            new = same.join(front.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "c").distinct().join(found, ["node", "c"], "left_anti")
            front = cut(new)
            if front.isEmpty():
                break
            found = found.unionAll(front)
        part = cut(found)
        done = part if done is None else done.unionAll(part)
        gone = part.select("node")
        left = cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        if left.isEmpty():
            break
    if done is None:
        return spark.createDataFrame([], "node long, cycle long")
    name = done.groupBy("c").agg(F.min("node").alias("cycle"), F.count("*").alias("n")).filter("n > 1")
    return done.join(name, "c").select("node", "cycle")


def inside_cycles(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges both of whose ends are in one cycle, with the cycle."""
    a = found.select(F.col("node").alias("src"), F.col("cycle").alias("_a"))
    b = found.select(F.col("node").alias("dst"), "cycle")
    return edges.join(a, "src").join(b, "dst").filter("_a = cycle").select("src", "dst", "kind", "cycle")


def cycle_breaks(edges: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(src, dst, kind, cycle, score): every edge inside a cycle; 1 / max(fan-in of src, fan-out of dst, 1)."""
    deg = degrees(nodes.select("symbol_id"), edges)
    inner = inside_cycles(edges, found)
    inner = inner.join(deg.select(F.col("symbol_id").alias("src"), "fan_in"), "src").join(deg.select(F.col("symbol_id").alias("dst"), "fan_out"), "dst")
    return inner.select("src", "dst", "kind", "cycle", (1 / F.greatest("fan_in", "fan_out", F.lit(1))).alias("score"))


def suggested_cuts(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(cycle, src, dst): the least edge inside each cycle."""
    least = inside_cycles(edges, found).groupBy("cycle").agg(F.min(F.struct("src", "dst")).alias("e"))
    return least.select("cycle", "e.src", "e.dst")


def cycle_clusters(found: DataFrame, scope: DataFrame, members: int = 6) -> DataFrame:
    """(cycle, size, representatives): cycles all of whose members are in scope (symbol_id)."""
    marked = found.join(scope.select(F.col("symbol_id").alias("node"), F.lit(True).alias("_in")), "node", "left")
    by = marked.groupBy("cycle").agg(F.count("*").alias("size"), F.bool_and(F.coalesce("_in", F.lit(False))).alias("_all"), F.slice(F.array_sort(F.collect_list("node")), 1, members).alias("representatives"))
    return by.filter("_all").drop("_all")


def dead_code(nodes: DataFrame, edges: DataFrame, exempt: DataFrame) -> DataFrame:
    """Nodes without an incoming edge of any kind (its own counts) and not exempt (symbol_id)."""
    return nodes.join(edges.select(F.col("dst").alias("symbol_id")), "symbol_id", "left_anti").join(exempt.select("symbol_id"), "symbol_id", "left_anti")


def layers(edges: DataFrame, nodes: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, layer): longest path of components below a node; members of a cycle share a layer. Nothing depended on: 0."""
    found = cycles(edges, local)
    name = nodes.select(F.col("symbol_id").alias("node")).join(found, "node", "left").select("node", F.coalesce("cycle", "node").alias("c"))
    name = cut(name)
    up = edges.join(name.select(F.col("node").alias("src"), F.col("c").alias("a")), "src").join(name.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst").filter("a <> b").select("a", "b").distinct()
    up = cut(up)
    level = cut(name.select("c").distinct().withColumn("layer", F.lit(0)))
    while True:
        more = up.join(level, up["b"] == level["c"]).groupBy(F.col("a").alias("c")).agg((F.max("layer") + 1).alias("layer"))
        new = cut(level.unionAll(more).groupBy("c").agg(F.max("layer").alias("layer")))
        if new.exceptAll(level).isEmpty():
            break
        level = new
    return name.join(level, "c").select("node", "layer")
