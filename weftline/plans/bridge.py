"""The driver's star schema read as a code graph with history; each table here has a DuckDB twin in oracles.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Bridge:
    """Model tables over a folder of the driver's Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def symbols(self) -> DataFrame:
        """symbol_id, name, kind, file, byte_start, byte_end, visibility, attributes, lang, complexity."""
        langs = ["rust", "go", "python", "java", "csharp", "cpp", "typescript", "c"]
        p = self.raw("part")
        key = F.col("p_partkey")
        return p.select(
            key.alias("symbol_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("kind"),
            F.col("p_brand").alias("file"),
            (10 * F.col("p_size")).cast("long").alias("byte_start"),
            (10 * F.col("p_size") + 40).cast("long").alias("byte_end"),
            F.when(key % 7 == 0, "Public").when(key % 7 == 1, "Restricted").otherwise("Private").alias("visibility"),
            F.when(key % 11 == 0, F.array(F.lit("tokio::test"))).when(key % 11 == 1, F.array(F.lit("Test"), F.lit("app.route"))).otherwise(F.array().cast("array<string>")).alias("attributes"),
            F.element_at(F.array(*map(F.lit, langs)), (key % 8).cast("int") + 1).alias("lang"),
            F.col("p_size").cast("long").alias("complexity"),
        )

    @property
    def stored_edges(self) -> DataFrame:
        """src, dst, kind (stored), file (evidence: the source's), byte_start."""
        l = self.raw("lineitem")
        by = l.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("n"), F.min("l_returnflag").alias("flag"))
        w = Window.partitionBy("l_orderkey").orderBy("n", "l_partkey")
        kind = F.when(F.col("flag") == "A", "References").when(F.col("flag") == "N", "Imports").otherwise("TypeOf")
        hop = by.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), kind.alias("kind"), F.col("n"))
        found = hop.filter("dst is not null and src <> dst").groupBy("src", "dst", "kind").agg(F.min("n").alias("n"))
        at = self.raw("part").select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("file"))
        return found.join(at, "src").select("src", "dst", "kind", "file", (F.col("n") * 10).cast("long").alias("byte_start"))

    @property
    def edges(self) -> DataFrame:
        from weftline.operators.graph import graph_edges

        return graph_edges(self.stored_edges)

    @property
    def modules(self) -> DataFrame:
        return self.symbols.select(F.col("file").alias("module"), "symbol_id", (F.col("symbol_id") % 5 == 0).alias("is_abstract"))

    @property
    def commit_files(self) -> DataFrame:
        """commit_id, author, ts, path: one row a commit and file."""
        o = self.raw("orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))
        l = self.raw("lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("p_partkey"))
        p = self.raw("part").select("p_partkey", F.col("p_brand").alias("path"))
        # the pair of commit and file is made distinct before the orders' columns come in
        return l.join(p, "p_partkey").select("commit_id", "path").distinct().join(o, "commit_id")

    @property
    def hunks(self) -> DataFrame:
        l = self.raw("lineitem").select(F.col("l_orderkey").alias("commit_id"), "l_partkey", (7 * F.col("l_linenumber")).cast("int").alias("start_line"), F.col("l_quantity").cast("int").alias("_n"))
        p = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("path"))
        return l.join(p, "l_partkey").select("commit_id", "path", "start_line", (F.col("start_line") + F.col("_n")).alias("end_line"))

    @property
    def ranges(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("path"), F.col("p_size").cast("int").alias("first_line"), (F.col("p_size") + 3).cast("int").alias("last_line"))

    @property
    def files(self) -> DataFrame:
        """path, layer: the brand's number gives the layer."""
        n = F.regexp_extract("path", r"(\d+)$", 1).cast("int")
        return self.raw("part").select(F.col("p_brand").alias("path")).distinct().withColumn("layer", F.when(n % 3 == 0, "ui").when(n % 3 == 1, "core").otherwise("data"))

    def surface(self, year: int) -> DataFrame:
        """name, kind, signature, pos: line items shipped in the year as public symbols."""
        l = self.raw("lineitem").filter(F.year("l_shipdate") == year)
        by = l.groupBy(F.col("l_partkey").cast("string").alias("name"), F.col("l_returnflag").alias("kind")).agg(F.max("l_quantity").cast("int").cast("string").alias("signature"))
        return by.withColumn("pos", F.lit(0))

    @property
    def crate_symbols(self) -> DataFrame:
        """The symbols with paths as of a workspace of crates: the brand's number gives crate and layer."""
        n = F.regexp_extract("file", r"(\d+)$", 1).cast("int")
        part = F.when(n % 3 == 0, "src/domain").when(n % 3 == 1, "src/adapters").otherwise("src")
        root = F.when(n % 7 == 0, F.lit("tools/")).otherwise(F.concat(F.lit("crates/c"), (n % 4).cast("string"), F.lit("/")))
        return self.symbols.withColumn("file", F.concat(root, part, F.lit("/"), "file", F.lit(".rs")))

    @property
    def decls(self) -> DataFrame:
        """One declaration a part, each in its own hundred bytes of the brand's file."""
        p = self.raw("part")
        return p.select(
            F.col("p_brand").alias("path"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), (100 * F.col("p_partkey")).alias("def_bs"), (100 * F.col("p_partkey") + 90).alias("def_be"),
            F.lit("Private").alias("visibility"), F.array().cast("array<string>").alias("attributes"), F.col("p_size").cast("long").alias("complexity"),
        )

    @property
    def sites(self) -> DataFrame:
        """path, bs, be, callee, shape, sym, roles: line items as places in the part's declaration that name another part."""
        l = self.raw("lineitem")
        a = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("path"))
        b = self.raw("part").select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("callee"))
        bs = 100 * F.col("l_partkey") + F.col("l_linenumber")
        shape = F.when(F.col("l_returnflag") == "A", "free").when(F.col("l_returnflag") == "N", "method").otherwise("path")
        role = F.col("l_linenumber") % 5
        roles = F.when(role == 0, 1).when(role == 1, 2).when(role == 2, 4).when(role == 3, 8).otherwise(0)
        out = l.join(a, "l_partkey").join(b, "l_suppkey")
        return out.select("path", bs.alias("bs"), (bs + 1).alias("be"), "callee", shape.alias("shape"), F.concat(F.lit("k"), (F.col("l_suppkey") % 50).cast("string")).alias("sym"), roles.alias("roles")).distinct()

    @property
    def relationships(self) -> DataFrame:
        n = self.raw("nation")
        key = lambda c: F.concat(F.lit("k"), F.col(c).cast("string"))
        return n.select(F.lit("").alias("path"), key("n_nationkey").alias("from_key"), key("n_regionkey").alias("to_key"), (F.col("n_nationkey") % 2 == 0).alias("is_impl"), (F.col("n_nationkey") % 3 == 0).alias("is_type"))

    @property
    def wide_decls(self) -> DataFrame:
        """decl_id, path, def_bs, def_be: overlapping spans."""
        return self.raw("part").select(F.col("p_partkey").alias("decl_id"), F.col("p_brand").alias("path"), (10 * F.col("p_size")).alias("def_bs"), (10 * F.col("p_size") + 40 * (F.col("p_partkey") % 5 + 1)).alias("def_be"))

    @property
    def mark_rows(self) -> DataFrame:
        """site_id, path, bs, be: places of line items, some of them of one site."""
        l = self.raw("lineitem")
        p = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("path"))
        bs = 60 * F.col("l_linenumber") + F.col("l_quantity").cast("int")
        return l.join(p, "l_partkey").select((100 * F.col("l_orderkey") + 10 * F.col("l_linenumber")).alias("site_id"), "path", bs.alias("bs"), (bs + 5).alias("be"))

    @property
    def marks(self) -> DataFrame:
        """site_id, path, bs, be over the same files: the first place of each site."""
        first = self.mark_rows.groupBy("site_id").agg(F.min(F.struct("path", "bs")).alias("s"))
        return first.select("site_id", "s.path", "s.bs", (F.col("s.bs") + 5).alias("be"))
