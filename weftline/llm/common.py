"""What the corpus operators share: Arrow mapping, written intermediate tables, checks of size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Documents handed to a mapping function at once.
SLICE = 256
#: Frees a job's shuffle files once the job is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session of one machine (tests) gets
    a temporary one; a cluster's is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/weftline-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: later reads survive lost executors and have no lineage.
    The shuffle files of the writing job are freed once it is done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written"] = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of written() once all that reads it has been written itself."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["_written"])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mapped(df: DataFrame, work: Callable[[], Callable[[dict], dict]], schema: str, size: int = SLICE) -> DataFrame:
    """work() is called once in each task; what it returns maps columns of up to `size` rows (name -> list) to the columns of `schema`."""
    kind = T.StructType.fromDDL(schema)

    def run(batches):
        fields = to_arrow_schema(kind)
        step = work()
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                out = step(batch.slice(i, size).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, kind)


def text_bytes(text: str = "text") -> Column:
    """UTF-8 of the text; a null text counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sampled(df: DataFrame, key: str, n: int, *rest: str) -> DataFrame:
    """Up to n rows of df: those of least xxhash64(key), then of least key, then by `rest`. Keys are chosen first and alone,
    so wide columns are read but not shuffled for all rows; the chosen keys, n at most, are broadcast."""
    order = [F.xxhash64(key), F.col(key)]
    keys = df.select(key).orderBy(*order).limit(n).distinct().select(F.col(key).alias("_key"))
    chosen = df.join(F.broadcast(keys), df[key].eqNullSafe(keys["_key"])).drop("_key")
    return chosen.orderBy(*order, *(F.xxhash64(c) for c in rest)).limit(n)


#: Keys that a join spreads over SALTS places: those with more rows than MANY, and at most KEYS keys however many rows there are.
MANY, KEYS, SALTS = 1000, 100_000, 32
#: Parts that a group is dealt to before its least rows are chosen.
SPREAD = 8


def keyed_join(rows: DataFrame, one: DataFrame, keys: list[str], total: int, by: str, n: str = "n") -> DataFrame:
    """rows joined to `one`, which has one row a key and in `n` the number of its rows. The rows of frequent keys are spread by
    the hash of column `by`. total, the number of rows, bounds what is broadcast: at most KEYS keys can have over MANY and
    over a KEYS-th part of all rows."""
    many = max(MANY, total // KEYS)
    hot = F.broadcast(one.filter(F.col(n) > many).select(*keys, F.lit(True).alias("_hot")))
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    spread = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0))).drop("_hot")
    every = F.explode(F.sequence(F.lit(0), F.when(F.col(n) > many, F.lit(SALTS - 1)).otherwise(F.lit(0))))
    return spread.join(one.select("*", every.alias("_salt")).drop(n), [*keys, "_salt"]).drop("_salt")


def smallest(df: DataFrame, by: list[str], order: list[Column], n: int, spread: str) -> DataFrame:
    """Up to n rows of each group, by `order`. Each of SPREAD parts of a group, by the hash of column `spread`, gives its first n,
    and the group's are chosen from these; Spark also keeps n rows a task before it shuffles (window group limit)."""
    from pyspark.sql import Window

    part = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(SPREAD)))
    for keys in ([*by, "_part"], by):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        part = part.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    return part.drop("_part")
