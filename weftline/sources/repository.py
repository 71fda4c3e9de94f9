"""A source tree as tables: the files Spark reads, less what ignore rules leave out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import glob_regex
from weftline.operators.rules import language


def ignore_rule(line: str, base: str = "") -> tuple[str, bool] | None:
    """(regular expression over a path, keep) of one line of an ignore file in folder base; None for blanks and comments."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    keep = line.startswith("!")
    line = line[1:] if keep else line
    folder = line.endswith("/")
    anchored = "/" in line.strip("/") or line.startswith("/")
    body = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in re.sub(r"\*\*/", "\0", line.strip("/")).replace("**", "\1"))
    body = body.replace(re.escape("\0"), "(?:.*/)?").replace(re.escape("\1"), ".*")
    start = re.escape(base + "/") if base else ""
    return rf"^{start}{'' if anchored else '(?:.*/)?'}{body}{'/' if folder else '(?:/|$)'}", keep


def listed(files: DataFrame, ignores: list[tuple[str, str]], languages: list[str] | None = None, segments: list[str] = (".git", "node_modules", "target")) -> DataFrame:
    """files (path relative to the root, ...) with a known and wanted language that no ignore rule and no ignored path
    segment leaves out. ignores: (folder, text) of ignore files, outer folders first; later rules win."""
    out = files.withColumn("lang", language(F.col("path"))).filter("lang is not null")
    if languages is not None:
        out = out.filter(F.col("lang").isin(languages))
    for s in segments:
        out = out.filter(~F.concat(F.lit("/"), F.col("path")).contains(f"/{s}/"))
    hidden = F.lit(False)
    for base, text in ignores:
        for rule in filter(None, (ignore_rule(line, base) for line in text.splitlines())):
            hidden = F.when(F.col("path").rlike(rule[0]), F.lit(not rule[1])).otherwise(hidden)
    return out.filter(~hidden)


def ignore_files(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(folder, text) of the ignore files under root, outer ones first. Spark's file sources skip names with a point."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toUri().getPath().rstrip("/")
    found, every = [], fs.listFiles(top, True)
    while every.hasNext():
        at = every.next().getPath()
        if at.getName() == ".gitignore":
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(at), "UTF-8")
            found.append((at.getParent().toUri().getPath()[len(base) :].strip("/"), text))
    return sorted(found, key=lambda x: (len(x[0]), x[0]))


def walk(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """files: file_id, path, lang, size, content_hash, mtime_ns, content. Ids number the paths in order, from 1."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = "^" + re.escape((root if "://" in root or root.startswith("file:") else "file:" + root).rstrip("/")) + "/+"
    files = raw.select(F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), prefix, "").alias("path"), F.col("length").alias("size"), "modificationTime", "content")
    kept = listed(files, ignore_files(spark, root), languages)
    ids = kept.select("path").withColumn("file_id", F.row_number().over(Window.orderBy("path")))  # paths alone are ordered in one place
    out = kept.join(ids, "path")
    return out.select("file_id", "path", "lang", "size", F.unhex(F.sha2("content", 256)).alias("content_hash"), (F.unix_micros("modificationTime").cast("decimal(38,0)") * 1000).cast("decimal(38,0)").alias("mtime_ns"), "content")


def matches(path: str, glob: str) -> bool:
    return re.match(glob_regex(glob), path) is not None
