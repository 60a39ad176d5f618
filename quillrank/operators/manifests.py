"""Digests of files against those that were claimed for them: everything that differs, at once."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators.comparison import EvidenceError

#: Rules in the order in which they are told.
RULES = ("claimed_twice", "missing", "unlisted", "size", "digest")


def tree_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, bytes, sha256)`` of every file below ``folder`` on any file system that Spark reads; paths are relative to it.

    Each file is digested whole by one task.  Spark's readers pass empty files over, so those come from the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    root = str(fs.makeQualified(where).toUri().getPath()).rstrip("/") + "/"
    listing, empty = fs.listFiles(where, True), []
    while listing.hasNext():
        status = listing.next()
        if not status.getLen():
            empty.append((str(status.getPath().toUri().getPath())[len(root) :], 0, hashlib.sha256(b"").hexdigest()))
    found = files.select(F.substring_index(F.col("path"), root, -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return found.unionByName(spark.createDataFrame(empty, "path string, bytes long, sha256 string"))


def manifest_issues(claimed: DataFrame, found: DataFrame) -> DataFrame:
    """``(path, rule, detail)`` from two tables ``(path, bytes, sha256)``: files that are claimed twice, missing, there without a claim, or of
    another size or digest.  A claim without a size or digest is not held to it."""
    names = ["path", "bytes", "sha256"]
    counts = claimed.groupBy("path").agg(F.count("*").alias("n"), F.min("bytes").alias("bytes"), F.min("sha256").alias("sha256"))
    twice = counts.where("n > 1").select("path", F.lit(RULES[0]).alias("rule"), F.col("n").cast("string").alias("detail"))
    left, right = counts.select(*names, F.lit(True).alias("there")).alias("c"), found.select(*names, F.lit(True).alias("there")).alias("f")
    both = left.join(right, F.col("c.path") == F.col("f.path"), "full").select(
        F.coalesce("c.path", "f.path").alias("path"), F.array(
            F.when(F.col("f.there").isNull(), F.struct(F.lit(RULES[1]).alias("rule"), F.lit("").alias("detail"))),
            F.when(F.col("c.there").isNull(), F.struct(F.lit(RULES[2]).alias("rule"), F.lit("").alias("detail"))),
            F.when(F.col("c.bytes") != F.col("f.bytes"), F.struct(F.lit(RULES[3]).alias("rule"), F.concat_ws(" ", F.col("c.bytes").cast("string"), F.col("f.bytes").cast("string")).alias("detail"))),
            F.when(F.lower("c.sha256") != F.col("f.sha256"), F.struct(F.lit(RULES[4]).alias("rule"), F.col("f.sha256").alias("detail")))).alias("issues"))
    rows = both.select("path", F.explode(F.filter("issues", lambda i: i.isNotNull())).alias("i")).select("path", "i.rule", "i.detail")
    return rows.unionByName(twice)


def require_manifest(claimed: DataFrame, found: DataFrame, named: int = 1000) -> None:
    """Fails with all that :func:`manifest_issues` finds; ``named`` issues are listed, and where there are more, their number."""
    issues = manifest_issues(claimed, found).orderBy("path", "rule").limit(named + 1).collect()
    if issues:
        told = [f"{r['path']}: {r['rule']} {r['detail']}".strip() for r in issues[:named]]
        if len(issues) > named:
            told.append(f"{manifest_issues(claimed, found).count()} in all, {named} listed")
        raise EvidenceError(told)
