"""Readers of line-delimited JSON (also gzipped) and of tab-separated tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_BAD = "_corrupt_record"


def read_json_lines(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """Rows of the schema; blank lines are skipped, a line that does not parse gives nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, line, value)`` of text files: each line with its number in its file, from one.

    A file may be read in many splits.  Each numbers its own lines; what is added up is the number of lines of each split, a row a
    split, in the order of the splits' places in their file."""
    raw = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").toDF("value", "file", "split").withColumn("_m", F.monotonically_increasing_id())
    # The lines of a split follow each other in one task.
    splits = raw.groupBy("file", "split").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "split", (before - F.col("_first") + 1).alias("_add"))
    return raw.join(splits, ["file", "split"]).select("file", (F.col("_m") + F.col("_add")).alias("line"), "value")


def _parsed(rows: DataFrame, schema: StructType) -> DataFrame:
    """Rows with a ``value`` that is not blank, with ``row`` and ``bad``: the value is no JSON object of the schema."""
    parsed = F.from_json("value", StructType([*schema.fields, StructField(_BAD, StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    rows = rows.where(F.trim("value") != "").withColumn("row", parsed)
    return rows.withColumn("bad", F.col("row").isNull() | F.col(f"row.{_BAD}").isNotNull() | ~F.ltrim("value").startswith("{"))


def bad_lines(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """``(file, line, value)`` of all lines that are not blank and no JSON object of the schema."""
    return _parsed(numbered_lines(spark, path), schema).where("bad").select("file", "line", "value")


def read_json_lines_strict(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """As :func:`read_json_lines`; a line that is not a JSON object of the schema fails, the first one named by file, line and text.

    All lines are looked at once before; only where one is bad are lines numbered.  Rows keep the order of a scan."""
    rows = _parsed(spark.read.text(path).withColumn("file", F.input_file_name()), schema)
    if not rows.where("bad").isEmpty():
        first = bad_lines(spark, path, schema).orderBy("file", "line").first()
        if first is not None:
            raise ValueError(f"{first['file']}:{first['line']}: invalid JSON: {first['value']}")
    check = F.when(F.col("bad"), F.raise_error(F.concat(F.lit("invalid JSON in "), "file", F.lit(": "), "value"))).otherwise(F.lit(True))
    return rows.where(check).select(*[F.col(f"row.{f.name}").alias(f.name) for f in schema.fields])


def numbered(rows: DataFrame, column: str = "seq") -> DataFrame:
    """Rows with their number from one, in their order.  Each partition numbers its own rows; only the partitions' sizes, a
    number each, are added up.  Rows are looked at twice, so they come from a scan or are kept (:func:`numbered_in_order`): a sort
    that is run twice need not cut its partitions alike."""
    marked = rows.withColumn("_m", F.monotonically_increasing_id())
    part, offset = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    out = marked.withColumn("_p", part).join(before, "_p").withColumn(column, F.col("_before") + offset + 1)
    return out.drop("_m", "_p", "_n", "_before")


def numbered_in_order(rows: DataFrame, order: list, column: str = "seq") -> DataFrame:
    """As :func:`numbered`, of rows sorted by ``order`` and kept in memory or on disk for as long as Spark needs the room for nothing else."""
    return numbered(rows.orderBy(*order).persist(), column)


def read_tsv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A tab-separated table with a header; all cells are strings."""
    rows = spark.read.option("sep", "\t").option("header", True).option("escape", '"').csv(path)
    if schema is not None:
        missing = [f.name for f in schema.fields if f.name not in rows.columns]
        if missing:
            raise ValueError(f"{path} lacks {', '.join(missing)}")
        rows = rows.select(*[f.name for f in schema.fields])
    return rows


def read_qrels(spark: SparkSession, path: str, split: str | None = None, relevance_field: str = "relevance", doc_field: str = "doc_id", split_field: str | None = None) -> DataFrame:
    """``(query_id, doc_id, grade)``: grades above zero; one without the relevance column; the last of repeated rows counts."""
    rows = numbered(read_tsv(spark, path))
    if split_field:
        rows = rows.where(F.col(split_field) == split)
    grade = F.col(relevance_field).cast("double") if relevance_field in rows.columns else F.lit(1.0)
    rows = rows.select("query_id", F.col(doc_field).alias("doc_id"), grade.alias("grade"), "seq").where("grade > 0")
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("grade", "seq").alias("grade"))


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, sha256)`` of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
