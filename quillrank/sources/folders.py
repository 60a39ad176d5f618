"""Files by Hadoop's file systems, for paths that only Spark may see: staged output that appears whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _place(spark, path)
    return fs.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = _place(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _place(spark, path)
    fs.delete(where, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted."""
    fs, where = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where))


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Refuses to overwrite."""
    fs, where = _place(spark, old)
    if fs.exists(_place(spark, new)[1]):
        raise FileExistsError(f"{new} exists")
    fs.mkdirs(_place(spark, new)[1].getParent())
    if not fs.rename(where, _place(spark, new)[1]):
        raise OSError(f"{old} cannot be renamed to {new}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file; refuses to overwrite."""
    fs, where = _place(spark, path)
    out = fs.create(where, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    fs, where = _place(spark, path)
    with_lines = spark._jvm.org.apache.commons.io.IOUtils
    opened = fs.open(where)
    try:
        return with_lines.toString(opened, "UTF-8")
    finally:
        opened.close()


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n")


@contextmanager
def staged(spark: SparkSession, output: str) -> Iterator[str]:
    """A folder beside ``output`` that takes its place once the block ends; on failure nothing is left.  ``output`` must not exist.

    Spark's own committers keep the files of failed tasks out of it."""
    output = str(output).rstrip("/")
    if exists(spark, output):
        raise FileExistsError(f"{output} exists")
    stage = f"{output}.stage-{uuid.uuid4().hex}"
    try:
        yield stage
        rename(spark, stage, output)
    finally:
        if exists(spark, stage):
            delete(spark, stage)
