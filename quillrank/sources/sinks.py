"""Writers of small reports: atomic, byte-stable where a digest is asked for."""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quillrank.functions.text import printed_bool
from quillrank.sources.files import numbered
from quillrank.sources.folders import delete, exists, listed, rename


def write_json(path: str | Path, value: object) -> None:
    """UTF-8, two spaces, a line end; written beside and renamed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    os.replace(part, path)


_CANONICAL = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def write_gzip_lines(path: str | Path, records: Iterable[dict], level: int = 9) -> str:
    """Gzipped JSON lines that are the same bytes for the same records (zlib's own header has neither name nor time); their
    SHA-256, taken while they are written."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    packer, digest = zlib.compressobj(level, zlib.DEFLATED, 16 + zlib.MAX_WBITS), hashlib.sha256()
    with part.open("wb") as file:
        for piece in chain((packer.compress(f"{_CANONICAL.encode(r)}\n".encode()) for r in records), (packer.flush() for _ in range(1))):
            digest.update(piece)
            file.write(piece)
    os.replace(part, path)
    return digest.hexdigest()


def canonical_lines(rows: DataFrame) -> Column:
    """Each row as JSON: columns by name but those that begin with an underscore, nulls kept, no spaces."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns) if not c.startswith("_")]), {"ignoreNullFields": "false"})


def digest_levels(lines: DataFrame, fan: int = 4096) -> Iterator[DataFrame]:
    """The levels of an ordered digest of ``lines(seq, value)``, each ``(level, chunk, n, digest)``; ``seq`` counts from one.

    A chunk's digest is the SHA-256 of the digests of its ``fan`` parts in order, as hexadecimal text: on the first level of the lines'
    own, then of the chunks of the level before.  So no aggregate holds more than ``fan`` digests, and a changed line or two
    that change places change the root.  No lines give one chunk of none."""
    parts, level = lines.select((F.col("seq") - 1).alias("at"), F.sha2(F.col("value").cast("binary"), 256).alias("h"), F.lit(1).cast("long").alias("n")), 0
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda p: p["h"]), "")
        found = parts.groupBy(F.floor(F.col("at") / fan).alias("chunk")).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("digest"))
        found = found.select(F.lit(level).alias("level"), "chunk", "n", "digest")
        last = parts.agg(F.max("at")).first()[0]
        if last is None:
            yield found.sparkSession.createDataFrame([(0, 0, 0, hashlib.sha256(b"").hexdigest())], "level int, chunk long, n long, digest string")
            return
        yield found
        if last < fan:
            return
        parts, level = found.select(F.col("chunk").alias("at"), F.col("digest").alias("h"), "n"), level + 1


def ordered_digest(lines: DataFrame, fan: int = 4096) -> str:
    """The root of :func:`digest_levels`."""
    *_, top = digest_levels(lines, fan)
    return top.first()["digest"]


def write_gzip_members(rows: DataFrame, order: list[str], path: str, member_rows: int = 65_536) -> str:
    """Gzipped JSON lines whose bytes depend on the rows and their total order alone, not on partitions; their ordered digest.

    Lines are numbered, and each ``member_rows`` of them are one gzip member, compressed and written by one task; members
    follow each other by name, and put together they are a gzip file too.  One member is a file at ``path``, more are a folder.  Spark commits
    files of whole tasks alone; a path that exists is refused."""
    spark = rows.sparkSession
    if exists(spark, path):
        raise FileExistsError(f"{path} exists")
    kept = rows.orderBy(*order).select(canonical_lines(rows).alias("value")).persist()
    try:
        lines = numbered(kept)
        count = kept.count()
        members = max(1, -(-count // member_rows))
        parts = lines.repartitionById(members, F.floor((F.col("seq") - 1) / member_rows).cast("int")).sortWithinPartitions("seq")
        folder = f"{path}.members"
        parts.select("value").write.mode("errorifexists").option("compression", "gzip").text(folder)
        names = [n for n in listed(spark, folder) if n.startswith("part-")]
        if len(names) != members:
            raise OSError(f"{folder} has {len(names)} members, not {members}")
        if members == 1:
            rename(spark, f"{folder}/{names[0]}", path)
            delete(spark, folder)
        else:
            for i, name in enumerate(names):
                rename(spark, f"{folder}/{name}", f"{folder}/member-{i:08d}.jsonl.gz")
            rename(spark, folder, path)
        return ordered_digest(lines)
    finally:
        kept.unpersist()


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order and any partitioning, from one aggregate."""
    row = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
    return hashlib.sha256(f"{sorted(df.dtypes)}|{row['n']}|{row['s']}".encode()).hexdigest()


def write_tsv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One tab-separated file with a header; booleans as True and False; refuses to overwrite."""
    rows = df.select(*(columns or df.columns))
    booleans = {f.name for f in rows.schema.fields if isinstance(f.dataType, BooleanType)}
    rows.select(*[printed_bool(F.col(c)).alias(c) if c in booleans else F.col(c) for c in rows.columns]).coalesce(1).write.mode("errorifexists").option("sep", "\t").option("header", True).csv(path)


#: Columns of per-query files in their order; those that a table lacks are left out.
PER_QUERY_COLUMNS = ("query_id", "ndcg", "mrr", "recall", "unjudged_in_top", "correct", "rank", "reciprocal_rank", "longest_option_hit", "random_hit")


def write_per_query(df: DataFrame, path: str) -> None:
    write_tsv(df.orderBy("query_id"), path, [c for c in PER_QUERY_COLUMNS if c in df.columns])


def write_quarantine(df: DataFrame, path: str) -> None:
    df.select("source", "record_id", "reason").orderBy("source", "record_id", "reason").coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in columns) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def run_folder(root: str | Path, name: str) -> Path:
    """A new folder; ``_1``, ``_2`` and so on where the name is taken."""
    at = Path(root) / name
    number = 0
    while True:
        try:
            at.mkdir(parents=True, exist_ok=False)
            return at
        except FileExistsError:
            number += 1
            at = Path(root) / f"{name}_{number}"
