"""Checks before a plan is used: digests, counts, contiguous batches; and the choice of a checkpoint to go on from."""

from __future__ import annotations

import json
import re
import shutil
from dataclasses import asdict
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.functions.text import config_digest
from quillrank.operators.batching import group_sizes
from quillrank.sources import folders, schemas
from quillrank.sources.files import numbered_lines
from quillrank.sources.sinks import ordered_digest


class PreflightError(ValueError):
    pass


def plan_digest(lines_digest: str, summary: dict) -> str:
    """The digest of a plan's lines and of the summary without digests of its own."""
    rest = {k: v for k, v in summary.items() if k not in ("deterministic_digest", "plan_sha256")}
    return config_digest({"lines": lines_digest, "summary": rest})


def load_plan(spark: SparkSession, path: str | Path, sha256: str, rows: int | None = None, groups: int | None = None, stored: str | None = None) -> tuple[DataFrame, list[int]]:
    """The plan's rows in order with ``seq``, and its batches' sizes.  ``path`` is one member or a folder of members.

    The lines must have the ordered digest that is asked for, and the one stored beside them if given; rows and batches must be
    as many as expected, and each batch one run of rows.
    """
    if stored is not None and stored != sha256:
        raise PreflightError("the stored digest is not the one asked for")
    lines = numbered_lines(spark, str(path)).withColumn("at", F.row_number().over(Window.partitionBy("file").orderBy("line")))
    # Members follow each other by name; a row for each of them.
    sizes = lines.groupBy("file").agg(F.count("*").alias("n"))
    before = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    lines = lines.join(before, "file").select((F.col("before") + F.col("at")).alias("seq"), "value")
    if ordered_digest(lines) != sha256:
        raise PreflightError("the plan's digest is not the one asked for")
    plan = lines.select(F.from_json("value", schemas.PLAN).alias("r"), "seq").select("r.*", "seq")
    try:
        sizes = group_sizes(plan, "batch_id", ["seq"])
    except ValueError as error:
        raise PreflightError(str(error)) from error
    for what, have, want in (("rows", sum(sizes), rows), ("batches", len(sizes), groups)):
        if want is not None and have != want:
            raise PreflightError(f"the plan has {have} {what}, not {want}")
    return plan, sizes


def load_built(spark: SparkSession, folder: str | Path, expected: str | None = None) -> tuple[DataFrame, list[int], dict]:
    """Plan, batch sizes and summary of a folder that ``batches.build`` wrote; its digest, the one stored and the one computed
    anew from all lines and the summary, must be the one expected."""
    summary = json.loads(folders.read_text(spark, f"{folder}/summary.json"))
    stored = summary.get("deterministic_digest")
    if expected is not None and stored != expected:
        raise PreflightError("the stored digest is not the one asked for")
    if plan_digest(summary.get("plan_sha256", ""), summary) != stored:
        raise PreflightError("the summary's digest is not the one stored")
    plan, sizes = load_plan(spark, f"{folder}/plan.jsonl.gz", summary["plan_sha256"], summary["batched"], summary["batches"])
    return plan, sizes, summary


def check_sampler(sizes: list[int], rows: int) -> None:
    if sum(sizes) != rows or any(s < 1 for s in sizes):
        raise PreflightError(f"batches of {sum(sizes)} rows for {rows} rows")


_STEP = re.compile(r"checkpoint-(\d+)")
MARKER = "COMPLETE"


def newest_checkpoint(folder: str | Path) -> Path | None:
    """The complete checkpoint of the highest step."""
    found = [(int(m[1]), p) for p in Path(folder).glob("checkpoint-*") if (m := _STEP.fullmatch(p.name)) and (p / MARKER).is_file()]
    return max(found, default=(0, None))[1]


def retain_checkpoints(folder: str | Path, keep: int) -> list[Path]:
    """Removes complete checkpoints but the newest ``keep``; what was removed."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    found = sorted((int(m[1]), p) for p in Path(folder).glob("checkpoint-*") if (m := _STEP.fullmatch(p.name)) and (p / MARKER).is_file())
    gone = [p for _, p in found[:-keep]]
    for p in gone:
        shutil.rmtree(p)
    return gone


def run_manifest(evaluation, spark: SparkSession) -> dict:
    """What a run was asked for and ran on."""
    return {"started": datetime.now(timezone.utc).isoformat(timespec="seconds"), "spark": spark.version, "settings": asdict(evaluation)}
