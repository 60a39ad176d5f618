"""The batch plan from triplet files: classify, pack, check, write once."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillrank.operators.batching import PlanParams, classify, collision_pairs, length_statistics, pack, plan_rows, plan_violations
from quillrank.plans.preflight import plan_digest
from quillrank.sources import folders, schemas
from quillrank.sources.files import numbered, read_json_lines_strict, union_all
from quillrank.sources.sinks import write_gzip_members, write_quarantine


def build(spark: SparkSession, inputs: dict[str, str], output: str | Path, params: PlanParams = PlanParams(), member_rows: int = 65_536) -> dict:
    """``inputs``: path of each named source.  The output folder, on any file system that Spark knows, must not exist; on failure
    nothing is left of it.  ``deterministic_digest`` covers the plan's lines in their order and the rest of the summary."""
    held = []
    try:
        with folders.staged(spark, str(output)) as stage:
            triplets = union_all([numbered(read_json_lines_strict(spark, path, schemas.TRIPLETS)).withColumn("source", F.lit(name)) for name, path in inputs.items()])
            rows = classify(triplets, params).cache()  # read once for candidates, once for quarantine
            held.append(rows)
            candidates = rows.where("reason is null")
            packed = pack(candidates, params).cache()
            held.append(packed)
            plan = plan_rows(packed)
            broken = {k: v for k, v in plan_violations(plan, params).first().asDict().items() if v}
            if broken:
                raise ValueError(f"the plan breaks its rules: {broken}")
            kept = ["batch_id", "record_id", "source", "query", "positive", "negative", "option_len_rank"]
            ordered = plan.select(*kept, F.col("number").alias("_number"), F.col("place").alias("_place"))
            digest = write_gzip_members(ordered, ["_number", "_place"], f"{stage}/plan.jsonl.gz", member_rows)
            left = rows.where("reason is not null").select("source", "record_id", "reason").unionByName(packed.where("reason is not null").select("source", "record_id", "reason"))
            write_quarantine(left, f"{stage}/quarantine")
            sizes = plan.groupBy("number").agg(F.count("*").alias("n")).agg(F.count("*").alias("batches"), F.sum("n").alias("rows")).first()
            balance = length_statistics(plan, ["number"]).agg(*[F.coalesce(F.max(c), F.lit(0.0)) for c in ("mean_gap", "quantile_gap")]).first()
            summary = {
                "records_read": rows.count(), "candidates": candidates.count(), "batched": sizes["rows"] or 0, "batches": sizes["batches"],
                "quarantined": {r["reason"]: r["n"] for r in left.groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason").collect()},
                "collision_pairs_before": collision_pairs(candidates).first()[0], "collision_pairs_after": 0, "seed": params.seed,
                "largest_mean_gap": balance[0], "largest_quantile_gap": balance[1], "plan_sha256": digest}
            summary["deterministic_digest"] = plan_digest(digest, summary)
            folders.write_json(spark, f"{stage}/summary.json", summary)
        return summary
    finally:
        for table in held:
            table.unpersist()
