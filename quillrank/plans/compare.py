"""The comparison of models from their per-query files."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.text import checked_bool
from quillrank.operators.comparison import EvidenceError, Resampling, exact_metrics, paired_intervals, pairwise, require_evidence, selection, selection_trace, summary_issues, superiority, wide_pairs, zero_shot_deltas
from quillrank.operators.statistics import holm
from quillrank.sources import schemas
from quillrank.sources.files import read_tsv, union_all
from quillrank.sources.sinks import markdown_table, write_json

STATEMENTS = ("Intervals come from resampling the same queries for both models.", "Pairs are compared without correction unless the column says adjusted.",
              "Models that are not eligible are listed and never selected.", "The splits compared were seen before.")


def load_choices(spark: SparkSession, candidates: dict[str, dict]) -> DataFrame:
    rows = [read_tsv(spark, c["exam_per_query_path"], schemas.CHOICE_RESULTS).withColumn("model_key", F.lit(k)) for k, c in candidates.items()]
    return union_all(rows).select("model_key", "query_id", checked_bool(F.col("correct")).alias("correct"), F.col("rank").cast("int").alias("rank"), F.col("reciprocal_rank").cast("double").alias("reciprocal_rank"))


def load_passages(spark: SparkSession, candidates: dict[str, dict]) -> DataFrame:
    rows = [read_tsv(spark, c["passage_per_query_path"], schemas.PASSAGE_RESULTS).withColumn("model_key", F.lit(k)) for k, c in candidates.items()]
    return union_all(rows).select("model_key", "query_id", *[F.col(c).cast("double").alias(c) for c in ("ndcg", "mrr", "recall")])


def compare(spark: SparkSession, candidates: dict[str, dict], ineligible: list[str] = (), contract: dict | None = None, summaries: dict[str, dict] | None = None,
            resampling: Resampling = Resampling(), output: str | Path | None = None, licenses: dict[str, str] | None = None, withdrawn: list[tuple[str, float]] | None = None,
            baselines: dict[str, dict[str, float]] | None = None) -> dict:
    """Fails with all that is wrong; otherwise metrics, selection with its trace, pairs and their intervals.  Without ``output``
    nothing is written.  With a contract, licence labels or withdrawn values every model needs a summary.  ``baselines`` are each
    model's values before training, by metric; with them every model needs one, and deltas are told.  Resources come from the
    summaries that have them."""
    held = load_choices(spark, candidates).cache(), load_passages(spark, candidates).cache()  # read by every step
    issues = []
    if contract or summaries or licenses or withdrawn:
        issues = [f"{m}: no summary" for m in candidates if m not in (summaries or {})] + summary_issues(summaries or {}, contract or {}, licenses, withdrawn)
    if baselines is not None:
        issues += [f"{m}: no baseline" for m in candidates if m not in baselines]
    try:
        return _compare(spark, *held, list(candidates), list(ineligible), issues, resampling, output, baselines, summaries or {})
    finally:
        for table in held:  # files may change before the next call
            table.unpersist()


def _compare(spark: SparkSession, choices: DataFrame, passages: DataFrame, models: list[str], ineligible: list[str], issues: list[str], resampling: Resampling,
             output: str | Path | None, baselines: dict[str, dict[str, float]] | None, summaries: dict[str, dict]) -> dict:
    for evidence in (choices, passages):
        try:
            require_evidence(evidence, models)
        except EvidenceError as error:
            issues += error.issues
    if issues:
        raise EvidenceError(issues)
    metrics = exact_metrics(choices, passages)
    order = spark.createDataFrame([(m, i) for i, m in enumerate(models)], "model_key string, position int")
    chosen = [r.asDict() for r in selection(metrics, order, ineligible).orderBy(F.col("place").asc_nulls_last(), "model_key").collect()]
    pairs = holm(pairwise(choices, resampling), [])
    intervals = paired_intervals(choices, passages, resampling)
    pairs, intervals = pairs.cache(), intervals.cache()  # both go into two tables
    trace = selection_trace(metrics, order, ineligible)
    deltas = []
    if baselines:
        names = sorted(set.intersection(*[set(b) for b in baselines.values()]) & set(metrics.columns))
        base = spark.createDataFrame([(m, *[float(baselines[m][n]) for n in names]) for m in models], ", ".join(["model_key string", *[f"{n} double" for n in names]]))
        deltas = [r.asDict() for r in zero_shot_deltas(metrics, base, names).orderBy("model_key").collect()]
    eligible = [r["model_key"] for r in chosen if r["eligible"]]
    report = {"metrics": [r.asDict() for r in metrics.orderBy("model_key").collect()], "selection": chosen, "pairs": [r.asDict() for r in pairs.orderBy("model_a", "model_b").collect()],
              "intervals": [r.asDict() for r in intervals.orderBy("model_a", "model_b", "metric").collect()],
              "winner": eligible[0] if eligible else None, "label": superiority(pairs, *eligible[:2]) if len(eligible) > 1 else "no comparison", "statements": list(STATEMENTS)}
    report |= {"trace": [r.asDict() for r in trace.orderBy("step", "model_key").collect()], "deltas": deltas,
               "resources": [{"model_key": m, **s["resources"]} for m, s in sorted(summaries.items()) if isinstance(s.get("resources"), dict)]}
    wide = [r.asDict() for r in wide_pairs(pairs, intervals).orderBy("model_a", "model_b").collect()]
    pairs.unpersist(), intervals.unpersist()
    if output is not None:
        write_json(Path(output) / "comparison.json", report)
        tables = [markdown_table(report[part], list(report[part][0])) for part in ("metrics", "deltas", "selection", "trace", "pairs", "intervals", "resources") if report[part]]
        text = "# Comparison\n\n" + "\n".join(tables) + "\n" + "\n".join(f"- {s}" for s in STATEMENTS) + "\n"
        if report["pairs"]:
            with (Path(output) / "pairs.csv").open("w", newline="", encoding="utf-8") as file:
                writer = csv.DictWriter(file, list(report["pairs"][0]), lineterminator="\n")
                writer.writeheader()
                writer.writerows(report["pairs"])
        if wide:
            with (Path(output) / "pairs_wide.csv").open("w", newline="", encoding="utf-8") as file:
                writer = csv.DictWriter(file, list(wide[0]), lineterminator="\n")
                writer.writeheader()
                writer.writerows(wide)
        (Path(output) / "comparison.md").write_text(text, encoding="utf-8")
    return report
