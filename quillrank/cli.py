"""Command line: search a corpus file, evaluate, plan batches, compare models."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quillrank").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def search(args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from quillrank.plans.config import Retriever
    from quillrank.plans.evaluate import search as run
    from quillrank.sources import schemas
    from quillrank.sources.files import numbered, read_json_lines

    spark = _session()
    corpus = read_json_lines(spark, args.corpus, schemas.SEARCH_CORPUS).select(F.col("id").alias("doc_id"), "text")
    queries = spark.createDataFrame([("q", args.query)], "query_id string, text string")
    retriever = Retriever(type="bm25") if args.model == "bm25" else Retriever(type="dense", encoder=args.model)
    texts = numbered(corpus).groupBy("doc_id").agg(F.max_by("text", "seq").alias("text"))  # of a repeated id the last line's
    for r in run(corpus, queries, args.top_k, retriever).join(texts, "doc_id").orderBy("rank").collect():
        print(f"{r['rank']}\t{r['doc_id']}\t{r['score']:.4f}\t{r['text']}")
    return 0


def evaluate(args: argparse.Namespace) -> int:
    from quillrank.plans.config import compile_config, merge_model
    from quillrank.plans.evaluate import run
    from quillrank.sources.sinks import run_folder

    config = json.loads(Path(args.config).read_text())
    models = json.loads(Path(args.models_config).read_text()) if args.models_config else None
    run(_session(), compile_config(merge_model(config, models, args.model_key)), run_folder(args.output, "run"))
    return 0


def batches(args: argparse.Namespace) -> int:
    from quillrank.operators.batching import PlanParams
    from quillrank.plans.batches import build

    config = json.loads(Path(args.config).read_text())
    build(_session(), config["inputs"], args.output, PlanParams(**config.get("plan", {})))
    return 0


def compare(args: argparse.Namespace) -> int:
    from quillrank.operators.comparison import EvidenceError
    from quillrank.plans.compare import compare as run

    config = json.loads(Path(args.config).read_text())
    candidates = config["candidates"]
    summaries = {key: json.loads(Path(c["summary_path"]).read_text()) for key, c in candidates.items() if "summary_path" in c}
    try:
        run(_session(), candidates, config.get("ineligible_for_external_selection", []), config.get("frozen_contract"), summaries, output=None if args.check_only else args.output,
            licenses=config.get("license_labels"), withdrawn=config.get("withdrawn_values"))
    except EvidenceError as error:
        print(*error.issues, sep="\n", file=sys.stderr)
        return 2
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillrank")
    sub = out.add_subparsers(required=True)
    p = sub.add_parser("search")
    for name, extra in (("--model", {"default": "bm25"}), ("--query", {"required": True}), ("--corpus", {"required": True}), ("--top-k", {"type": int, "default": 3})):
        p.add_argument(name, **extra)
    p.set_defaults(run=search)
    p = sub.add_parser("evaluate")
    for name, extra in (("--config", {"required": True}), ("--models-config", {}), ("--model-key", {}), ("--output", {"default": "runs"})):
        p.add_argument(name, **extra)
    p.set_defaults(run=evaluate)
    for name, run in (("batches", batches), ("compare", compare)):
        p = sub.add_parser(name)
        p.add_argument("--config", required=True)
        p.add_argument("--output", default="out")
        if name == "compare":
            p.add_argument("--check-only", action="store_true")
        p.set_defaults(run=run)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
