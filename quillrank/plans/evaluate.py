"""A task's lazy plans: ranked lists, metrics per query, summary, strata and intervals."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.text import script_level
from quillrank.functions.vectors import normalize_lenient
from quillrank.operators.choice import answer_rows, baselines, bm25_option_scores, choice_summary, option_rows, rank_options, vector_option_scores
from quillrank.operators.encoding import counted, encode, hashed_vectors
from quillrank.operators.metrics import mixed_drop, per_query_metrics, retrieval_summary, strata_intervals
from quillrank.operators.ranking import Bm25Params, bm25_top_k, vector_top_k
from quillrank.operators.statistics import bootstrap_intervals
from quillrank.plans.config import Bootstrap, Cutoffs, Evaluation, Retriever, Task
from quillrank.plans.preflight import run_manifest
from quillrank.sources import schemas
from quillrank.sources.files import numbered, read_json_lines
from quillrank.sources.sinks import markdown_table, write_json, write_per_query
from quillrank.sources.tasks import TaskTables, choice_table, load_retrieval_task, pairs_tables


@dataclass(frozen=True)
class Result:
    per_query: DataFrame
    summary: DataFrame
    strata: DataFrame | None
    headline: DataFrame
    drops: DataFrame | None
    #: What was counted on the way to the encoder, by role and route.
    routes: dict[str, Observation] = field(default_factory=dict)


def embed(rows: DataFrame, retriever: Retriever, role: str, id_col: str, routes: dict[str, Observation] | None = None) -> DataFrame:
    """``(id, v)`` of the rows; ``routes`` takes what is counted while they are encoded."""
    if routes is not None:
        rows, routes[role] = counted(rows, role, {retriever.routes.get(role, role): True})
    prefix = retriever.query_prefix if role == "query" else retriever.document_prefix
    if retriever.encoder == "hashing":
        named = rows.select(F.col(id_col).alias("doc_id"), F.concat(F.lit(prefix), F.coalesce("text", F.lit(""))).alias("text"))
        out = hashed_vectors(named, retriever.dim, retriever.max_length, retriever.tokenizer).withColumnRenamed("doc_id", id_col)
    else:
        out = encode(rows, retriever.encoder, role, prefix, retriever.batch_size, retriever.max_length, id_col)
    return out.withColumn("v", normalize_lenient(F.col("v"))) if retriever.normalize else out


def search(corpus: DataFrame, queries: DataFrame, k: int, retriever: Retriever, routes: dict[str, Observation] | None = None) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` by the configured retriever."""
    if retriever.type == "bm25":
        return bm25_top_k(corpus.select("doc_id", "text"), queries.select("query_id", "text"), k, Bm25Params(retriever.k1, retriever.b, retriever.tokenizer, retriever.scripts))
    return vector_top_k(embed(corpus, retriever, "passage", "doc_id", routes), embed(queries, retriever, "query", "query_id", routes), k, retriever.similarity)


def _strata(rows: DataFrame, fields: tuple[str, ...], thresholds: tuple[int, ...], measures: list[str], by: str, bootstrap: Bootstrap) -> DataFrame | None:
    columns = {f: f for f in fields}
    for t in thresholds:
        name = f"code_switch_{t}"
        rows = rows.withColumn(name, script_level(F.col("code_switch.hangul_chars"), F.col("code_switch.latin_chars"), t))
        columns[name] = name
    if not columns:
        return None
    flat = rows.select(*[F.col(c).alias(n.replace(".", "_")) for n, c in columns.items()], F.col(by).alias("row"), *measures)
    return strata_intervals(flat, {n: n.replace(".", "_") for n in columns}, measures, "row", bootstrap.iterations, bootstrap.confidence, bootstrap.seed)


def _finish(rows: DataFrame, per_query: DataFrame, summary: DataFrame, task: Task, metric: str, measures: list[str], bootstrap: Bootstrap, by: str) -> Result:
    strata = _strata(rows, task.subgroup_fields, task.thresholds, measures, by, bootstrap)
    headline = bootstrap_intervals(rows.select(F.col(by).alias("id"), F.col(metric).cast("double").alias("value")), [], bootstrap.iterations, bootstrap.confidence, bootstrap.seed)
    return Result(per_query, summary, strata, headline, mixed_drop(strata.where(F.col("metric") == metric)) if strata is not None and task.thresholds else None)


def evaluate_retrieval(tables: TaskTables, task: Task, cutoffs: Cutoffs = Cutoffs(), bootstrap: Bootstrap = Bootstrap()) -> Result:
    routes: dict[str, Observation] = {}
    ranked = search(tables.corpus, tables.queries, cutoffs.k, task.retriever, routes)
    per_query = per_query_metrics(tables.queries, ranked, tables.qrels, tables.judged, cutoffs.ndcg, cutoffs.mrr, cutoffs.recall).cache()  # read by all that follows
    scored = per_query.where("has_qrel").join(tables.queries, "query_id")
    return replace(_finish(scored, per_query, retrieval_summary(per_query, tables.corpus, tables.judged), task, task.headline, ["ndcg", "mrr", "recall"], bootstrap, "query_id"), routes=routes)


def evaluate_choices(questions: DataFrame, task: Task, bootstrap: Bootstrap = Bootstrap()) -> Result:
    options = option_rows(questions)
    r, routes = task.retriever, {}
    if r.type == "bm25":
        scores = bm25_option_scores(questions, Bm25Params(r.k1, r.b, r.tokenizer, r.scripts))
    else:
        asked = embed(questions.select(F.col("question_id").alias("query_id"), "text"), r, "query", "query_id", routes)
        named = options.select(F.concat_ws("\u0001", "question_id", "idx").alias("doc_id"), F.col("option").alias("text"), "question_id", "idx")
        held = embed(named, r, "passage", "doc_id", routes).join(named.drop("text"), "doc_id").groupBy("question_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda x: x["v"]).alias("option_vectors"))  # a question's options
        scores = vector_option_scores(asked.select(F.col("query_id").alias("question_id"), "v").join(held, "question_id"), r.similarity)
    per_query = answer_rows(rank_options(options, scores)).join(baselines(questions), "question_id").withColumn("query_id", F.col("question_id").cast("string")).cache()
    metric = "reciprocal_rank" if task.headline == "mrr" else "correct"
    rows = per_query.withColumn("correct", F.col("correct").cast("int")).join(questions.drop("text", "options", "answer_index", "query"), "question_id")
    return replace(_finish(rows, per_query, choice_summary(per_query), task, metric, ["correct", "reciprocal_rank"], bootstrap, "question_id"), routes=routes)


def run_task(spark: SparkSession, task: Task, evaluation: Evaluation) -> Result:
    if task.type == "retrieval":
        return evaluate_retrieval(load_retrieval_task(spark, task.settings), task, evaluation.cutoffs, evaluation.bootstrap)
    if task.type == "pairs_retrieval":
        pairs = numbered(read_json_lines(spark, task.settings["pairs_path"], schemas.PAIRS))
        return evaluate_retrieval(pairs_tables(pairs, task.split, task.settings.get("corpus_splits")), task, evaluation.cutoffs, evaluation.bootstrap)
    return evaluate_choices(choice_table(read_json_lines(spark, task.settings["questions_path"], schemas.CHOICES), task.split), task, evaluation.bootstrap)


def run(spark: SparkSession, evaluation: Evaluation, folder: str | Path) -> dict:
    """Every task that may run, written under ``folder``: per-query tables, summaries and a report.  Returns the summary."""
    tasks, skipped = evaluation.runnable()
    out: dict = {"skipped": [{"task": n, "reason": r} for n, r in skipped], "tasks": {}}
    for task in tasks:
        began = time.monotonic()
        result = run_task(spark, task, evaluation)
        at = Path(folder) / task.name
        write_per_query(result.per_query, str(at / "per_query"))
        block = result.summary.first().asDict()
        block["headline"] = result.headline.first().asDict() if not result.headline.isEmpty() else {"n": 0, "mean": 0.0, "low": 0.0, "high": 0.0}
        strata = [r.asDict() for r in result.strata.orderBy("field", "place", "metric").collect()] if result.strata is not None else []
        block["strata"] = strata
        block["mixed_drop"] = [r.asDict() for r in result.drops.collect()] if result.drops is not None else []
        block["route_counts"] = {role: dict(seen.get) for role, seen in sorted(result.routes.items())}
        block["config"] = {k: v for k, v in asdict(task).items() if k != "settings"} | {"settings": {k: v for k, v in task.settings.items() if isinstance(v, str | int | float | bool)}}
        block["seconds"] = round(time.monotonic() - began, 3)
        write_json(at / "summary.json", block)
        shown = [r for r in strata if r["place"] <= 20]
        (at / "report.md").write_text(f"# {task.name}\n\n" + (markdown_table(shown, ["field", "bucket", "metric", "n", "mean", "low", "high"]) if shown else ""), encoding="utf-8")
        out["tasks"][task.name] = block
        result.per_query.unpersist()
    write_json(Path(folder) / "summary.json", out)
    write_json(Path(folder) / "manifest.json", run_manifest(evaluation, spark))
    return out
