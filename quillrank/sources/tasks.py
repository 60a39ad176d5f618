"""Evaluation tasks as tables: queries, corpus, judgements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.text import answer_key
from quillrank.sources import schemas
from quillrank.sources.files import numbered_in_order, read_json_lines, read_qrels, union_all


@dataclass(frozen=True)
class TaskTables:
    """``queries(query_id, text, ..)``, ``corpus(doc_id, text)``, ``qrels(query_id, doc_id, grade)``, ``judged(doc_id)``."""

    queries: DataFrame
    corpus: DataFrame
    qrels: DataFrame
    judged: DataFrame


def retrieval_tables(queries: DataFrame, corpora: list[DataFrame], distractors: list[DataFrame], qrels: DataFrame, split: str, text_field: str = "text", split_field: str = "split",
                     id_field: str = "query_id") -> TaskTables:
    """Queries of the split; a corpus of all sources, copies kept, never cut to a split; distractors are in it and unjudged."""
    asked = queries.where(F.col(split_field).cast("string") == split).withColumns({"query_id": F.col(id_field).cast("string"), "text": F.coalesce(F.col(text_field), F.lit(""))})
    parts = [c.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")) for c in (*corpora, *distractors)]
    judged = union_all([c.select(F.col("doc_id").cast("string").alias("doc_id")) for c in corpora]).distinct()
    return TaskTables(asked, union_all(parts), qrels, judged)


def load_retrieval_task(spark: SparkSession, task: dict) -> TaskTables:
    """From a task's configuration: ``queries_path``, ``corpus_paths``, ``unjudged_distractors``, ``qrels_path`` and field names."""
    qrels = read_qrels(spark, task["qrels_path"], task["split"], task.get("relevance_field", "relevance"), task.get("qrels_doc_field", "doc_id"), task.get("qrels_split_field"))

    def corpus(path: str) -> DataFrame:
        rows = read_json_lines(spark, path, schemas.CORPUS if task.get("id_field", "doc_id") == "doc_id" else schemas.SEARCH_CORPUS)
        return rows.select(F.col(task.get("id_field", "doc_id")).alias("doc_id"), F.col(task.get("text_field", "text")).alias("text"))

    return retrieval_tables(read_json_lines(spark, task["queries_path"], schemas.QUERIES), [corpus(p) for p in task["corpus_paths"]], [corpus(p) for p in task.get("unjudged_distractors", [])],
                            qrels, task["split"], task.get("query_text_field", "text"), task.get("query_split_field", "split"), task.get("query_id_field", "query_id"))


def pairs_tables(pairs: DataFrame, split: str, corpus_splits: list[str] | None = None, seq: str = "seq") -> TaskTables:
    """Question-answer pairs ``(record_id, split, question, answer, seq)``: each distinct answer is a document ``doc-n``, numbered
    by first appearance; a question's own answer is relevant.

    Questions need text on both sides.  A question of the split whose answer was not indexed fails the query.
    """
    rows = pairs.withColumns({"q": F.coalesce("question", F.lit("")), "a": F.coalesce("answer", F.lit("")), "k": answer_key(F.col("answer"))})
    indexed = rows.where("k <> ''")
    if corpus_splits:
        indexed = indexed.where(F.col("split").isin(*corpus_splits))
    first = indexed.groupBy("k").agg(F.min(seq).alias("first"), F.min_by("a", seq).alias("text"))
    corpus = numbered_in_order(first, ["first"], "n").select("k", F.format_string("doc-%d", "n").alias("doc_id"), "text")
    asked = rows.where((F.col("split") == split) & (answer_key(F.col("question")) != "") & (F.col("k") != ""))
    linked = asked.join(corpus.select("k", "doc_id"), "k", "left")
    doc = F.when(F.col("doc_id").isNull(), F.raise_error(F.concat(F.lit("answer was not indexed: "), F.col("record_id").cast("string")))).otherwise(F.col("doc_id"))
    qrels = linked.select(F.col("record_id").cast("string").alias("query_id"), doc.alias("doc_id"), F.lit(1.0).alias("grade"))
    queries = asked.withColumns({"query_id": F.col("record_id").cast("string"), "text": F.col("q")}).drop("q", "a", "k")
    documents = corpus.select("doc_id", "text")
    return TaskTables(queries, documents, qrels, documents.select("doc_id"))


def choice_table(questions: DataFrame, split: str) -> DataFrame:
    """``(question_id, text, options, answer_index, ..)`` of the split."""
    rows = questions.where(F.col("split").cast("string") == split)
    return rows.withColumn("text", F.coalesce("query", F.lit("")))
