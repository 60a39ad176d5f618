"""Ranking metrics: per query, then means over the queries that have a judgement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.operators.statistics import bootstrap_intervals


def per_query_metrics(queries: DataFrame, ranked: DataFrame, qrels: DataFrame, judged: DataFrame | None = None, ndcg_k: int = 10, mrr_k: int = 10, recall_k: int = 20) -> DataFrame:
    """``(query_id, has_qrel, ndcg, mrr, recall, unjudged_in_top)`` of every query.

    ``ranked(query_id, doc_id, rank)``, ``qrels(query_id, doc_id, grade)``; grades of zero or less do not count.  The ideal
    has all positive grades, whether or not their documents were indexed.  A document ranked twice gains twice in nDCG and
    counts once in recall.  A document is judged if ``judged(doc_id)`` has it or it is relevant to the query.
    """
    grades = qrels.where("grade > 0").select("query_id", "doc_id", F.col("grade").cast("double").alias("grade"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))
    ideal = grades.withColumn("place", place).groupBy("query_id").agg(
        F.sum(F.when(F.col("place") <= ndcg_k, F.col("grade") / F.log2(F.col("place") + 1.0))).alias("ideal"), F.count_distinct("doc_id").alias("relevant"))
    hits = ranked.select("query_id", "doc_id", "rank").join(grades, ["query_id", "doc_id"], "left")
    if judged is None:
        hits = hits.withColumn("known", F.lit(True))
    else:
        hits = hits.join(judged.select("doc_id", F.lit(True).alias("known")).distinct(), "doc_id", "left")
    found = hits.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= ndcg_k, F.coalesce("grade", F.lit(0.0)) / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.min(F.when((F.col("rank") <= mrr_k) & F.col("grade").isNotNull(), F.col("rank"))).alias("first"),
        F.count_distinct(F.when((F.col("rank") <= recall_k) & F.col("grade").isNotNull(), F.col("doc_id"))).alias("hit"),
        F.count_if((F.col("rank") <= ndcg_k) & F.col("known").isNull() & F.col("grade").isNull()).alias("unjudged_in_top"))
    rows = queries.select("query_id").join(ideal, "query_id", "left").join(found, "query_id", "left")
    return rows.select(
        "query_id", F.col("relevant").isNotNull().alias("has_qrel"),
        F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("relevant") > 0, F.coalesce("hit", F.lit(0)) / F.col("relevant")).otherwise(0.0).alias("recall"),
        F.coalesce("unjudged_in_top", F.lit(0)).alias("unjudged_in_top"))


def retrieval_summary(per_query: DataFrame, corpus: DataFrame, judged: DataFrame) -> DataFrame:
    """One row of totals, and of means over the judged queries: four decimals, three for unjudged documents."""
    scored = F.col("has_qrel")

    def mean(name: str, digits: int = 4):
        return F.round(F.coalesce(F.avg(F.when(scored, F.col(name).cast("double"))), F.lit(0.0)), digits)

    rows = per_query.agg(
        F.count("*").alias("queries_total"), F.count_if(scored).alias("queries_scored"), F.count_if(~scored).alias("queries_without_qrel"), mean("ndcg").alias("ndcg"),
        mean("mrr").alias("mrr"), mean("recall").alias("recall"), mean("unjudged_in_top", 3).alias("unjudged_in_top"))
    sizes = corpus.agg(F.count("*").alias("corpus_documents")).crossJoin(judged.agg(F.count_distinct("doc_id").alias("judged_documents")))
    return rows.crossJoin(F.broadcast(sizes))  # one row


def subgroup_report(rows: DataFrame, fields: dict[str, str], metric: str, seen: str | None = None) -> DataFrame:
    """``(field, bucket, n, mean, place)``: each field's strata by size, then by name; a null is the stratum ``None``.

    With ``seen``, a column of numbers that grow in the rows' order, strata of one size follow their first appearance.
    One pass: each row is laid out once a field.  A field all of whose rows are ``other`` is left out.
    """
    from quillrank.functions.text import label

    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), label(F.col(column)).alias("bucket")) for name, column in fields.items()]))
    first = F.col(seen) if seen else F.lit(0)
    groups = rows.select(pairs.alias("at"), F.col(metric).cast("double").alias("m"), first.alias("seen")).groupBy("at.field", "at.bucket").agg(
        F.count("*").alias("n"), F.avg("m").alias("mean"), F.min("seen").alias("seen"))
    by = Window.partitionBy("field")
    groups = groups.withColumn("other", F.min((F.col("bucket") == "other").cast("int")).over(by)).where("other = 0").drop("other")
    return groups.withColumn("place", F.row_number().over(by.orderBy(F.desc("n"), "seen", "bucket"))).drop("seen")


def strata_intervals(rows: DataFrame, fields: dict[str, str], measures: list[str], id_col: str, iterations: int = 1000, confidence: float = 0.95, seed: str = "0") -> DataFrame:
    """``(field, bucket, metric, n, mean, low, high, place)``: the strata of :func:`subgroup_report` with every measure's mean and its
    percentile interval over rows ordered by ``id_col``."""
    from quillrank.functions.text import label

    places = subgroup_report(rows, fields, measures[0]).select("field", "bucket", F.col("place").alias("stratum"))  # rows have places of their own
    at = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), label(F.col(column)).alias("bucket")) for name, column in fields.items()]))
    held = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in measures]))
    laid = rows.select(F.col(id_col).alias("id"), at.alias("at"), *measures).select("id", "at.*", held.alias("held")).select("id", "field", "bucket", "held.*")
    found = bootstrap_intervals(laid.join(places, ["field", "bucket"]), ["field", "bucket", "metric", "stratum"], iterations, confidence, seed)
    return found.select("field", "bucket", "metric", "n", "mean", "low", "high", F.col("stratum").alias("place"))


def mixed_drop(strata: DataFrame, base: str = "ko", mixed: str = "mixed") -> DataFrame:
    """``(field, drop)`` from ``(field, bucket, mean)``: how much less the mixed stratum scores, from means of four decimals."""
    wide = strata.withColumn("mean", F.round("mean", 4)).groupBy("field").pivot("bucket", [base, mixed]).agg(F.first("mean"))
    rows = wide.where(F.col(base).isNotNull() & F.col(mixed).isNotNull() & (F.col(base) != 0))
    return rows.select("field", F.round((F.col(base) - F.col(mixed)) / F.col(base), 4).alias("drop"))
