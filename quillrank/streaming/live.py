"""Extension: documents or queries that arrive as streams, against a static other side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillrank.operators.ranking import Bm25Params, idf, numbered_postings, query_terms, top_k


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def frozen_index(docs: DataFrame, params: Bm25Params = Bm25Params()) -> DataFrame:
    """``(term, row, doc_id, w)``: each posting with its finished BM25 weight, for joins with streams of queries; ``row`` keeps
    documents that share an id apart."""
    postings, stats = numbered_postings(docs, params)
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    rated = postings.join(df, "term").crossJoin(F.broadcast(stats))  # one row of stats
    norm = F.when(F.col("avg_len") > 0, F.col("dl") / F.col("avg_len")).otherwise(F.lit(0.0))
    w = idf(F.col("df"), F.col("n")) * F.col("tf") * (params.k1 + 1) / (F.col("tf") + params.k1 * (1 - params.b + params.b * norm))
    return rated.select("term", "row", "doc_id", w.alias("w"))


def answer_stream(queries: DataFrame, index: DataFrame, sink: str, checkpoint: str, k: int = 10, params: Bm25Params = Bm25Params()):
    """Ranks each micro-batch of ``queries(query_id, text)`` against the index and appends to Parquet at ``sink``.

    A batch is written under its own number, so that a repeated batch replaces itself.
    """
    def answer(batch: DataFrame, number: int) -> None:
        scores = query_terms(batch, params).join(index, "term").groupBy("query_id", "row", "doc_id").agg(F.round(F.sum("w"), 9).alias("score")).drop("row")
        top_k(scores, k, ["query_id"]).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events of each kind in tumbling windows, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
