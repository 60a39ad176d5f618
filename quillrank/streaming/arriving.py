"""Extension: BM25 over documents that arrive as a stream, with document frequencies and lengths that follow it.

Each micro-batch leaves its postings, its counts of documents by term, and its number and length of documents under its own
number, and a mark once all three are whole.  A batch that is run again replaces itself, so every document counts once whatever fails.
The counts of all batches are summed when they are read; every so many batches the sums by term are written as one table, from
which reading goes on.  Nothing is held between batches but the files, so queries may come from another session.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.text import tokens
from quillrank.operators.ranking import SCORE_DECIMALS, Bm25Params, document_weight, inverse_from_counts, query_terms, top_k
from quillrank.sources.folders import exists, listed, write_text


@dataclass(frozen=True)
class GrowingIndex:
    """``folder``: on any file system that Spark knows.  ``compact_every``: batches between two tables of summed counts."""

    spark: SparkSession
    folder: str
    params: Bm25Params = Bm25Params()
    compact_every: int = 16

    def _numbers(self, part: str) -> list[int]:
        at = f"{self.folder}/{part}"
        return sorted(int(n.rsplit("=", 1)[-1]) for n in listed(self.spark, at)) if exists(self.spark, at) else []

    def last(self) -> int | None:
        """The number of the last whole batch; numbers follow each other."""
        return max(self._numbers("done"), default=None)

    def add(self, batch: DataFrame, number: int) -> None:
        """Takes the documents ``(doc_id, text)`` of one batch in; one that is there already stays as it is."""
        if exists(self.spark, f"{self.folder}/done/{number}"):
            return
        bags = batch.select(F.monotonically_increasing_id().alias("at"), "doc_id", tokens(F.col("text"), self.params.mode, self.params.scripts).alias("ts")).withColumn("dl", F.size("ts").cast("long"))
        rows = bags.select(F.concat_ws("-", F.lit(number), "at").alias("row"), "doc_id", "dl", F.explode("ts").alias("term"))
        postings = rows.groupBy("row", "doc_id", "dl", "term").agg(F.count("*").alias("tf"))
        postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.folder}/postings/batch={number}")
        held = self.spark.read.parquet(f"{self.folder}/postings/batch={number}")
        held.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{self.folder}/terms/batch={number}")
        bags.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).write.mode("overwrite").parquet(f"{self.folder}/stats/batch={number}")
        if (number + 1) % self.compact_every == 0:
            self._terms(number, marked=False).write.mode("overwrite").parquet(f"{self.folder}/summed/upto={number}")
        write_text(self.spark, f"{self.folder}/done/{number}", "")

    def _read(self, part: str, column: str, first: int, last: int) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{part}").parquet(f"{self.folder}/{part}").where(F.col(column).between(first, last))

    def _terms(self, last: int, marked: bool = True) -> DataFrame:
        """``(term, df)`` of all batches up to ``last``."""
        tables = [n for n in self._numbers("summed") if n <= last and (marked or n < last)] if exists(self.spark, f"{self.folder}/summed") else []
        start = max(tables, default=-1)
        parts = self._read("terms", "batch", start + 1, last).select("term", "df")
        if tables:
            parts = parts.unionByName(self._read("summed", "upto", start, start).select("term", "df"))
        return parts.groupBy("term").agg(F.sum("df").alias("df"))

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, doc_id, score, rank)`` of ``queries(query_id, text)`` among all documents of the whole batches, as a BM25 over
        them at once gives it; repeated documents are ranked each.  Without any batch there are no rows."""
        last = self.last()
        if last is None:
            return self.spark.createDataFrame([], "query_id string, doc_id string, score double, rank int")
        asked = query_terms(queries, self.params)
        wanted = asked.select("term").distinct()
        stats = self._read("stats", "batch", 0, last).agg(F.sum("n").alias("n"), F.coalesce(F.sum("dl") / F.sum("n"), F.lit(0.0)).alias("avg_len"))
        weights = inverse_from_counts(self._terms(last).join(wanted, "term", "left_semi"), stats)
        postings = self._read("postings", "batch", 0, last).join(wanted, "term", "left_semi")
        rated = postings.join(weights, "term").crossJoin(F.broadcast(stats)).select("term", "row", "doc_id", document_weight(self.params).alias("w"))  # one row of stats
        scored = asked.join(rated, "term").groupBy("query_id", "row", "doc_id").agg(F.round(F.sum("w"), SCORE_DECIMALS).alias("score")).drop("row").where("score > 0")
        return top_k(scored, k, ["query_id"])


def follow(documents: DataFrame, index: GrowingIndex, checkpoint: str):
    """Starts taking a stream of documents ``(doc_id, text)`` into the index."""
    return documents.writeStream.foreachBatch(index.add).option("checkpointLocation", checkpoint).start()
