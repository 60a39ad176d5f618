"""The training-data pipeline: toxicity, near-duplicates, repeated substrings, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each stage's rows as
Parquet to the shared folder and rereads them, so that a lost executor or a restart costs one stage at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.common import shared_dir
from quillrank.llm.mixing import MixParams, mix_sources
from quillrank.llm.pieces import encode_texts
from quillrank.llm.simhash import keep_representatives
from quillrank.llm.substrings import cut_repeats
from quillrank.llm.toxicity import FtrlParams, drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among them, does not reject.

    A null text counts as empty and scores by the bias alone; null ids are never learnt from; a label that is repeated counts each time;
    repeated rows are judged each; an empty table gives no rows."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), FtrlParams())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Null, empty and blank texts are one group; null ids come last; of rows with the smallest id the one with the smallest text stays.
    An empty table gives no rows."""
    return keep_representatives(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that start earlier elsewhere; ``n_chars`` follows the text.

    A null text stays null, with a null ``n_chars``; null ids come after all others; rows of one id are one document; an empty table gives no rows."""
    return cut_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target shares, in shuffled order.

    A null source is a source of its own; rows are drawn by their id, so repeated rows share their number of copies; an empty table gives no rows."""
    return mix_sources(docs, MixParams()).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_ids)`` of every document; null and empty texts have no ids, repeated rows are encoded each, an empty table gives no rows."""
    return encode_texts(docs).withColumn("n_ids", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("simhash near-dedup", near_duplicates), ("substring dedup", substrings), ("source mixing", mixing), ("sentencepiece", pieces)]

#: Learnt weights, connected components and piece merges are beyond SQL; tests hold the rows against plain loops.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
