"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are hashed alphanumeric words in ASCII lower case, their stems, adjacent pairs, and pairs that skip one word,
present or not.
Training walks a bounded sample of labelled rows in one task; per-coordinate rates and the L1 term leave few weights,
which are all that is sent to the executors for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, lower_ascii, mix, span_hashes, string_buffers, text_chunks, word_spans

_PAIR, _SKIP = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
_STEM = np.uint64(0x165667B19E3779F9)
#: Bytes of the stems that stand for inflected forms.
STEMS = (4, 5, 6)


@dataclass(frozen=True)
class FtrlParams:
    """``max_rows`` bounds the labelled rows learnt from: where there are more, a sample by id hash of about that many."""

    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    epochs: int = 8
    max_rows: int = 12_000
    threshold: float = 0.7
    seed: int = 11


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram and skip-gram, in no order."""
    starts, ends, words = word_spans(data, offsets, ALNUM)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lower = lower_ascii(data)
    h = span_hashes(lower, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
    out_d, out_h = [doc], [h]
    for size in STEMS:
        longer = ends - starts > size
        out_d.append(doc[longer])
        out_h.append(mix(span_hashes(lower, starts[longer], starts[longer] + size) ^ _STEM))
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            out_d.append(doc[gap:][same])
            out_h.append(mix(h[:-gap][same] * salt + h[gap:][same]))
    return np.concatenate(out_d), (np.concatenate(out_h) >> np.uint64(64 - bits)).astype(np.int64)


def train_ftrl(rows: list[np.ndarray], labels: np.ndarray, params: FtrlParams) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights) other than zero, and the bias, from each row's distinct buckets."""
    z, n, bias, nb = np.zeros(1 << params.bits), np.zeros(1 << params.bits), 0.0, 0.0
    for _ in range(params.epochs):
        for x, y in zip(rows, labels):
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) > params.l1, -(zx - np.sign(zx) * params.l1) / ((params.beta + root) / params.alpha + params.l2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / params.alpha * w
            n[x] = nx + g * g
            nb += g * g
            bias -= params.alpha * g / (params.beta + np.sqrt(nb))
    at = np.flatnonzero(np.abs(z) > params.l1)
    w = -(z[at] - np.sign(z[at]) * params.l1) / ((params.beta + np.sqrt(n[at])) / params.alpha + params.l2)
    return at, w, float(bias)


def fit(labelled: DataFrame, params: FtrlParams) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from ``(doc_id, text, label)``; labels other than 0 and 1 are left out, no rows give a score of a half."""
    n = labelled.select("doc_id").count()
    share = min(1.0, params.max_rows / max(1, n))
    order = F.xxhash64("doc_id", F.lit(params.seed))
    sample = labelled.select("doc_id", "text", "label", order.alias("o")).where(F.pmod("o", F.lit(1_000_000)) < int(share * 1_000_000) + (share == 1.0))
    bits = params.bits

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, 0):
            doc, bucket = features(*string_buffers(batch.column(0)), bits)
            key = np.unique(doc << bits | bucket)
            counts = np.searchsorted(key, np.arange(batch.num_rows + 1) << bits)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), pa.array((key & ((1 << bits) - 1)).astype(np.int32))), batch.column(1), batch.column(2)], ["x", "label", "o"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            lists = batch.column(0)
            flat, offs = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            rows += [flat[a:b].copy() for a, b in zip(offs[:-1], offs[1:])]
            labels.append(batch.column(1).to_numpy())
        at, w, bias = train_ftrl(rows, np.concatenate(labels) if labels else np.zeros(0), params)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w, bias))], ["i", "w"])

    got = sample.select("text", "label", "o").mapInArrow(extract, "x array<int>, label double, o long").repartition(1).sortWithinPartitions("o", "label", F.size("x")) \
        .select("x", "label").mapInArrow(train, "i long, w double").collect()
    at, w = np.array([r["i"] for r in got], np.int64), np.array([r["w"] for r in got])
    return at[at >= 0], w[at >= 0], float(w[at < 0].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], params: FtrlParams, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as a last column; a null text counts as empty."""
    at, w, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((at, w.astype(np.float64)))  # at most 2^bits pairs
    bits = params.bits
    where = docs.columns.index(text_col)
    kept: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "w" not in kept:
            kept["w"] = np.zeros(1 << bits)
            kept["w"][shared.value[0]] = shared.value[1]
        weights = kept["w"]
        for batch in text_chunks(batches, where):
            doc, bucket = features(*string_buffers(batch.column(where)), bits)
            hit = weights[bucket] != 0
            key = np.unique(doc[hit] << bits | bucket[hit])
            total = np.bincount(key >> bits, weights[key & ((1 << bits) - 1)], batch.num_rows) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], [*batch.schema.names, out])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, label)`` of the rows that may be learnt from."""
    ys = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).select(F.col("doc_id").alias("y_id"), F.col("toxic").cast("double").alias("label"))
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.join(ys, F.col("doc_id") == F.col("y_id")).select("doc_id", "text", "label")


def toxicity_scores(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row.

    Learns from labelled rows whose ``crc32`` of the id as text is not 1 mod 3.  A null text counts as empty and scores as
    the bias alone; a null id is scored and never learnt from; repeated rows are scored each.  Without labels every score
    is a half.  An empty table gives no rows.
    """
    model = fit(labelled_texts(docs, labels, id_col, text_col), params)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return score(rows, model, params).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` below the threshold of :func:`toxicity_scores`, with all their columns, whatever their names.

    Null and empty texts score as the bias alone, null ids are never learnt from, repeated rows are judged alike, long texts
    whole.  Without labels every score is a half, under the threshold, and all rows stay.  An empty table gives no rows.
    """
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in inner.items()])
    model = fit(labelled_texts(docs, labels, id_col, text_col), params)
    kept = score(rows, model, params, inner[text_col], "score").where(F.col("score") < params.threshold)
    return kept.select(*[F.col(a).alias(c) for c, a in inner.items()])
