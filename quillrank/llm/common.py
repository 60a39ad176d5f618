"""Shared pieces: lineage cutting in the shared folder, Arrow text chunks, and vectorised word hashing.

Words are runs of bytes other than ``0x20`` and ``0x09-0x0D``.  Hashes are 64-bit polynomial hashes over random byte
values with a finaliser; they are functions of the bytes alone, so that every executor computes the same ones.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on.  A longer document is a step of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE_VALUES = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 2**64))
_WORD_BASE = _U(0xD6E8FEB86659FD93 | 1)
_WORD_BASE_INV = _U(pow(int(_WORD_BASE), -1, 2**64))
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where that is unset a session of one process takes a folder of its own; a cluster is refused."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not there:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(there)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a table of modest rows in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """As :func:`cut`, for wide tables: compressed Parquet in the shared folder, in folders ``by`` columns; the table and where it is."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def batches_of(docs: DataFrame, batch_bytes: int, text_col: str = "text") -> int:
    """How many batches of documents of about ``batch_bytes`` of text there are: the texts' own bytes, however well they are stored, and
    a little for each row."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string"))), F.count("*")).first()
    return max(1, -(-((size[0] or 0) + 16 * size[1]) // batch_bytes))


def spread(df: DataFrame) -> DataFrame:
    """A small input that would be read in fewer parts than there are cores is dealt out evenly; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_chunks(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each; a longer text is alone in its slice."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        offsets = string_buffers(batch.column(text))[1]
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # workers go on to other stages


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets into them (nulls have no bytes)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


#: Bytes of alphanumeric words: ASCII letters and digits, and all of the longer UTF-8 sequences.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n+1 offsets of each document's words among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= CHUNK_BYTES + 1024:  # a longer document's table is not kept
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64, inverse: np.uint64) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(inverse, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    return _spans_hash(_BYTE_VALUES[data], starts, ends, _BASE, _BASE_INV)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` consecutive word hashes; documents' bounds are the caller's concern."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return _spans_hash(words, at, at + size, _WORD_BASE, _WORD_BASE_INV)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``starts[i] .. starts[i] + lengths[i] - 1``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
