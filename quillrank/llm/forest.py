"""Approximate nearest neighbours by inner product in a forest of hash prefixes.

Every vector gets one long hash string a tree: symbols, each the number and the sign of the largest of some random
projections.  For inner products a vector is first put on a sphere by one more component; queries have zero there.  A tree
is the sorted array of its strings, cut into blocks of about equal numbers of rows; equal strings that fill blocks are dealt over them.
A sorted sample of each tree's strings, whose size grows with the root of the rows, tells how many rows share a prefix.

A query descends in all trees to its longest prefixes and ascends in all of them at once, a symbol at a time, until the rows
below its prefixes reach ``reach`` times the root of all rows.  Prefixes are ranges of the sorted arrays, so it is sent to the blocks
that its ranges touch, and there all rows of the range are scored.  Each block leaves the best of a query, scored again as
a plain sum of products on the original vectors.

Equal vectors are one class with its smallest ids, as many as an answer can hold; queries of one class are one search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ragged, written


@dataclass(frozen=True)
class ForestParams:
    """``faces``: projections of a symbol, a power of two.  ``symbols``: of a string.  ``reach``: candidates of a query, counted in
    every tree, are at least so many times the root of the number of vectors.  ``block_rows``: rows of a block, about.
    ``block_queries``: queries that one copy of a block answers."""

    trees: int = 32
    faces: int = 32
    symbols: int = 8
    reach: float = 50.0
    block_rows: int = 4096
    block_queries: int = 4096
    seed: int = 11

    @property
    def bits(self) -> int:
        return (2 * self.faces - 1).bit_length()

    def need(self, n: int) -> float:
        return self.reach * n**0.5

    def fine(self, n: int) -> int:
        """One of so many vectors is in the sample."""
        return max(1, int(self.need(n) / (4 * self.trees)))


@lru_cache(4)
def _projections(dim: int, params: ForestParams) -> np.ndarray:
    rng = np.random.default_rng([params.seed, dim])
    return rng.normal(size=(dim + 1, params.trees * params.symbols * params.faces)).astype(np.float32)


def strings(x: np.ndarray, last: np.ndarray, params: ForestParams) -> np.ndarray:
    """The hash strings (rows x trees) of unit vectors ``(x, last)``, as integers whose leading bits are the first symbols."""
    out = np.zeros((len(x), params.trees), np.int64)
    for at in range(0, len(x), 256):
        part = np.concatenate([x[at : at + 256], last[at : at + 256, None]], 1).astype(np.float32) @ _projections(x.shape[1], params)
        part = part.reshape(-1, params.trees, params.symbols, params.faces)
        best = np.abs(part).argmax(3)
        sign = np.take_along_axis(part, best[..., None], 3)[..., 0] > 0
        for s in range(params.symbols):
            out[at : at + 256] = out[at : at + 256] << params.bits | (2 * best[:, :, s] + sign[:, :, s])
    return out


@dataclass(frozen=True)
class Directory:
    """What the driver knows of the trees of one length of vectors: rows, the largest norm, and each tree's sorted sample."""

    n: int
    norm: float
    samples: list[np.ndarray]

    def bounds(self, params: ForestParams) -> list[np.ndarray]:
        """First strings of each tree's blocks but the first."""
        per = max(1, params.block_rows // params.fine(self.n))
        return [s[per::per] for s in self.samples]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def _on_sphere(x: np.ndarray, norm: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors: of candidates by the largest norm with one more component, of queries (no norm) by their own."""
    if norm is None:
        return x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))
    x = x / norm
    return x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))


def classes_of(vectors: DataFrame, id_col: str, vec_col: str, every: int, k: int) -> DataFrame:
    """``(c, v, dim, ids, asked)``: distinct vectors with their ``k + 1`` smallest ids and how many of their ids are queries."""
    x = F.transform(F.col(f"`{vec_col}`"), lambda a: a.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("v")).where("id is not null and v is not null")
    wrong = F.exists("v", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == F.lit(float("inf"))))
    rows = rows.where(~wrong & F.exists("v", lambda a: a != 0)).distinct()
    asked = rows.where(F.col("id") % every == 0).groupBy("v").agg(F.countDistinct("id").alias("asked"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    first = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    both = first.join(asked, "v", "left").select("v", F.size("v").alias("dim"), "ids", F.coalesce("asked", F.lit(0)).alias("asked"))
    return both.select(F.monotonically_increasing_id().alias("c"), "*")


def directories(classes: DataFrame, params: ForestParams) -> dict[int, Directory]:
    """The directory of each length of vectors; samples are all that is gathered, a share that shrinks with the root of the rows."""
    length = F.aggregate("v", F.lit(0.0), lambda s, a: s + a * a)
    seen = {r["dim"]: (r["n"], r["norm"] * (1 + 1e-9)) for r in classes.groupBy("dim").agg(F.count("*").alias("n"), F.sqrt(F.max(length)).alias("norm")).collect()}
    out = {}
    for dim, (n, norm) in seen.items():
        def hashed(batches: Iterator[pa.RecordBatch], norm: float = norm) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    keys = strings(*_on_sphere(_matrix(batch.column(0)), norm), params)
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(params.trees), len(keys))), pa.array(keys.ravel())], ["t", "key"])

        some = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("v"), F.lit(params.fine(n))) == 0))
        found = some.select("v").mapInArrow(hashed, "t long, key long").toArrow()
        t, key = found.column("t").to_numpy(), found.column("key").to_numpy()
        out[dim] = Directory(n, norm, [np.sort(key[t == tree]) for tree in range(params.trees)])
    return out


_PLACE = "dim int, t int, b int"


def index_rows(classes: DataFrame, raw, params: ForestParams) -> DataFrame:
    """``(dim, t, b, key, c, first, v)``: every class in each tree, at its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim in np.unique(whole.column(1).to_numpy()).tolist():
                every = whole.filter(pa.array(whole.column(1).to_numpy() == dim))
                own = raw.value[dim]
                bounds = own.bounds(params)
                for at in range(0, every.num_rows, 512):
                    part = every.slice(at, 512)
                    keys = strings(*_on_sphere(_matrix(part.column(2)), own.norm), params)
                    c = part.column(0).to_numpy()
                    b = np.empty(keys.shape, np.int64)
                    for t, edge in enumerate(bounds):
                        low, high = np.searchsorted(edge, keys[:, t], "left"), np.searchsorted(edge, keys[:, t], "right")
                        b[:, t] = low + c % (high - low + 1)
                    n, trees = keys.shape
                    of = pa.array(np.repeat(np.arange(n), trees))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n * trees, dim, np.int32)), pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(b.ravel().astype(np.int32)),
                                                      pa.array(keys.ravel()), part.column(0).take(of), part.column(3).take(of), part.column(2).take(of)], ["dim", "t", "b", "key", "c", "first", "v"])

    rows = classes.select("c", "dim", "v", F.col("ids")[0].alias("first"))
    return rows.mapInArrow(run, f"{_PLACE}, key long, c long, first long, v array<double>")


def planned(asked: DataFrame, raw, params: ForestParams) -> DataFrame:
    """``(dim, t, b, q, low, high)``: the ranges of each asked class after it has ascended, at the blocks that they touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim in np.unique(whole.column(1).to_numpy()).tolist():
                part = whole.filter(pa.array(whole.column(1).to_numpy() == dim))
                own, q = raw.value[dim], part.column(0).to_numpy()
                keys = strings(*_on_sphere(_matrix(part.column(2)), None), params)
                below = np.zeros((params.symbols + 1, len(q)), np.int64)
                for level in range(params.symbols + 1):
                    shift = params.bits * (params.symbols - level)
                    for t, sample in enumerate(own.samples):
                        low = keys[:, t] >> shift << shift
                        below[level] += np.searchsorted(sample, low + (1 << shift), "left") - np.searchsorted(sample, low, "left")
                enough = below * params.fine(own.n) >= params.need(own.n)
                level = np.where(enough.any(0), params.symbols - enough[::-1].argmax(0), 0)
                shift = params.bits * (params.symbols - level)
                for t, edge in enumerate(own.bounds(params)):
                    use = np.flatnonzero((level > 0) | (t == 0))  # the root of any tree holds all rows
                    low = keys[use, t] >> shift[use] << shift[use]
                    high = low + (np.int64(1) << shift[use])
                    first, last = np.searchsorted(edge, low, "left"), np.searchsorted(edge, high - 1, "right")
                    count = last - first + 1
                    of = np.repeat(np.arange(len(use)), count)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), dim, np.int32)), pa.array(np.full(len(of), t, np.int32)), pa.array(ragged(first, count).astype(np.int32)),
                                                      pa.array(q[use][of]), pa.array(low[of]), pa.array(high[of]), part.column(2).take(pa.array(use[of]))], ["dim", "t", "b", "q", "low", "high", "v"])

    return asked.select("c", "dim", "v").mapInArrow(run, f"{_PLACE}, q long, low long, high long, v array<double>")


def best_of(q: np.ndarray, x: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) places of each query's ``k`` highest inner products, ties to the smaller ``first``.

    Scores are plain sums of products, the same wherever a pair meets."""
    rough = q @ x.T
    slack = 1e-9 * np.linalg.norm(q, axis=1) * np.sqrt((x * x).sum(1).max())
    least = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(q), -np.inf)
    i, j = np.nonzero(rough >= (least - slack)[:, None])
    score = np.concatenate([(q[i[a : a + 8192]] * x[j[a : a + 8192]]).sum(1) for a in range(0, len(i), 8192)])
    order = np.lexsort((first[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i, "left")
    return i[place < k], j[place < k], score[place < k]


def nearest(vectors: DataFrame, params: ForestParams = ForestParams(), id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``k`` nearest rows found, nearest first, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another id than the query's.  Null and
    zero vectors, null or non-finite components and null ids take no part; vectors meet those of equal length only.  A
    repeated row counts once; a query id with several vectors is asked by the first by components; other ids may be found once for each
    of theirs.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    classes, _ = written(classes_of(vectors, id_col, vec_col, every, k))
    raw = spark.sparkContext.broadcast(directories(classes, params))
    plan, _ = written(planned(classes.where("asked > 0"), raw, params))
    # A block that many queries reach is copied, so that each copy answers a bounded number.
    crowded = plan.groupBy("dim", "t", "b").count().select("dim", "t", "b", F.ceil(F.col("count") / params.block_queries).cast("int").alias("parts")).where("parts > 1")
    crowded, _ = written(crowded)
    parts = F.coalesce("parts", F.lit(1))
    asked = plan.join(crowded, ["dim", "t", "b"], "left").withColumn("part", F.pmod(F.xxhash64("q"), parts).cast("int")).drop("parts")
    rows = index_rows(classes, raw, params).join(crowded, ["dim", "t", "b"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")

    def search(queries: pa.Table, index: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and index.num_rows:
            index = index.sort_by("key")
            key, c, first, x = index.column("key").to_numpy(), index.column("c").to_numpy(), index.column("first").to_numpy(), _matrix(index.column("v"))
            low, high, q, v = queries.column("low").to_numpy(), queries.column("high").to_numpy(), queries.column("q").to_numpy(), _matrix(queries.column("v"))
            order = np.lexsort((high, low))
            for own in np.split(order, np.flatnonzero((np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)) + 1):
                a, b = np.searchsorted(key, low[own[0]], "left"), np.searchsorted(key, high[own[0]], "left")
                if b > a:
                    for at in range(0, len(own), 256):
                        some = own[at : at + 256]
                        i, j, score = best_of(v[some], x[a:b], first[a:b], k + 1)
                        out.append((q[some][i], c[a:b][j], first[a:b][j], score))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table([pa.array(x) for x in columns], ["q", "c", "first", "score"])

    found = asked.groupBy("dim", "t", "b", "part").cogroup(rows.groupBy("dim", "t", "b", "part")).applyInArrow(search, "q long, c long, first long, score double")
    found = found.repartition("q").dropDuplicates(["q", "c"])
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first"))).where(F.col("place") <= k + 1)
    best = best.select("q", "c", "score").join(classes.select("c", "ids"), "c")
    pairs = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id")))
    pool = best.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list(pairs))), 1, 2 * k + 2).alias("pool"))
    # Queries with their classes; a class with very many is dealt over parts.
    x = F.transform(F.col(f"`{vec_col}`"), lambda a: a.cast("double"))
    ids = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("v")).where(F.col("id") % every == 0)
    ids = ids.join(classes.where("asked > 0").select("v", "c", "asked"), "v").groupBy("id").agg(F.min(F.struct("v", "c", "asked")).alias("one"))
    parts = F.ceil(F.col("asked") / 100_000).cast("int")
    ids = ids.select(F.col("id").alias("query_id"), F.col("one.c").alias("q"), F.col("one.asked").alias("asked")).withColumn("part", F.pmod(F.xxhash64("query_id"), parts).cast("int")).drop("asked")
    pool = pool.join(classes.select(F.col("c").alias("q"), "asked"), "q").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("asked")
    answers = ids.join(pool, ["q", "part"])
    kept = F.slice(F.filter("pool", lambda p: p["id"] != F.col("query_id")), 1, k)
    answers = answers.select("query_id", F.posexplode(kept).alias("at", "p"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("p.id").alias("vec_id"), (F.lit(0.0) - F.col("p.s")).alias("score"))
