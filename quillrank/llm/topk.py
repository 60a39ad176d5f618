"""Exact top-k by integer inner product: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz pruning.

Vectors become ``floor(256 x)`` integers.  The rows of largest norm, a fixed number, give each query a lower bound of
its k-th score.  All rows are then put into ranges of descending norm, and a range is dealt evenly to groups.  A query visits
the ranges whose largest norm can reach its bound; blocks hold queries that reach equally far, and a vector is
sent to the blocks that reach its range.  A group walks its vectors by descending norm in steps and
leaves off a query once ``|q||x|`` is below its bound; within a step the leading coordinates after rotation
by the right singular vectors are multiplied first, and only vectors whose partial sum plus the product of the residual
norms reaches the bound are scored in full, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Candidates in a group, queries in a block, and vectors that one step of a group's walk takes.
GROUP_ROWS, QUERY_BLOCK, STEP = 8192, 4096, 1024
LEADING = 16
#: Ranges of norms, and bytes of the largest vectors that every worker holds for the bounds.
RANGES, HEAD_BYTES = 64, 32 << 20


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v array<long>, norm2, dim)``; null vectors and null or non-finite components take no part."""
    x = F.col(vec_col)
    fine = x.isNotNull() & ~F.exists(x, lambda a: a.isNull() | F.isnan(a) | (F.abs(a.cast("double")) == F.lit(float("inf"))))
    rows = vectors.where(fine & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda a: F.floor(a.cast("double") * 256)).alias("v"))
    return rows.select("vec_id", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda s, a: s + a.cast("double") * a.cast("double")).alias("norm2"))


def _rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows of ``dim`` components, from their d x d Gram matrix summed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, dim).astype(np.float64)
                gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(gram.ravel())], ["i", "g"])

    sums = rows.where(F.col("dim") == dim).select("v").mapInArrow(run, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
    gram = np.zeros(dim * dim)
    for r in sums:
        gram[r["i"]] = r["g"]
    gram = gram.reshape(dim, dim)
    if not np.isfinite(gram).all():
        return np.eye(dim)
    _, basis = np.linalg.eigh((gram + gram.T) / 2)
    return np.ascontiguousarray(basis[:, ::-1])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; through floats where all sums stay below 2^53."""
    if not x.size or not q.size:
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0**52:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def search_group(qid: np.ndarray, q: np.ndarray, bound: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, basis: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's k best in one group that hold at least its bound.

    ``bound`` is a known k-th score or the least long.  ``x`` is walked by descending norm.
    """
    xf, qf = x.astype(np.float64), q.astype(np.float64)
    norm, qnorm = np.sqrt((xf * xf).sum(1)), np.sqrt((qf * qf).sum(1))
    order = np.argsort(-norm, kind="stable")
    x, xf, ids, norm = x[order], xf[order], ids[order], norm[order]
    lead = min(LEADING, x.shape[1])
    if basis is not None:
        xr, qr = xf @ basis, qf @ basis
        xrest = np.sqrt(np.maximum((xr[:, lead:] ** 2).sum(1), 0))
        qrest = np.sqrt(np.maximum((qr[:, lead:] ** 2).sum(1), 0))
    live, kept = bound.astype(np.float64), [[] for _ in qid]
    best: list[np.ndarray] = [np.zeros(0, np.int64) for _ in qid]
    for at in range(0, len(x), STEP):
        end = min(len(x), at + STEP)
        slack = 1e-9 * qnorm * norm[at] + 1e-6
        walk = np.flatnonzero(qnorm * norm[at] + slack >= live)
        if not len(walk):
            break
        if basis is not None and at:
            part = qr[walk, :lead] @ xr[at:end, :lead].T
            part += qrest[walk, None] * xrest[None, at:end] + slack[walk, None]
            reach = part >= live[walk, None]
        else:
            reach = np.ones((len(walk), end - at), bool)
        columns = np.flatnonzero(reach.any(0))
        if not len(columns):
            continue
        scores = _exact(q[walk], x[at:end][columns])
        reach = reach[:, columns]
        for i, w in enumerate(walk):
            ok = np.flatnonzero(reach[i] & (scores[i] >= bound[w]) & (ids[at:end][columns] != qid[w]))
            if not len(ok):
                continue
            s = np.concatenate([best[w], scores[i, ok]])
            v = np.concatenate([kept[w], ids[at:end][columns][ok]]).astype(np.int64)
            top = _best(s, v, k)
            best[w], kept[w] = s[top], v[top]
            if len(top) == k:
                live[w] = max(live[w], float(s[top[-1]]))
    sizes = [len(b) for b in best]
    if not sum(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.repeat(qid, sizes), np.concatenate(kept).astype(np.int64), np.concatenate(best).astype(np.int64)


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` best rows (all, if fewer), ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another id than the query's.
    Null vectors, null or non-finite components and null ids take no part; vectors are scored against those of equal
    length only.  A repeated row stays a candidate of its own; a repeated query id is answered once (its first row by
    components).  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = cut(integer_vectors(vectors, id_col, vec_col))
    dims = [(r["dim"], r["n"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()]
    main = dims[0][0] if dims else 0
    total = sum(n for _, n in dims)
    basis = _rotation(rows, main) if main else None
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    head = rows.where(F.col("dim") == main).orderBy(F.desc("norm2"), "vec_id").limit(max(k + 1, min(4 * STEP, HEAD_BYTES // (8 * max(1, main))))).select("vec_id", "v").toPandas()
    schema = "query_id long, vec_id long, score long"
    least = np.iinfo(np.int64).min

    def unpack(p: pd.Series) -> np.ndarray:
        return np.array(p.tolist(), np.int64).reshape(len(p), -1 if len(p) else 0)

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if not len(left) or not len(right):  # a side without rows comes without columns
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        for dim, q in left.groupby("dim"):
            x = right[right["x_dim"] == dim]
            if len(x) and len(q):
                got = search_group(q["vec_id"].to_numpy(np.int64), unpack(q["v"]), q["bound"].to_numpy(np.int64), x["x_id"].to_numpy(np.int64), unpack(x["x"]), k, basis if dim == main else None)
                out.append(pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got))))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})

    def lower(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries with a lower bound of their k-th score."""
        head_ids, head_x = head["vec_id"].to_numpy(np.int64), unpack(head["v"])
        for frame in frames:
            for at in range(0, len(frame), STEP):
                part = frame.iloc[at : at + STEP]
                bound = np.full(len(part), least)
                own = np.flatnonzero((part["dim"] == main).to_numpy())
                if len(own) and len(head_ids):
                    ids = part["vec_id"].to_numpy(np.int64)[own]
                    found, _, scores = search_group(ids, unpack(part["v"].iloc[own]), bound[own], head_ids, head_x, k, basis)
                    ends = pd.Series(scores).groupby(found).agg(["min", "size"])
                    bound[own] = ends["min"].where(ends["size"] >= k, least).reindex(ids, fill_value=least).to_numpy(np.int64)
                yield part.assign(bound=bound)

    # Ranges by descending norm; at most RANGES edges, largest norms and counts are known to the driver.
    norm = F.col("norm2")
    n_ranges = min(RANGES, max(1, -(-total // GROUP_ROWS)))
    edges = rows.agg(F.percentile_approx(norm, [i / n_ranges for i in range(1, n_ranges)], 10_000)).first()[0] if n_ranges > 1 and total else []
    edges = F.array(*[F.lit(e) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    ranged = rows.withColumn("r", F.size(F.filter(edges, lambda e: e > norm)))
    seen = ranged.groupBy("r").agg(F.count("*").alias("n"), F.max("norm2").alias("most")).orderBy("r").collect()
    subs = {x["r"]: -(-x["n"] // GROUP_ROWS) for x in seen}
    starts = dict(zip(subs, np.cumsum([0, *subs.values()]).tolist()))
    ends = [starts[r] + subs[r] for r in subs] or [1]

    def listed(values: list[int]):
        return F.array(*[F.lit(int(x)) for x in values])

    most = F.array(*[F.lit(float(x["most"])) for x in seen]) if seen else F.array().cast("array<double>")
    length = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    reach = F.size(F.filter(most, lambda x: F.sqrt(F.col("q2") * x) * (1 + 1e-9) + 1e-6 >= F.col("bound").cast("double")))
    bounded = queries.select("vec_id", "v", F.size("v").alias("dim")).mapInPandas(lower, "vec_id long, v array<long>, dim int, bound long")
    bounded = cut(bounded.withColumn("q2", length).withColumn("reach", F.greatest(reach, F.lit(1))).drop("q2"))
    # Blocks of queries that reach equally far, the farthest first.
    far = {x["reach"]: -(-x["n"] // QUERY_BLOCK) for x in bounded.groupBy("reach").agg(F.count("*").alias("n")).orderBy(F.desc("reach")).collect()}
    blocks = dict(zip(far, np.cumsum([0, *far.values()]).tolist()))
    reaches = range(1, max(len(seen), 1) + 1)
    first_block, block_count = listed([blocks.get(m, 0) for m in reaches]), listed([far.get(m, 1) for m in reaches])
    visiting = listed([sum(n for m, n in far.items() if m > place) for place in range(max(len(seen), 1))])  # blocks that reach a range
    place = listed([list(subs).index(r) if r in subs else 0 for r in range(max(subs, default=0) + 1)])
    deal = F.xxhash64("vec_id", "v")
    at = F.element_at(place, F.col("r") + 1) + 1
    group = F.element_at(listed([starts[r] for r in subs] or [0]), F.col("at")) + F.pmod(deal, F.element_at(listed([*subs.values()] or [1]), F.col("at"))).cast("int")
    cand = ranged.withColumn("at", at).withColumn("n_blocks", F.element_at(visiting, F.col("at"))).where("n_blocks > 0")
    cand = cand.select(F.col("vec_id").alias("x_id"), F.col("v").alias("x"), F.col("dim").alias("x_dim"), group.alias("g"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("b"))
    block = F.element_at(first_block, F.col("reach")) + F.pmod(F.xxhash64("vec_id"), F.element_at(block_count, F.col("reach"))).cast("int")
    asked = bounded.select("vec_id", "v", "dim", "bound", block.alias("b"), F.explode(F.sequence(F.lit(0), F.element_at(listed(ends), F.col("reach")) - 1)).alias("g"))
    found = asked.groupBy("b", "g").cogroup(cand.groupBy("b", "g")).applyInPandas(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
