"""Resampling intervals, exact tests and percentiles.

Resampling takes its draws from MD5 of seed, iteration and draw, so that any SQL engine gives the same intervals.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.sources.files import numbered_in_order


def interval_places(iterations: int, confidence: float) -> tuple[int, int]:
    """Zero-based places of the two ends among the sorted means."""
    tail = (1 - confidence) / 2
    return max(int(tail * iterations) - 1, 0), min(int((1 - tail) * iterations), iterations - 1)


#: Draws that one vectorised step makes, values of a block, and values that a task holds; a larger group is drawn from in parts.
DRAW_STEP, BLOCK_VALUES, TASK_VALUES = 1 << 14, 1 << 15, 1 << 22
#: Iterations of a task.
TASK_ITERATIONS = 16
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def md5_starts(messages: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of each row of bytes; all rows are of one length."""
    n, size = messages.shape
    blocks = (size + 8) // 64 + 1
    padded = np.zeros((n, 64 * blocks), np.uint8)
    padded[:, :size], padded[:, size] = messages, 0x80
    padded[:, -8:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
    state = [np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    turned = np.empty(n, np.uint32)
    for at in range(blocks):
        words = [np.ascontiguousarray(w) for w in padded[:, 64 * at : 64 * at + 64].view("<u4").T]
        same = [n > 0 and bool((w == w[0]).all()) for w in words]  # most words are the same in all rows
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:
                f, g = (c ^ d) & b ^ d, i
            elif i < 32:
                f, g = (b ^ c) & d ^ c, (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = ~d | b, 7 * i % 16
                f ^= c
            f += a
            if same[g]:
                f += np.uint32((_SINES[i] + int(words[g][0])) % 2**32)
            else:
                f += np.uint32(_SINES[i])
                f += words[g]
            np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=turned)
            f <<= np.uint32(_SHIFTS[i])
            f |= turned
            f += b
            a, d, c, b = d, c, b, f
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    return state[0].byteswap()


def draws(seed: str, iteration: int, first: int, last: int) -> np.ndarray:
    """Numbers for draws ``first`` to ``last - 1`` of an iteration: the first four bytes of the MD5 of ``seed|iteration|draw``.  A draw of n takes the remainder."""
    prefix, out = np.frombuffer(f"{seed}|{iteration}|".encode(), np.uint8), []
    while first < last:
        digits = len(str(first))
        end = min(last, 10**digits)
        message = np.empty((end - first, len(prefix) + digits), np.uint8)
        message[:, : len(prefix)] = prefix
        number = np.arange(first, end)
        for k in range(digits):
            message[:, -1 - k] = number % 10 + 48
            number //= 10
        out.append(md5_starts(message))
        first = end
    return np.concatenate(out).astype(np.int64)


def bootstrap_intervals(values: DataFrame, by: list[str], iterations: int = 1000, confidence: float = 0.95, seed: str = "0") -> DataFrame:
    """``(by.., n, mean, low, high)``: percentile intervals of the mean of ``value``, ordered by ``id`` within each group.

    Groups of one size take the same draws, so they are drawn from together.  Their values travel in blocks to tasks of
    :data:`TASK_ITERATIONS` iterations each; a task makes its own draws and holds at most about :data:`TASK_VALUES` values: many groups are
    dealt to several tasks, and a group of more values is in parts, each summed by the draws that fall into it.  No draw is a row.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    block_values, task_values = BLOCK_VALUES, TASK_VALUES
    rows = numbered_in_order(values.select(key.alias("g"), "id", F.col("value").cast("double").alias("value")), ["g", "id"], "place")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("place").alias("first"))
    sizes = sizes.withColumn("at", F.row_number().over(Window.partitionBy("n").orderBy("g")) - 1)  # a row a group
    team = F.floor(F.col("at") / F.greatest(F.lit(1), F.floor(F.lit(task_values) / F.col("n"))))
    placed = rows.join(sizes.select("g", "n", "at", "first", team.alias("team")), "g").withColumn("place", F.col("place") - F.col("first"))
    blocks = placed.groupBy("n", "at", "team", F.floor(F.col("place") / block_values).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("vs"))
    chunks = F.explode(F.sequence(F.lit(0), F.lit((iterations - 1) // TASK_ITERATIONS))).alias("chunk")
    span = F.floor(F.col("block") / (task_values // block_values)).alias("span")
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.select("n", "at", "team", "block", span, F.col("vs")["value"].alias("vs"), chunks)
    dealt = dealt.repartition(parts, "n", "team", "span", "chunk")  # few rows that cost much: a number given is not coalesced

    def sums(table: pa.Table) -> pa.Table:
        n, chunk, start = table["n"][0].as_py(), table["chunk"][0].as_py(), table["span"][0].as_py() * task_values
        blocks: dict[int, dict[int, pa.Array]] = {}
        for at, block, vs in zip(table["at"].to_pylist(), table["block"].to_pylist(), table["vs"]):
            blocks.setdefault(at, {})[block] = vs.values
        groups = []
        for of in blocks.values():
            vs = pa.chunked_array([of[b] for b in sorted(of)], pa.float64())
            groups.append((vs.fill_null(0.0).to_numpy(), vs.is_valid().to_numpy() if vs.null_count else None))
        its = range(chunk * TASK_ITERATIONS, min(iterations, (chunk + 1) * TASK_ITERATIONS))
        s, c = np.zeros((len(groups), len(its))), np.zeros((len(groups), len(its)), np.int64)
        for k, iteration in enumerate(its):
            for first in range(0, n, DRAW_STEP):
                at = draws(seed, iteration, first, min(n, first + DRAW_STEP)) % n
                if n > task_values:
                    at = at[(at >= start) & (at < start + task_values)] - start
                for j, (vs, known) in enumerate(groups):
                    s[j, k] += vs[at].sum()
                    c[j, k] += len(at) if known is None else int(known[at].sum())
        every = np.repeat(np.array(list(blocks), np.int32), len(its))
        return pa.table({"n": np.full(len(every), n), "at": every, "iteration": np.tile(np.array(its, np.int64), len(groups)), "s": s.ravel(), "c": c.ravel()})

    found = dealt.groupBy("n", "team", "span", "chunk").applyInArrow(sums, "n long, at int, iteration long, s double, c long")
    means = found.groupBy("n", "at", "iteration").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).select("n", "at", F.when(F.col("c") > 0, F.col("s") / F.col("c")).alias("m"))
    low, high = interval_places(iterations, confidence)
    ends = means.groupBy("n", "at").agg(F.sort_array(F.collect_list("m")).alias("ms")).select("n", "at", F.get("ms", F.lit(low)).alias("low"), F.get("ms", F.lit(high)).alias("high"))
    out = sizes.join(ends, ["n", "at"])
    return out.select(*[F.col("g")[c].alias(c) for c in by], "n", "mean", "low", "high")


def paired_bootstrap(pairs: DataFrame, by: list[str], iterations: int = 1000, confidence: float = 0.95, seed: str = "0") -> DataFrame:
    """As :func:`bootstrap_intervals` for the differences ``a - b`` of each ``id``, with ``crosses_zero``, for which ends within
    12 decimals of zero are zero."""
    rows = bootstrap_intervals(pairs.select(*by, "id", (F.col("a").cast("double") - F.col("b").cast("double")).alias("value")), by, iterations, confidence, seed)
    return rows.withColumn("crosses_zero", (F.round("low", 12) <= 0) & (F.round("high", 12) >= 0))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided exact p-value of b and c discordant pairs; summed in logarithms, so no count overflows."""
    n, least = (b + c).cast("double"), F.least(b, c).cast("int")
    start = F.struct((n * F.log(F.lit(0.5))).alias("term"), F.exp(n * F.log(F.lit(0.5))).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i)
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    places = F.when(least >= 1, F.sequence(F.lit(1), F.greatest(least, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when(b + c == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(places, start, step, lambda s: s["sum"])))


def discordant_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``(by.., both, only_a, only_b, neither, p_value)`` from booleans ``a`` and ``b``."""
    a, b = F.col("a"), F.col("b")
    rows = pairs.groupBy(*by).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))
    return rows.withColumn("p_value", mcnemar_p(F.col("only_a"), F.col("only_b")))


def holm(tests: DataFrame, by: list[str], p: str = "p_value") -> DataFrame:
    """Extension: step-down adjusted p-values ``adjusted`` within each family."""
    family = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = family.orderBy(p)
    rows = tests.withColumns({"place": F.row_number().over(order), "tests": F.count("*").over(family)})
    raw = F.least(F.lit(1.0), F.col(p) * (F.col("tests") - F.col("place") + 1))
    running = F.max(raw).over(family.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("adjusted", running).drop("place", "tests")


def linear_percentile(column: str, p: float) -> Column:
    """Interpolated between neighbours; zero without rows."""
    return F.coalesce(F.percentile(column, F.lit(p)), F.lit(0.0))


def nearest_rank(column: str, p: float) -> Column:
    """The value at place ceil(p n)."""
    return F.expr(f"percentile_disc({p}) within group (order by `{column}`)")
