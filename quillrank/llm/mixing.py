"""Mixing sources to target weights by Poisson replication.

Each row of a source gets a number of copies drawn from a Poisson distribution whose mean is the rate that brings the
source to its target share: ``size * weight / rows``.  The draw inverts the distribution at a uniform number hashed from
seed and row, so it repeats exactly; rows are exploded by their counts and dealt out in the order of another hash.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class MixParams:
    """``weights``: target share of each source; sources that it leaves out get none.  Without it a source's share is in
    proportion to its rows to the power ``alpha``.  ``size``: mean rows of the result, by default as many as come in."""

    weights: Mapping[str, float] | None = None
    alpha: float = 0.5
    size: int | None = None
    seed: int = 17


MAX_RATE = 500
#: Sources up to this many are sent to every executor; more are joined, the larger ones' rows dealt over :data:`SALTS` keys.
BROADCAST_SOURCES = 20_000
SALTS = 64
#: A null source counts as the source of this name.
NO_SOURCE = ""


def uniform(seed: int, what: str, *cols: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of seed, purpose and columns, the same in any SQL engine."""
    text = F.concat_ws("|", F.lit(f"{seed}|{what}"), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def poisson_count(part: Callable[[Column], Column], rate: Column) -> Column:
    """The least k with ``u < P(X <= k)`` for the uniform number ``part(0)``.

    Terms far beyond the mean, below 2^-60 together, are not added.  A rate over :data:`MAX_RATE`, where the first term would
    underflow, is the sum of draws at equal shares of it, each with a number of its own.
    """

    def draw(u: Column, mean: Column) -> Column:
        top = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
        first = F.exp(-mean)
        start = F.struct(first.alias("p"), first.alias("c"), F.when(u < first, 0).cast("int").alias("k"))

        def step(s: Column, i: Column) -> Column:
            p = s["p"] * mean / i.cast("double")
            c = s["c"] + p
            return F.struct(p.alias("p"), c.alias("c"), F.coalesce(s["k"], F.when(u < c, i)).alias("k"))

        return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda s: F.coalesce(s["k"], top))

    parts = F.ceil(rate / MAX_RATE).cast("int")
    many = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda s, j: s + draw(part(j), rate / parts))
    return F.when(rate <= 0, F.lit(0)).when(rate <= MAX_RATE, draw(part(F.lit(0)), rate)).otherwise(many)


def source_rates(docs: DataFrame, params: MixParams, source_col: str = "source") -> DataFrame:
    """``(mix_source, rate)``: the mean repetition of each source's rows."""
    counts = docs.groupBy(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NO_SOURCE)).alias("mix_source")).agg(F.count("*").cast("double").alias("rows"))
    if params.weights is None:
        share = F.pow("rows", F.lit(params.alpha))
    else:
        pairs = [x for k, v in params.weights.items() for x in (F.lit(k), F.lit(float(v)))]
        share = F.coalesce(F.element_at(F.create_map(*pairs), F.col("mix_source")), F.lit(0.0)) if pairs else F.lit(0.0)
    counts = counts.withColumn("share", share)
    total = counts.agg(F.sum("share").alias("all_share"), F.sum("rows").alias("all_rows"))
    size = F.col("all_rows") if params.size is None else F.lit(float(params.size))
    rate = F.when(F.col("all_share") > 0, size * (F.col("share") / F.col("all_share")) / F.col("rows")).otherwise(F.lit(0.0))
    return counts.join(F.broadcast(total), F.lit(True)).select("mix_source", rate.alias("rate"))  # one row of totals


def mix_sources(docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns of ``docs`` with ``copy`` (from 0), ``rate`` and ``mix_key``, in shuffled order.

    Rows are drawn by their id (null as the text ``null``), so rows with the same id in one source have the same number of
    copies.  A null source is a source of its own.  Partitions and the rows in them are in hash order, which no property of
    a row but its id sets.  Texts are not looked at, so null, empty and very long ones pass through.  An empty table gives no
    rows.  Columns named ``copy``, ``rate`` or ``mix_key`` are replaced; all others pass through, whatever their names.
    """
    rates = cut(source_rates(docs, params, source_col))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    id_col, source_col = names[id_col], names[source_col]
    keyed = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()])
    names = {c: a for c, a in names.items() if c.lower() not in ("copy", "rate", "mix_key")}
    keyed = keyed.withColumn("row_source", F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)))
    if rates.count() <= BROADCAST_SOURCES:
        drawn = keyed.join(F.broadcast(rates), F.col("row_source") == F.col("mix_source"))
    else:  # a row of any source goes to one of SALTS tasks, by its id
        salted = keyed.withColumn("salt", F.pmod(F.xxhash64(id_col, F.lit(params.seed)), F.lit(SALTS)).cast("int"))
        every = rates.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = salted.join(every, (F.col("row_source") == F.col("mix_source")) & (F.col("salt") == F.col("of_salt")))
    drawn = drawn.withColumn("copies", poisson_count(lambda j: uniform(params.seed, "count", F.col(id_col), j), F.col("rate"))).where("copies > 0")
    out = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    out = out.withColumn("mix_key", uniform(params.seed, "order", F.col(id_col), F.col("copy")))
    return out.repartition(F.col("mix_key")).sortWithinPartitions("mix_key", id_col).select(*[F.col(a).alias(c) for c, a in names.items()], "copy", "rate", "mix_key")
