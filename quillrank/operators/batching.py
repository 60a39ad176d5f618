"""Planning of contrastive batches: quarantine, collision counts, interleaving, packing and its checks."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.text import blake_key, blake_keys, clean_text, normal_key, normal_keys, nul_joined, row_id, stable_key, tokens
from quillrank.operators.packing import OpenBatches
from quillrank.operators.statistics import nearest_rank
from quillrank.sources.files import numbered_in_order

#: Reasons in the order in which they are looked for; the first that holds is given.
REASONS = ("non_train_split", "empty_positive", "missing_option_len_rank", "no_usable_hard_negative")


@dataclass(frozen=True)
class PlanParams:
    batch_size: int = 32
    minimum_batch_size: int = 2
    max_mean_length_gap: float = 50.0
    max_quantile_length_gap: float = 50.0
    seed: str = "plan"
    train_split: str = "train"
    #: Shards that are packed side by side (None: one for each ``shard_rows`` candidates); one gives a single first-fit order.
    shards: int | None = None
    shard_rows: int = 20_000
    #: Seeded orders come from SHA-256 (None) or from BLAKE2b-128 with this personalisation of at most 16 bytes.
    order: str | None = None

    def __post_init__(self):
        if not self.batch_size >= self.minimum_batch_size >= 1:
            raise ValueError("batch_size >= minimum_batch_size >= 1 is asked for")
        if self.max_mean_length_gap < 0 or self.max_quantile_length_gap < 0:
            raise ValueError("length gaps cannot be negative")
        if self.shards is not None and self.shards < 1 or self.shard_rows < 1:
            raise ValueError("shards and their rows must be at least 1")


def classify(triplets: DataFrame, params: PlanParams = PlanParams()) -> DataFrame:
    """All triplets cleaned, with ``reason`` (null: a candidate) and ``negatives``, the usable ones in their order.

    ``triplets(source, seq, triplet_id, question_id, split, query, positive, hard_negatives, option_len_rank)``.  A negative
    is usable if its key is not empty, not the positive's and not that of an earlier one.
    """
    rows = triplets.select(
        row_id(F.col("source"), F.col("seq"), F.col("triplet_id"), F.col("question_id")).alias("record_id"), "source", "split", clean_text(F.col("query")).alias("query"),
        clean_text(F.col("positive")).alias("positive"), normal_key(F.col("positive")).alias("positive_key"), F.coalesce("hard_negatives", F.array().cast("array<string>")).alias("texts"),
        normal_keys(F.col("hard_negatives")).alias("keys"), F.col("option_len_rank").cast("int").alias("option_len_rank"))
    usable = F.expr("""transform(filter(transform(texts, (t, i) -> struct(trim(regexp_replace(coalesce(t, ''), '(?U)[\\\\s\\\\x1c-\\\\x1f]+', ' ')) as text, keys[i] as key, i as i)),
        n -> n.key <> '' and n.key <> positive_key and array_position(keys, n.key) = n.i + 1), n -> struct(n.text as text, n.key as key))""")
    rows = rows.withColumn("negatives", usable).drop("texts", "keys")
    reason = (F.when(~F.col("split").eqNullSafe(F.lit(params.train_split)), REASONS[0]).when(F.col("positive_key") == "", REASONS[1])
              .when(F.col("option_len_rank").isNull(), REASONS[2]).when(F.size("negatives") == 0, REASONS[3]))
    return rows.withColumn("reason", reason)


def quarantine_counts(classified: DataFrame) -> DataFrame:
    return classified.where("reason is not null").groupBy("reason").agg(F.count("*").alias("rows"))


def collision_pairs(candidates: DataFrame) -> DataFrame:
    """One row: how often a usable negative of one row is the positive of another, over all pairs."""
    positives = candidates.groupBy("positive_key").agg(F.count("*").alias("times"))
    asked = candidates.select(F.explode("negatives.key").alias("positive_key")).groupBy("positive_key").agg(F.count("*").alias("uses"))
    return asked.join(positives, "positive_key").agg(F.coalesce(F.sum(F.col("uses") * F.col("times")), F.lit(0)).cast("long").alias("collision_pairs"))


def round_robin(candidates: DataFrame, seed: str, order: str | None = None, within: list[str] | None = None) -> DataFrame:
    """The rows with ``turn`` and ``place``: within each option_len_rank in seeded order, one of each rank a turn.

    ``order`` is a personalisation of BLAKE2b-128 in the place of SHA-256; ``within`` are columns whose values are ordered apart."""
    key = stable_key(seed, F.col("source"), F.col("record_id")) if order is None else blake_key(order, F.lit(seed), F.lit("row"), F.col("record_id"))
    ranked = Window.partitionBy(*(within or []), "option_len_rank").orderBy("_o", "record_id")
    return candidates.withColumn("_o", key).withColumn("turn", F.row_number().over(ranked)).drop("_o")


def negatives_in_order(negatives: Column, record_id: Column, seed: str, order: str | None = None) -> Column:
    """Usable negatives in seeded order, ties by key."""
    if order is None:
        keys = F.transform(negatives, lambda n: stable_key(seed, record_id, n["key"]))
    else:
        keys = blake_keys(order, F.transform(negatives, lambda n: nul_joined(F.lit(seed), F.lit("negative"), record_id, n["key"])))
    rows = F.zip_with(keys, negatives, lambda o, n: F.struct(o.alias("o"), n["key"].alias("key"), n["text"].alias("text")))
    return F.transform(F.array_sort(rows), lambda n: F.struct(n["key"].alias("key"), n["text"].alias("text")))


def length_statistics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean and median lengths of positives and negatives with their gaps, six decimals."""
    p, n = F.length("positive"), F.length("negative")
    out = rows.groupBy(*by).agg(F.avg(p).alias("pm"), F.avg(n).alias("nm"), F.percentile(p, F.lit(0.5)).alias("pq"), F.percentile(n, F.lit(0.5)).alias("nq"))
    return out.select(*by, F.round("pm", 6).alias("positive_mean"), F.round("nm", 6).alias("negative_mean"), F.round(F.abs(F.col("pm") - F.col("nm")), 6).alias("mean_gap"),
                      F.round("pq", 6).alias("positive_quantile"), F.round("nq", 6).alias("negative_quantile"), F.round(F.abs(F.col("pq") - F.col("nq")), 6).alias("quantile_gap"))


def token_length_statistics(rows: DataFrame, fields: list[str], max_tokens: int, sample: int | None = None, seed: str = "sample", mode: str = "whitespace") -> DataFrame:
    """``(field, rows, mean, p50, p95, p99, longest, over, over_share)`` of the fields' token counts, nearest-rank percentiles.

    With ``sample`` only that many rows count, the first in seeded order of their ``record_id``.
    """
    if sample is not None:
        rows = rows.orderBy(stable_key(seed, F.col("record_id")), "record_id").limit(sample)
    counts = [F.struct(F.lit(c).alias("field"), F.size(tokens(F.col(c), mode)).alias("n")) for c in fields]
    long = rows.select(F.explode(F.array(*counts)).alias("x")).select("x.*")
    over = F.count_if(F.col("n") > max_tokens)
    return long.groupBy("field").agg(
        F.count("*").alias("rows"), F.round(F.avg("n"), 6).alias("mean"), *[nearest_rank("n", p / 100).cast("long").alias(f"p{p}") for p in (50, 95, 99)], F.max("n").cast("long").alias("longest"),
        over.alias("over"), F.round(100.0 * over / F.count("*"), 6).alias("over_percent"))


def token_length_gaps(rows: DataFrame, mode: str = "whitespace") -> DataFrame:
    """One row: mean and percentiles of positive less negative token counts, signs kept."""
    gaps = rows.select((F.size(tokens(F.col("positive"), mode)) - F.size(tokens(F.col("negative"), mode))).alias("n"))
    return gaps.agg(F.count("*").alias("rows"), F.round(F.avg("n"), 6).alias("mean"), *[nearest_rank("n", p / 100).cast("long").alias(f"p{p}") for p in (5, 50, 95)])


_PACKED = "shard int, batch int, place int, record_id string, source string, query string, positive string, positive_key string, negative string, negative_key string, option_len_rank int, reason string"


def pack(candidates: DataFrame, params: PlanParams = PlanParams()) -> DataFrame:
    """First-fit batches without collisions and within the length bounds; ``reason`` says why a row is in none.

    A row goes to the first open batch with room where its positive is neither a positive nor a chosen negative and one of its
    negatives, tried in seeded order, is no positive and keeps the batch within bounds; else it opens a batch.  Batches below
    the minimum are dissolved.  The order of rows decides, so a shard is one task.  Rows are dealt to shards by their id, as many as
    ``shard_rows`` asks for unless ``shards`` says how many; each packs its own rows in their own order, which keeps every rule, and a
    positive that a third of all rows share is dealt like any other.  One shard gives the plan of a single first fit.
    """
    shards = params.shards or max(1, -(-candidates.count() // params.shard_rows))
    rows = candidates.withColumn("shard", F.pmod(F.xxhash64("source", "record_id"), F.lit(shards)).cast("int"))
    rows = round_robin(rows, params.seed, params.order, ["shard"])
    rows = rows.withColumn("tries", negatives_in_order(F.col("negatives"), F.col("record_id"), params.seed, params.order))

    def first_fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["turn", "option_len_rank", "record_id"], kind="stable")
        batches = OpenBatches(params.batch_size, params.max_mean_length_gap, params.max_quantile_length_gap)
        left = [(row, "length_balance_impossible") for row in part.itertuples(index=False) if not batches.add(row, row.positive_key, len(row.positive), list(row.tries))]
        out, number = [], 0
        for batch in batches.batches:
            if len(batch.rows) < params.minimum_batch_size:
                left += [(row, "insufficient_batch_size") for row, _ in batch.rows]
                continue
            out += [(row.shard, number, i, row.record_id, row.source, row.query, row.positive, row.positive_key, n["text"], n["key"], row.option_len_rank, None) for i, (row, n) in enumerate(batch.rows)]
            number += 1
        out += [(row.shard, None, None, row.record_id, row.source, row.query, row.positive, row.positive_key, None, None, row.option_len_rank, why) for row, why in left]
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _PACKED.split(", ")])
        return frame.astype({"batch": "Int32", "place": "Int32"})

    kept = ["shard", "turn", "record_id", "source", "query", "positive", "positive_key", "option_len_rank", "tries"]
    return rows.select(*kept).groupBy("shard").applyInPandas(first_fit, _PACKED)


def plan_rows(packed: DataFrame) -> DataFrame:
    """The batches with ids ``batch-00000000`` in one numbering over all shards, in order."""
    rows = packed.where("batch is not null")
    sizes = rows.groupBy("shard").agg((F.max("batch") + 1).alias("batches"))
    before = sizes.select("shard", (F.sum("batches").over(Window.orderBy("shard")) - F.col("batches")).alias("before"))  # a row for each shard
    numbered = rows.join(F.broadcast(before), "shard").withColumn("number", F.col("before") + F.col("batch"))
    return numbered.select(F.format_string("batch-%08d", "number").alias("batch_id"), "number", "place", "record_id", "source", "query", "positive", "positive_key", "negative", "negative_key", "option_len_rank")


def plan_violations(plan: DataFrame, params: PlanParams) -> DataFrame:
    """One row of counts, all zero for a valid plan."""
    repeats = plan.groupBy("number", "positive_key").count().where("count > 1").agg(F.count("*").alias("repeated_positives"))
    negatives = plan.select("number", F.col("negative_key").alias("positive_key")).distinct()
    crossed = plan.select("number", "positive_key").join(negatives, ["number", "positive_key"], "left_semi").agg(F.count("*").alias("collisions"))
    sizes = plan.groupBy("number").count()
    wrong = sizes.agg(F.count_if((F.col("count") > params.batch_size) | (F.col("count") < params.minimum_batch_size)).alias("wrong_sizes"))
    gaps = length_statistics(plan, ["number"]).agg(
        F.count_if((F.col("mean_gap") > params.max_mean_length_gap) | (F.col("quantile_gap") > params.max_quantile_length_gap)).alias("unbalanced"))
    return repeats.crossJoin(crossed).crossJoin(wrong).crossJoin(gaps)  # one row each


def contiguous_groups(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``(group, first, size, runs)`` of consecutive equal values; more than one run of a group means that it is not contiguous."""
    rows = numbered_in_order(rows.select(group, *[c for c in order if c != group]), order, "at").select(group, "at")
    before = rows.select(F.col(group).alias("before"), (F.col("at") + 1).alias("at"))
    new = ~F.col(group).eqNullSafe(F.col("before")) | (F.col("at") == 1)
    return rows.join(before, "at", "left").groupBy(group).agg(F.min("at").alias("first"), F.count("*").alias("size"), F.count_if(new).alias("runs"))


def group_sizes(rows: DataFrame, group: str, order: list[str]) -> list[int]:
    """Sizes of the groups in order; fails if one is not contiguous."""
    found = contiguous_groups(rows, group, order).orderBy("first").collect()
    broken = [r[group] for r in found if r["runs"] > 1]
    if broken:
        raise ValueError(f"groups are not contiguous: {broken[:5]}")
    return [r["size"] for r in found]


def sampler_order(plan: DataFrame, seed: str, epoch: int) -> DataFrame:
    """The plan with ``step``: whole batches in an order drawn for the epoch, rows inside as they are."""
    batches = plan.select("number").distinct().withColumn("o", stable_key(f"{seed}|{epoch}", F.col("number")))
    steps = numbered_in_order(batches, ["o", "number"], "step").select("number", "step")
    return plan.join(steps, "number")


def mnrl_loss(similarities: DataFrame, scale: float = 20.0) -> DataFrame:
    """``(number, loss)`` from ``(number, query, candidate, cosine, target)``: mean over queries of log-sum-exp minus the target's."""
    rows = similarities.withColumn("s", F.col("cosine") * scale)
    rows = rows.withColumn("top", F.max("s").over(Window.partitionBy("number", "query")))
    per = rows.groupBy("number", "query").agg((F.log(F.sum(F.exp(F.col("s") - F.col("top")))) + F.first("top")).alias("lse"), F.max(F.when(F.col("target"), F.col("s"))).alias("t"))
    return per.groupBy("number").agg(F.avg(F.col("lse") - F.col("t")).alias("loss"))
