"""Comparison of models on the same queries: evidence checks, exact metrics, selection, pairs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.operators.statistics import discordant_pairs, paired_bootstrap


class EvidenceError(Exception):
    """All that is wrong with the evidence, together."""

    def __init__(self, issues: list[str]):
        super().__init__("; ".join(issues))
        self.issues = issues


def evidence_violations(evidence: DataFrame, models: list[str]) -> DataFrame:
    """``(model_key, rule, detail)`` from ``(model_key, query_id, ..)``: unknown and missing models, repeated ids, and ids
    that not every model has."""
    spark = evidence.sparkSession
    expected = spark.createDataFrame([(m,) for m in models], "model_key string")  # the list of the configuration
    there = evidence.select("model_key").distinct()
    unknown = there.join(expected, "model_key", "left_anti").select("model_key", F.lit("unknown_model").alias("rule"), F.lit("").alias("detail"))
    missing = expected.join(there, "model_key", "left_anti").select("model_key", F.lit("missing_model").alias("rule"), F.lit("").alias("detail"))
    counts = evidence.groupBy("model_key", "query_id").agg(F.count("*").alias("n"))
    repeated = counts.where("n > 1").select("model_key", F.lit("repeated_id").alias("rule"), F.col("query_id").cast("string").alias("detail"))
    have = counts.groupBy("query_id").agg(F.collect_set("model_key").alias("have"))  # at most as many as there are models
    gaps = have.select("query_id", F.explode(F.array_except(F.array(*[F.lit(m) for m in models]), "have")).alias("model_key"))
    absent = gaps.select("model_key", F.lit("missing_id").alias("rule"), F.col("query_id").cast("string").alias("detail"))
    return unknown.unionByName(missing).unionByName(repeated).unionByName(absent)


def require_evidence(evidence: DataFrame, models: list[str], named: int = 1000) -> None:
    """Fails with every rule that a model breaks.  ``named`` ids of each are listed, and where there are more, their number;
    all rows are those of :func:`evidence_violations`."""
    of = Window.partitionBy("model_key", "rule")
    found = evidence_violations(evidence, models).withColumns({"n": F.count("*").over(of), "place": F.row_number().over(of.orderBy("detail"))})
    issues = []
    for r in found.where(F.col("place") <= named).orderBy("rule", "model_key", "place").collect():
        issues.append(f"{r['model_key']}: {r['rule']} {r['detail']}".strip())
        if r["place"] == named < r["n"]:
            issues.append(f"{r['model_key']}: {r['rule']}: {r['n']} in all, {named} listed")
    if issues:
        raise EvidenceError(issues)


def summary_issues(summaries: dict[str, dict], contract: dict, licenses: dict[str, str] | None = None, forbidden: list[tuple[str, float]] | None = None, tolerance: float = 1e-9) -> list[str]:
    """What is wrong with the models' summary files, all of it: frozen fields that differ from the contract, licence labels,
    step counts that do not agree, and values known to be wrong."""
    issues = []
    for key, summary in sorted(summaries.items()):
        if summary.get("model_key") != key:
            issues.append(f"{key}: model_key is {summary.get('model_key')!r}")
        frozen = summary.get("frozen_contract", {})
        issues += [f"{key}: frozen {name} is {frozen.get(name)!r}, not {value!r}" for name, value in sorted(contract.items()) if frozen.get(name) != value]
        steps = {name: summary.get("training", {}).get(name) for name in ("planned_steps", "completed_steps", "exported_step") if name in summary.get("training", {})}
        if len(set(steps.values())) > 1:
            issues.append(f"{key}: step counts differ: {steps}")
        if key in (licenses or {}) and summary.get("license_label") != licenses[key]:
            issues.append(f"{key}: license_label is {summary.get('license_label')!r}")
        for path, value in forbidden or []:
            at = summary
            for part in path.split("."):
                at = at.get(part) if isinstance(at, dict) else None
            if isinstance(at, (int, float)) and abs(at - value) <= tolerance:
                issues.append(f"{key}: {path} has the withdrawn value {value}")
    return issues


def exact_metrics(choices: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """``(model_key, questions, correct_count, accuracy, exam_mrr[, passages, ndcg, mrr, recall])``, unrounded."""
    out = choices.groupBy("model_key").agg(F.count("*").alias("questions"), F.count_if("correct").alias("correct_count"), F.avg(F.col("correct").cast("double")).alias("accuracy"),
                                           F.avg("reciprocal_rank").alias("exam_mrr"))
    if passages is None:
        return out
    means = passages.groupBy("model_key").agg(F.count("*").alias("passages"), *[F.avg(c).alias(c) for c in ("ndcg", "mrr", "recall")])
    return out.join(means, "model_key", "left")


def zero_shot_deltas(metrics: DataFrame, baselines: DataFrame, names: list[str]) -> DataFrame:
    """Each metric less its baseline; ``baselines(model_key, <name>)``."""
    base = baselines.select("model_key", *[F.col(n).alias(f"base_{n}") for n in names])
    return metrics.join(base, "model_key").select("model_key", *[(F.col(n) - F.col(f"base_{n}")).alias(f"{n}_delta") for n in names])


def selection(metrics: DataFrame, order: DataFrame, ineligible: list[str], criteria: tuple[str, ...] = ("correct_count", "exam_mrr", "ndcg")) -> DataFrame:
    """``(model_key, eligible, place, tied_on)``: eligible models by the criteria, each descending, then as they were given.

    ``tied_on`` is how many leading criteria a model shares with the one before it.  ``order(model_key, position)``.
    """
    rows = metrics.join(order, "model_key").withColumn("eligible", ~F.col("model_key").isin(*ineligible) if ineligible else F.lit(True))
    w = Window.partitionBy("eligible").orderBy(*[F.desc(c) for c in criteria], "position")  # a row for each model
    same = F.lit(0)
    for c in reversed(criteria):
        same = F.when(F.col(c).eqNullSafe(F.lag(c).over(w)), same + 1).otherwise(F.lit(0))
    rows = rows.withColumns({"place": F.row_number().over(w), "tied_on": F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(same)})
    return rows.select("model_key", "eligible", F.when(F.col("eligible"), F.col("place")).alias("place"), F.when(F.col("eligible"), F.col("tied_on")).alias("tied_on"))


def selection_trace(metrics: DataFrame, order: DataFrame, ineligible: list[str], criteria: tuple[str, ...] = ("correct_count", "exam_mrr", "ndcg")) -> DataFrame:
    """``(step, criterion, best, remaining, model_key)``: how the selection came about, a row for each model that a step leaves.

    Step 0 leaves the eligible models, each further step those of the best value among what the step before left, and the last the
    first as they were given.  ``order(model_key, position)``."""
    left = metrics.join(order, "model_key").where(~F.col("model_key").isin(*ineligible) if ineligible else F.lit(True))
    every = Window.partitionBy(F.lit(0))  # a row for each model
    parts = []
    for step, c in enumerate([None, *criteria, "position"]):
        if c is not None:
            best = F.min(c) if c == "position" else F.max(c)
            left = left.withColumn("_best", best.over(every)).where(F.col(c).eqNullSafe(F.col("_best")))
        value = (F.col("_best") if c else F.lit(None)).cast("double")
        rows = left.withColumn("_n", F.count("*").over(every))
        parts.append(rows.select(F.lit(step).alias("step"), F.lit(c or "eligible").alias("criterion"), value.alias("best"), F.col("_n").cast("int").alias("remaining"), "model_key"))
        left = left.drop("_best")
    return reduce(DataFrame.unionByName, parts)


def wide_pairs(pairs: DataFrame, intervals: DataFrame) -> DataFrame:
    """One row a pair: discordant counts with their p-value, then mean, ends and whether zero is between them for each metric; metrics
    that were not resampled are null."""
    names = [*EXAM_VALUES, *PASSAGE_VALUES]
    cells = {"diff": "mean", "low": "low", "high": "high", "crosses_zero": "crosses_zero"}
    held = intervals.groupBy("model_a", "model_b").agg(*[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{name}") for m in names for name, c in cells.items()])
    counts = pairs.select("model_a", "model_b", (F.col("both") + F.col("only_a") + F.col("only_b") + F.col("neither")).alias("n"), "only_a", "only_b", "p_value")
    return counts.join(held, ["model_a", "model_b"], "left")


def model_pairs(evidence: DataFrame, value: str) -> DataFrame:
    """``(model_a, model_b, id, a, b)`` of every unordered pair of models on the ids that both have."""
    held = evidence.groupBy(F.col("query_id").alias("id")).agg(F.collect_list(F.struct(F.col("model_key").alias("m"), F.col(value).alias("v"))).alias("ms"))  # a query's models
    pair = F.expr("explode(flatten(transform(ms, a -> transform(filter(ms, b -> a.m < b.m), b -> struct(a.m as model_a, b.m as model_b, a.v as a, b.v as b)))))")
    return held.select("id", pair.alias("p")).select("p.model_a", "p.model_b", "id", "p.a", "p.b")


@dataclass(frozen=True)
class Resampling:
    iterations: int = 1000
    confidence: float = 0.95
    seed: str = "0"


def pairwise(choices: DataFrame, resampling: Resampling = Resampling()) -> DataFrame:
    """Discordant pairs with their exact p-value, and the resampled difference of accuracy, for every pair of models."""
    pairs = model_pairs(choices, "correct")
    exact = discordant_pairs(pairs, ["model_a", "model_b"])
    numbers = pairs.select("model_a", "model_b", "id", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    resampled = paired_bootstrap(numbers, ["model_a", "model_b"], resampling.iterations, resampling.confidence, resampling.seed)
    return exact.join(resampled, ["model_a", "model_b"])


#: What pairs of models are resampled on: values of exams, then of passages.
EXAM_VALUES = {"accuracy": "correct", "exam_mrr": "reciprocal_rank"}
PASSAGE_VALUES = {"ndcg": "ndcg", "mrr": "mrr", "recall": "recall"}


def paired_intervals(choices: DataFrame, passages: DataFrame | None = None, resampling: Resampling = Resampling()) -> DataFrame:
    """``(model_a, model_b, metric, n, mean, low, high, crosses_zero)``: the difference of each metric of exams, and of passages
    where they are given, for every pair of models."""
    parts = []
    for evidence, values in ((choices, EXAM_VALUES), (passages, PASSAGE_VALUES)):
        if evidence is None:
            continue
        held = F.array(*[F.col(c).cast("double") for c in values.values()])
        pairs = model_pairs(evidence.select("model_key", "query_id", held.alias("held")), "held")
        at = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col("a")[i].alias("a"), F.col("b")[i].alias("b")) for i, m in enumerate(values)]))
        parts.append(pairs.select("model_a", "model_b", F.col("id").cast("string").alias("id"), at.alias("at")).select("model_a", "model_b", "id", "at.*"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return paired_bootstrap(rows, ["model_a", "model_b", "metric"], resampling.iterations, resampling.confidence, resampling.seed)


def superiority(pairs: DataFrame, winner: str, runner_up: str) -> str:
    """The label of a selection: whether the interval of the two best models' difference excludes zero."""
    row = pairs.where(F.col("model_a").isin(winner, runner_up) & F.col("model_b").isin(winner, runner_up)).first()
    return "superiority established" if row is not None and not row["crosses_zero"] else "superiority not established"
