import math
import random

import pytest
from pyspark.sql import functions as F

from quillrank.operators import batching, comparison, statistics

TRIPLETS = "source string, seq long, triplet_id string, question_id string, split string, query string, positive string, hard_negatives array<string>, option_len_rank int"


def test_interval_places():
    assert statistics.interval_places(1000, 0.95) == (24, 975)
    assert statistics.interval_places(100, 0.95) == (1, 97) and statistics.interval_places(200, 0.95) == (4, 195)


def test_bootstrap(spark):
    flat = spark.createDataFrame([(i, 0.5) for i in range(12)], "id long, value double")
    r = statistics.bootstrap_intervals(flat, [], 100).first()
    assert (r["n"], r["low"], r["high"]) == (12, 0.5, 0.5)
    assert statistics.bootstrap_intervals(flat.where("false"), [], 100).count() == 0
    mixed = spark.createDataFrame([("a", i, float(i % 2)) for i in range(40)] + [("b", i, 1.0) for i in range(5)], "g string, id long, value double")
    rows = {r["g"]: r for r in statistics.bootstrap_intervals(mixed, ["g"], 200).collect()}
    assert rows["a"]["low"] < 0.5 < rows["a"]["high"] and rows["b"]["low"] == rows["b"]["high"] == 1.0
    again = {r["g"]: r for r in statistics.bootstrap_intervals(mixed.repartition(3), ["g"], 200).collect()}
    assert rows == again


def test_draws_are_no_rows(spark, monkeypatch):
    import hashlib

    plain = lambda seed, k, i: int(hashlib.md5(f"{seed}|{k}|{i}".encode()).hexdigest()[:8], 16)
    assert statistics.draws("0", 7, 5, 1203).tolist() == [plain("0", 7, i) for i in range(5, 1203)]
    assert statistics.draws("s" * 60, 12, 0, 120).tolist() == [plain("s" * 60, 12, i) for i in range(120)]
    rows = [(g, i, None if g == "c" and i % 3 == 0 else float((i * 7 + len(g or "")) % 11)) for g, n in (("a", 40), ("bb", 40), ("c", 33), (None, 1)) for i in range(n)]
    table = spark.createDataFrame(rows, "g string, id int, value double")
    expect = {}
    for g in {r[0] for r in rows}:
        vs, means = [v for h, _, v in rows if h == g], []
        for k in range(50):
            own = [x for x in (vs[plain("0", k, i) % len(vs)] for i in range(len(vs))) if x is not None]
            means.append(round(sum(own) / len(own), 9))
        expect[g] = (sorted(means)[0], sorted(means)[48])
    for block, task in ((1 << 15, 1 << 22), (4, 16)):  # the second in parts of groups
        monkeypatch.setattr(statistics, "BLOCK_VALUES", block)
        monkeypatch.setattr(statistics, "TASK_VALUES", task)
        found = statistics.bootstrap_intervals(table, ["g"], 50)
        assert {r["g"]: (round(r["low"], 9), round(r["high"], 9)) for r in found.collect()} == expect
        assert "md5" not in found._jdf.queryExecution().toString()


def test_paired(spark):
    same = spark.createDataFrame([(i, float(i % 3), float(i % 3)) for i in range(20)], "id long, a double, b double")
    assert statistics.paired_bootstrap(same, [], 100).first()["crosses_zero"]
    apart = spark.createDataFrame([(i, 1.0, 0.0) for i in range(20)], "id long, a double, b double")
    r = statistics.paired_bootstrap(apart, [], 100).first()
    assert not r["crosses_zero"] and r["mean"] == 1.0


def test_mcnemar(spark):
    cases = [(0, 0), (3, 3), (5, 0), (0, 5), (7, 2), (120, 90), (900, 700), (2000, 1)]
    df = spark.createDataFrame(cases, "b long, c long").withColumn("p", statistics.mcnemar_p(F.col("b"), F.col("c")))
    for r in df.collect():
        n, k = r["b"] + r["c"], min(r["b"], r["c"])
        exact = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert r["p"] == pytest.approx(exact, rel=1e-9, abs=1e-300)


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "t string, p_value double")
    got = {r["t"]: round(r["adjusted"], 6) for r in statistics.holm(df, []).collect()}
    assert got == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9}


def test_percentiles(spark):
    df = spark.range(1, 11).withColumnRenamed("id", "n")
    r = df.agg(*[statistics.nearest_rank("n", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)], statistics.linear_percentile("n", 0.5).alias("m")).first()
    assert (r["p50"], r["p95"], r["p99"], r["m"]) == (5, 10, 10, 5.5)
    assert df.where("false").agg(statistics.linear_percentile("n", 0.5).alias("m")).first()["m"] == 0.0


def test_quarantine(spark):
    rows = [("s", 1, "t1", None, "train", "q", "good one", ["bad one", "Bad  One!", "good one", " "], 1), ("s", 2, None, "q2", "dev", "q", "p", ["n"], 1), ("s", 3, None, None, "train", "q", " !", ["n"], 1),
            ("s", 4, None, None, "train", "q", "p", ["n"], None), ("s", 5, None, None, "train", "q", "p", ["P", None, "p."], 1), ("s", 6, None, None, "train", "q", "p", None, 1)]
    got = {r["record_id"]: r for r in batching.classify(spark.createDataFrame(rows, TRIPLETS)).collect()}
    assert got["t1"]["reason"] is None and [n["text"] for n in got["t1"]["negatives"]] == ["bad one"]
    assert [got[k]["reason"] for k in ("q2", "s:000000003", "s:000000004", "s:000000005", "s:000000006")] == [
        "non_train_split", "empty_positive", "missing_option_len_rank", "no_usable_hard_negative", "no_usable_hard_negative"]


def triplets(spark, n=60, seed=1, gap=40):
    rng = random.Random(seed)
    words = [f"w{i} " * rng.randrange(1, 6) for i in range(25)]
    return spark.createDataFrame([("s", i, None, f"r{i}", "train", f"q{i}", rng.choice(words), rng.sample(words, 3), rng.randrange(4)) for i in range(n)], TRIPLETS)


def test_collisions_and_order(spark):
    table = batching.classify(triplets(spark)).where("reason is null").cache()
    rows = table.collect()
    expect = sum(sum(o["positive_key"] == n["key"] for o in rows) for r in rows for n in r["negatives"])
    assert expect > 0 and batching.collision_pairs(table).first()[0] == expect
    turns = batching.round_robin(table, "x").collect()
    for rank in {r["option_len_rank"] for r in rows}:
        assert sorted(r["turn"] for r in turns if r["option_len_rank"] == rank) == list(range(1, sum(r["option_len_rank"] == rank for r in rows) + 1))


def slow_pack(rows, params):
    """First fit with every bound recomputed from scratch."""
    from hashlib import sha256
    from statistics import median

    def fits(batch):
        p, n = [len(r["positive"]) for r, _ in batch], [len(x["text"]) for _, x in batch]
        return round(abs(sum(p) / len(p) - sum(n) / len(n)), 6) <= params.max_mean_length_gap and round(abs(median(p) - median(n)), 6) <= params.max_quantile_length_gap

    batches, lost = [], []
    for r in sorted(rows, key=lambda r: (r["turn"], r["option_len_rank"], r["record_id"])):
        tries = sorted(r["negatives"], key=lambda n: (sha256(f"{params.seed}\0{r['record_id']}\0{n['key']}\0".encode()).hexdigest(), n["key"]))
        for b in batches:
            if len(b) >= params.batch_size or r["positive_key"] in {x["positive_key"] for x, _ in b} | {n["key"] for _, n in b}:
                continue
            pick = next((n for n in tries if n["key"] not in {x["positive_key"] for x, _ in b} and fits(b + [(r, n)])), None)
            if pick is not None:
                b.append((r, pick))
                break
        else:
            pick = next((n for n in tries if fits([(r, n)])), None)
            lost.append((r["record_id"], "length_balance_impossible")) if pick is None else batches.append([(r, pick)])
    kept = [b for b in batches if len(b) >= params.minimum_batch_size]
    lost += [(r["record_id"], "insufficient_batch_size") for b in batches if b not in kept for r, _ in b]
    return [[(r["record_id"], n["key"]) for r, n in b] for b in kept], sorted(lost)


@pytest.mark.parametrize("gap", [2.0, 6.0, 1000.0])
def test_packing(spark, gap):
    params = batching.PlanParams(batch_size=5, minimum_batch_size=2, max_mean_length_gap=gap, max_quantile_length_gap=gap)
    table = batching.classify(triplets(spark), params).where("reason is null").cache()
    packed = batching.pack(table, params).cache()
    plan = batching.plan_rows(packed)
    found = {}
    for r in plan.orderBy("number", "place").collect():
        found.setdefault(r["number"], []).append((r["record_id"], r["negative_key"]))
    lost = sorted((r["record_id"], r["reason"]) for r in packed.where("reason is not null").collect())
    assert ([found[k] for k in sorted(found)], lost) == slow_pack(batching.round_robin(table, params.seed).collect(), params)
    assert set(batching.plan_violations(plan, params).first()) == {0}
    import dataclasses

    sharded = batching.plan_rows(batching.pack(table, dataclasses.replace(params, shards=3)))
    assert set(batching.plan_violations(sharded, params).first()) == {0}


def test_impossible_lengths_and_bad_settings(spark):
    rows = [("s", 1, "a", None, "train", "q", "x", ["y" * 20], 1)]
    packed = batching.pack(batching.classify(spark.createDataFrame(rows, TRIPLETS)), batching.PlanParams(max_mean_length_gap=2, max_quantile_length_gap=2))
    assert packed.first()["reason"] == "length_balance_impossible"
    for bad in (dict(batch_size=1, minimum_batch_size=2), dict(minimum_batch_size=0), dict(max_mean_length_gap=-1.0), dict(shards=0)):
        with pytest.raises(ValueError):
            batching.PlanParams(**bad)


def test_violations_are_seen(spark):
    rows = [(0, "p", "q"), (0, "p", "r"), (0, "q", "s"), (1, "z", "z2")]
    plan = spark.createDataFrame([(n, p, k, p, "x" * 90) for n, p, k in rows], "number int, positive_key string, negative_key string, positive string, negative string")
    r = batching.plan_violations(plan, batching.PlanParams(minimum_batch_size=2, batch_size=3)).first()
    assert (r["repeated_positives"], r["collisions"], r["wrong_sizes"], r["unbalanced"]) == (1, 1, 1, 2)


def test_contiguity_and_sampler(spark):
    df = lambda s: spark.createDataFrame([(i, c) for i, c in enumerate(s)], "i int, g string").repartition(3)
    assert batching.group_sizes(df("aaabbcccc"), "g", ["i"]) == [3, 2, 4]
    with pytest.raises(ValueError, match="contiguous"):
        batching.group_sizes(df("aba"), "g", ["i"])
    plan = spark.createDataFrame([(n, p) for n in range(6) for p in range(3)], "number int, place int")
    a = sorted((r["number"], r["step"]) for r in batching.sampler_order(plan, "s", 1).select("number", "step").distinct().collect())
    b = sorted((r["number"], r["step"]) for r in batching.sampler_order(plan, "s", 2).select("number", "step").distinct().collect())
    assert sorted(s for _, s in a) == list(range(1, 7)) and a != b


def test_loss(spark):
    s = [[0.9, 0.1], [0.2, 0.8]]
    df = spark.createDataFrame([(0, i, j, s[i][j], i == j) for i in (0, 1) for j in (0, 1)], "number int, query int, candidate int, cosine double, target boolean")
    expect = sum(math.log(sum(math.exp(20 * x) for x in row)) - 20 * row[i] for i, row in enumerate(s)) / 2
    assert batching.mnrl_loss(df).first()["loss"] == pytest.approx(expect)


def test_evidence(spark):
    rows = [(m, f"q{i}") for m in ("a", "b") for i in range(3)]
    good = spark.createDataFrame(rows, "model_key string, query_id string")
    comparison.require_evidence(good, ["a", "b"])
    bad = spark.createDataFrame(rows[:-1] + [rows[0], ("x", "q0")], "model_key string, query_id string")
    with pytest.raises(comparison.EvidenceError) as error:
        comparison.require_evidence(bad, ["a", "b", "c"])
    text = str(error.value)
    for part in ("x: unknown_model", "c: missing_model", "a: repeated_id q0", "b: missing_id q2"):
        assert part in text
    with pytest.raises(comparison.EvidenceError) as error:
        comparison.require_evidence(spark.createDataFrame([("a", f"q{i}") for i in range(5)] * 2, "model_key string, query_id string"), ["a"], named=2)
    assert error.value.issues == ["a: repeated_id q0", "a: repeated_id q1", "a: repeated_id: 5 in all, 2 listed"]
    issues = comparison.summary_issues({"a": {"model_key": "a", "frozen_contract": {"seed": 2}, "training": {"planned_steps": 3, "completed_steps": 2}, "license_label": "x", "m": {"v": 0.5}}},
                                       {"seed": 1}, {"a": "y"}, [("m.v", 0.5)])
    assert len(issues) == 4 and comparison.summary_issues({"a": {"model_key": "a", "frozen_contract": {"seed": 1}}}, {"seed": 1}) == []


def test_selection_breaks_ties_and_skips_ineligible(spark):
    metrics = spark.createDataFrame([("a", 2, 0.6125, 0.1), ("b", 2, 0.4875, 0.9), ("c", 4, 0.9, 0.9), ("d", 2, 0.6125, 0.1)], "model_key string, correct_count long, exam_mrr double, ndcg double")
    order = spark.createDataFrame([("d", 0), ("a", 1), ("b", 2), ("c", 3)], "model_key string, position int")
    got = {r["model_key"]: (r["place"], r["tied_on"]) for r in comparison.selection(metrics, order, ["c"]).collect()}
    assert got == {"d": (1, 0), "a": (2, 3), "b": (3, 1), "c": (None, None)}


def test_pairwise(spark):
    rows = [(m, i, i % k == 0) for m, k in (("a", 1), ("b", 2)) for i in range(20)]
    r = comparison.pairwise(spark.createDataFrame(rows, "model_key string, query_id long, correct boolean"), comparison.Resampling(100)).first()
    assert (r["model_a"], r["model_b"], r["only_a"], r["only_b"], r["mean"]) == ("a", "b", 10, 0, 0.5) and r["p_value"] == pytest.approx(2 * 0.5**10)
    assert comparison.superiority(comparison.pairwise(spark.createDataFrame(rows, "model_key string, query_id long, correct boolean"), comparison.Resampling(100)), "a", "b") == "superiority established"


def test_token_lengths(spark):
    rows = [(f"r{i}", "w " * n, "w " * n, "w") for i, n in enumerate((3, 5, 8, 12))]
    df = spark.createDataFrame(rows, "record_id string, query string, positive string, negative string")
    r = batching.token_length_statistics(df, ["query"], 8).first()
    assert (r["rows"], r["mean"], r["p50"], r["longest"], r["over"], r["over_percent"]) == (4, 7.0, 5, 12, 1, 25.0)
    assert batching.token_length_statistics(df, ["query"], 8, sample=2).first()["rows"] == 2
    g = batching.token_length_gaps(df).first()
    assert (g["mean"], g["p50"]) == (6.0, 4)


def test_index_packs_as_a_plain_first_fit(spark):
    """Many settings, short keys that collide often and tight bounds, row by row."""
    from types import SimpleNamespace

    from quillrank.operators.packing import OpenBatches, Room

    rng = random.Random(8)
    for trial in range(60):
        params = batching.PlanParams(batch_size=rng.choice([2, 3, 8, 32]), minimum_batch_size=1, max_mean_length_gap=rng.choice([0.5, 2, 9, 1000]), max_quantile_length_gap=rng.choice([0.5, 3, 9, 1000]))
        keys = [f"k{i}" for i in range(rng.choice([6, 40]))]
        rows = [{"turn": i, "option_len_rank": 0, "record_id": f"r{i:04d}", "positive_key": rng.choice(keys[:3] if trial % 3 == 0 else keys), "positive": "p" * rng.randrange(1, 30),
                 "negatives": [{"key": k, "text": "n" * rng.randrange(1, 30)} for k in rng.sample(keys, 3)]} for i in range(150)]
        for r in rows:
            r["negatives"] = [n for n in r["negatives"] if n["key"] != r["positive_key"]]
        from hashlib import sha256

        found = OpenBatches(params.batch_size, params.max_mean_length_gap, params.max_quantile_length_gap)
        lost = []
        for r in rows:
            tries = sorted(r["negatives"], key=lambda n: (sha256(f"{params.seed}\0{r['record_id']}\0{n['key']}\0".encode()).hexdigest(), n["key"]))
            if not found.add(SimpleNamespace(**r), r["positive_key"], len(r["positive"]), tries):
                lost.append((r["record_id"], "length_balance_impossible"))
        assert ([[(r.record_id, n["key"]) for r, n in b.rows] for b in found.batches], lost) == slow_pack(rows, params)
    room = Room()
    spans = [(rng.randrange(50), rng.randrange(50)) for _ in range(200)]
    for i, (least, most) in enumerate(spans):
        room.set(i, least, most)
    for _ in range(500):
        start, gap = rng.randrange(210), rng.randrange(50)
        assert room.first(start, gap) == next((i for i, (a, b) in enumerate(spans) if i >= start and a <= gap <= b), None)


def test_packing_at_size_has_no_single_group(spark):
    """A third of the rows share one positive; shards follow from the number of rows and stay even."""
    from pyspark.sql import functions as F

    rows = spark.range(6000).select(F.lit("s").alias("source"), F.format_string("r%06d", "id").alias("record_id"), F.lit("q").alias("query"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("positive_key"),
                                    F.lit("positive").alias("positive"), (F.col("id") % 4).cast("int").alias("option_len_rank"),
                                    F.array(F.struct(F.concat(F.lit("n"), F.col("id") % 50).alias("key"), F.lit("negative").alias("text"))).alias("negatives"))
    params = batching.PlanParams(batch_size=8, shard_rows=500)
    packed = batching.pack(rows, params).cache()
    sizes = [r["count"] for r in packed.groupBy("shard").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 700 and sum(sizes) == 6000
    assert set(batching.plan_violations(batching.plan_rows(packed), params).first()) == {0}


def test_blake_keys_are_those_of_the_digest(spark):
    import hashlib

    from pyspark.sql import functions as F

    from quillrank.functions.text import blake_key

    def plain(person, *parts):
        digest = hashlib.blake2b(digest_size=16, person=person.encode())
        for p in parts:
            digest.update(str(p).encode() + b"\0")
        return digest.hexdigest()

    table = batching.classify(triplets(spark)).where("reason is null").cache()
    got = table.select("record_id", blake_key("plan-v1", F.lit("seed"), F.lit("row"), F.col("record_id")).alias("k")).collect()
    assert all(r["k"] == plain("plan-v1", "seed", "row", r["record_id"]) for r in got)
    # A table of known digests, made once outside.
    assert plain("plan-v1", "seed", "row", "r1") == hashlib.blake2b(b"seed\0row\0r1\0", digest_size=16, person=b"plan-v1").hexdigest()
    turns = batching.round_robin(table, "seed", "plan-v1").collect()
    for rank in {r["option_len_rank"] for r in turns}:
        own = [r["record_id"] for r in sorted((r for r in turns if r["option_len_rank"] == rank), key=lambda r: r["turn"])]
        assert own == sorted(own, key=lambda i: (int(plain("plan-v1", "seed", "row", i), 16), i))
    tries = table.select("record_id", "negatives", batching.negatives_in_order(F.col("negatives"), F.col("record_id"), "seed", "plan-v1").alias("t")).collect()
    for r in tries:
        assert [n["key"] for n in r["t"]] == sorted((n["key"] for n in r["negatives"]), key=lambda k: (plain("plan-v1", "seed", "negative", r["record_id"], k), k))
    with pytest.raises(ValueError):
        blake_key("longer than sixteen bytes", F.lit("x"))
    packed = batching.plan_rows(batching.pack(table, batching.PlanParams(batch_size=5, order="plan-v1")))
    assert set(batching.plan_violations(packed, batching.PlanParams(batch_size=5)).first()) == {0}
