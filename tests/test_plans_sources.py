import gzip
import json

import pytest
from pyspark.sql import functions as F

from quillrank import cli
from quillrank.operators import comparison
from quillrank.operators.batching import PlanParams
from quillrank.plans import batches, compare, evaluate, preflight
from quillrank.plans.config import ConfigError, compile_config, merge_model
from quillrank.sources import files, schemas, sinks, tasks


def lines(path, rows, packed=False):
    text = "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
    if packed:
        with gzip.open(path, "wt", encoding="utf-8") as f:
            f.write(text)
    else:
        path.write_text(text + "\n \n", encoding="utf-8")
    return str(path)


def test_json_lines(spark, tmp_path):
    rows = [{"id": "a", "text": "x"}, {"id": "b", "text": "y"}]
    for packed in (False, True):
        path = lines(tmp_path / ("c.jsonl.gz" if packed else "c.jsonl"), rows, packed)
        assert files.read_json_lines_strict(spark, path, schemas.SEARCH_CORPUS).count() == 2
        assert [r["seq"] for r in files.numbered(files.read_json_lines(spark, path, schemas.SEARCH_CORPUS)).orderBy("seq").collect()] == [1, 2]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": "a"}\n{oops\n')
    with pytest.raises(Exception, match="invalid JSON"):
        files.read_json_lines_strict(spark, str(bad), schemas.SEARCH_CORPUS).collect()
    many = files.numbered(spark.range(1000).repartition(7).orderBy("id"))
    assert many.where("seq = id + 1").count() == 1000


def test_qrels(spark, tmp_path):
    path = tmp_path / "q.tsv"
    path.write_text("query_id\tq0\tdoc_id\trelevance\tsplit\nq1\t0\ta\t1\tdev\nq1\t0\ta\t3\tdev\nq1\t0\tb\t0\tdev\nq2\t0\tc\t2\ttest\n")
    got = {(r["query_id"], r["doc_id"]): r["grade"] for r in files.read_qrels(spark, str(path)).collect()}
    assert got == {("q1", "a"): 3.0, ("q2", "c"): 2.0}
    assert files.read_qrels(spark, str(path), "dev", split_field="split").count() == 1
    plain = tmp_path / "p.tsv"
    plain.write_text("query_id\tdoc_id\nq1\ta\n")
    assert files.read_qrels(spark, str(plain)).first()["grade"] == 1.0
    with pytest.raises(ValueError, match="lacks"):
        files.read_tsv(spark, str(plain), schemas.PASSAGE_RESULTS)


def test_copies_of_a_corpus_stay(spark):
    corpus = spark.createDataFrame([("a", "x"), ("b", None)], "doc_id string, text string")
    q = spark.createDataFrame([("q", "dev", "x"), ("r", "test", "y")], "query_id string, split string, text string")
    t = tasks.retrieval_tables(q, [corpus], [corpus], spark.createDataFrame([], "query_id string, doc_id string, grade double"), "dev")
    assert (t.corpus.count(), t.judged.count(), t.queries.count()) == (4, 2, 1)


def test_pairs(spark):
    rows = [("r1", "train", "q one", "An  Answer", 1), ("r2", "dev", "q two", "an answer", 2), ("r3", "dev", "", "other", 3), ("r4", "dev", "q", "third", 4), ("r5", "dev", "q", " ", 5)]
    df = spark.createDataFrame(rows, "record_id string, split string, question string, answer string, seq long")
    t = tasks.pairs_tables(df, "dev")
    assert {(r["doc_id"], r["text"]) for r in t.corpus.collect()} == {("doc-1", "An  Answer"), ("doc-2", "other"), ("doc-3", "third")}
    assert {(r["query_id"], r["doc_id"]) for r in t.qrels.collect()} == {("r2", "doc-1"), ("r4", "doc-3")}
    with pytest.raises(Exception, match="not indexed"):
        tasks.pairs_tables(df, "dev", ["train"]).qrels.collect()


def test_sinks(spark, tmp_path):
    sinks.write_json(tmp_path / "a" / "x.json", {"k": "é"})
    assert (tmp_path / "a" / "x.json").read_text() == '{\n  "k": "é"\n}\n'
    a, b = (sinks.write_gzip_lines(tmp_path / f"{n}.gz", [{"b": 1, "a": "é"}]) for n in "ab")
    assert a == b and gzip.open(tmp_path / "a.gz", "rt").read() == '{"a":"é","b":1}\n'
    df = spark.createDataFrame([("q2", True, 1), ("q1", False, 2)], "query_id string, correct boolean, rank int")
    sinks.write_per_query(df, str(tmp_path / "pq"))
    back = files.read_tsv(spark, str(tmp_path / "pq"))
    assert back.columns == ["query_id", "correct", "rank"] and [r["correct"] for r in back.collect()] == ["False", "True"]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_per_query(df, str(tmp_path / "pq"))
    assert sinks.table_digest(df) == sinks.table_digest(df.repartition(3)) != sinks.table_digest(df.limit(1))
    assert [sinks.run_folder(tmp_path, "r").name for _ in range(3)] == ["r", "r_1", "r_2"]
    digests = files.file_digests(spark, [str(tmp_path / "a" / "x.json")]).collect()
    assert len(digests[0]["sha256"]) == 64


def test_config_fails_before_reading():
    base = {"tasks": [{"name": "t", "type": "retrieval", "split": "dev"}], "retriever": {"type": "bm25"}}
    assert compile_config(base).tasks[0].retriever.k1 == 1.2
    for broken in ({"tasks": [{"name": "t", "type": "odd", "split": "d"}]}, {"tasks": [{"name": "t"}]}, {**base, "retriever": {"type": "odd"}}, {**base, "retriever": {"type": "dense", "similarity": "odd"}},
                   {**base, "retriever": {"type": "dense", "encoder": "odd"}}):
        with pytest.raises(ConfigError):
            compile_config(broken)
    merged = merge_model(base, {"models": {"m": {"type": "dense", "dim": 16}}}, "m")
    assert compile_config(merged).tasks[0].retriever.dim == 16 and base["retriever"] == {"type": "bm25"}
    with pytest.raises(ConfigError):
        merge_model(base, None, "m")
    with pytest.raises(ConfigError):
        merge_model(base, {"models": {}}, "m")
    locked = compile_config({"tasks": [{"name": "a", "type": "mcq", "split": "test", "questions_path": "/nowhere"}, {"name": "b", "type": "mcq", "split": "dev", "enabled": False}]})
    assert locked.runnable()[0] == [] and [n for n, _ in locked.runnable()[1]] == ["a", "b"]


@pytest.mark.parametrize("retriever", [{"type": "bm25"}, {"type": "dense", "dim": 64}])
def test_evaluation_end_to_end(spark, tmp_path, retriever):
    docs = [{"doc_id": f"d{i}", "text": t} for i, t in enumerate(["폐렴 항생제", "심근경색 치료", "COPD care", "diabetes diet", "unrelated words"])]
    queries = [{"query_id": f"q{i}", "split": "dev", "text": t, "metadata": {"domain": "x" if i else None}, "code_switch": {"hangul_chars": h, "latin_chars": la}}
               for i, (t, h, la) in enumerate([("폐렴", 30, 0), ("심근경색 COPD", 30, 30), ("diet", 0, 30)])]
    (tmp_path / "qrels.tsv").write_text("query_id\tdoc_id\trelevance\nq0\td0\t1\nq1\td1\t1\n")
    choices = [{"question_id": "m1", "split": "dev", "query": "COPD care", "options": ["COPD care plan", "else", "none"], "answer_index": 1, "code_switch": {"hangul_chars": 0, "latin_chars": 9}}]
    pairs = [{"record_id": "p1", "split": "dev", "question": "폐렴 항생제는", "answer": "폐렴 항생제"}, {"record_id": "p2", "split": "dev", "question": "diet", "answer": "a diet plan"}]
    config = {
        "retriever": retriever, "code_switch_thresholds": [5, 20], "bootstrap": {"iterations": 50}, "locked_splits": ["test"], "tasks": [
            {"name": "r", "type": "retrieval", "split": "dev", "queries_path": lines(tmp_path / "q.jsonl", queries), "corpus_paths": [lines(tmp_path / "c.jsonl.gz", docs, True)], "qrels_path": str(tmp_path / "qrels.tsv"), "subgroup_fields": ["metadata.domain"]},
            {"name": "p", "type": "pairs_retrieval", "split": "dev", "pairs_path": lines(tmp_path / "p.jsonl", pairs), "code_switch_thresholds": []},
            {"name": "m", "type": "mcq", "split": "dev", "questions_path": lines(tmp_path / "m.jsonl", choices)},
            {"name": "locked", "type": "mcq", "split": "test", "questions_path": "/nowhere"}]}
    out = evaluate.run(spark, compile_config(config), tmp_path / "out")
    assert out["skipped"] == [{"task": "locked", "reason": "split test is locked"}]
    r = out["tasks"]["r"]
    assert (r["queries_total"], r["queries_scored"], r["corpus_documents"]) == (3, 2, 5)
    assert r["mrr"] == 1.0 and out["tasks"]["m"]["accuracy"] == 1.0 and out["tasks"]["p"]["mrr"] == 1.0
    assert {s["metric"] for s in r["strata"]} == {"ndcg", "mrr", "recall"} and all(s["low"] <= s["mean"] <= s["high"] for s in r["strata"])
    assert {(s["field"], s["bucket"]) for s in r["strata"]} >= {("metadata.domain", "None"), ("code_switch_20", "mixed"), ("code_switch_20", "ko")}
    assert r["mixed_drop"] and (tmp_path / "out" / "r" / "report.md").exists()
    assert json.loads((tmp_path / "out" / "summary.json").read_text())["tasks"]["r"]["mrr"] == 1.0


def test_batches_end_to_end(spark, tmp_path):
    rows = [{"triplet_id": f"t{i}", "split": "train" if i else "dev", "query": f"q{i}", "positive": f"answer number {i % 7}", "hard_negatives": [f"answer number {(i + j) % 7}" for j in (1, 2, 3)], "option_len_rank": i % 3} for i in range(30)]
    path = lines(tmp_path / "t.jsonl.gz", rows, True)
    params = PlanParams(batch_size=4)
    a = batches.build(spark, {"s": path}, tmp_path / "a", params)
    b = batches.build(spark, {"s": path}, tmp_path / "b", params)
    assert a == b and (tmp_path / "a" / "plan.jsonl.gz").read_bytes() == (tmp_path / "b" / "plan.jsonl.gz").read_bytes()
    assert a["records_read"] == 30 and a["quarantined"]["non_train_split"] == 1 and a["collision_pairs_before"] > 0
    with pytest.raises(FileExistsError):
        batches.build(spark, {"s": path}, tmp_path / "a", params)
    at = tmp_path / "a" / "plan.jsonl.gz"
    plan, sizes = preflight.load_plan(spark, at, a["plan_sha256"], a["batched"], a["batches"])
    assert plan.count() == sum(sizes) == a["batched"]
    preflight.check_sampler(sizes, a["batched"])
    for wrong in (dict(sha256="0" * 64), dict(sha256=a["plan_sha256"], rows=1), dict(sha256=a["plan_sha256"], groups=1), dict(sha256=a["plan_sha256"], stored="0")):
        with pytest.raises(preflight.PreflightError):
            preflight.load_plan(spark, at, **wrong)
    with pytest.raises(preflight.PreflightError):
        preflight.check_sampler(sizes, 1)
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="invalid JSON"):
        batches.build(spark, {"s": str(tmp_path / "bad.jsonl")}, tmp_path / "c", params)
    assert not list(tmp_path.glob("c*"))


def test_compare_end_to_end(spark, tmp_path, capsys):
    def candidate(name, right):
        exam = tmp_path / f"{name}_exam.tsv"
        exam.write_text("query_id\tcorrect\trank\treciprocal_rank\tlongest_option_hit\trandom_hit\n" + "".join(f"q{i}\t{i in right}\t{1 if i in right else 2}\t{1.0 if i in right else 0.5}\t0\t0.2\n" for i in range(8)))
        passage = tmp_path / f"{name}_passage.tsv"
        passage.write_text("query_id\tndcg\tmrr\trecall\tunjudged_in_top\n" + "".join(f"p{i}\t0.5\t0.5\t1.0\t0\n" for i in range(4)))
        return {"exam_per_query_path": str(exam), "passage_per_query_path": str(passage)}

    candidates = {"a": candidate("a", {0, 1, 2, 3, 4, 5, 6, 7}), "b": candidate("b", {0, 1}), "c": candidate("c", set(range(8)))}
    report = compare.compare(spark, candidates, ["a"], resampling=comparison.Resampling(50), output=tmp_path / "out")
    assert report["winner"] == "c" and report["label"] == "superiority established" and len(report["pairs"]) == 3
    held = {(r["model_a"], r["model_b"], r["metric"]): r for r in report["intervals"]}
    assert len(held) == 15 and held["a", "b", "accuracy"]["mean"] == 0.75 and held["a", "b", "ndcg"]["crosses_zero"] and not held["b", "c", "exam_mrr"]["crosses_zero"]
    assert held["a", "b", "accuracy"]["low"] == next(r["low"] for r in report["pairs"] if (r["model_a"], r["model_b"]) == ("a", "b"))
    assert json.loads((tmp_path / "out" / "comparison.json").read_text())["winner"] == "c" and (tmp_path / "out" / "comparison.md").exists()
    assert compare.compare(spark, candidates, ["a"], resampling=comparison.Resampling(50)) == report
    broken = (tmp_path / "b_exam.tsv").read_text().replace("q7\t", "q6\t")
    (tmp_path / "b_exam.tsv").write_text(broken)
    with pytest.raises(comparison.EvidenceError) as error:
        compare.compare(spark, candidates)
    assert any("repeated_id q6" in i for i in error.value.issues) and any("missing_id q7" in i for i in error.value.issues)
    config = tmp_path / "compare.json"
    config.write_text(json.dumps({"candidates": candidates}))
    assert cli.main(["compare", "--config", str(config), "--check-only"]) == 2
    (tmp_path / "b_exam.tsv").write_text(broken.replace("q6\tFalse\t2\t0.5\t0\t0.2\nq6\t", "q6\tFalse\t2\t0.5\t0\t0.2\nq7\t"))
    assert cli.main(["compare", "--config", str(config), "--check-only"]) == 0
    for name, seed in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"model_key": name, "frozen_contract": {"seed": seed}, "license_label": "free", "scores": {"ndcg": 0.25}}))
        candidates[name]["summary_path"] = str(tmp_path / f"{name}.json")
    checks = {"candidates": candidates, "frozen_contract": {"seed": 1}, "license_labels": {"a": "bound"}, "withdrawn_values": [["scores.ndcg", 0.25]]}
    config.write_text(json.dumps(checks))
    capsys.readouterr()
    assert cli.main(["compare", "--config", str(config), "--check-only"]) == 2
    assert capsys.readouterr().err.splitlines() == ["c: no summary", "a: license_label is 'free'", "a: scores.ndcg has the withdrawn value 0.25", "b: frozen seed is 2, not 1", "b: scores.ndcg has the withdrawn value 0.25"]


def test_comparison_has_deltas_trace_and_wide_pairs(spark, tmp_path):
    import csv

    def candidate(name, right, ndcg):
        exam, passage = tmp_path / f"{name}_exam.tsv", tmp_path / f"{name}_passage.tsv"
        exam.write_text("query_id\tcorrect\trank\treciprocal_rank\tlongest_option_hit\trandom_hit\n" + "".join(f"q{i}\t{i in right}\t{1 if i in right else 2}\t{1.0 if i in right else 0.5}\t0\t0.2\n" for i in range(8)))
        passage.write_text("query_id\tndcg\tmrr\trecall\tunjudged_in_top\n" + "".join(f"p{i}\t{ndcg}\t0.5\t1.0\t0\n" for i in range(4)))
        return {"exam_per_query_path": str(exam), "passage_per_query_path": str(passage)}

    candidates = {"a": candidate("a", set(range(8)), 0.9), "b": candidate("b", {0, 1, 2}, 0.5), "c": candidate("c", {0, 1, 2}, 0.7), "d": candidate("d", {0, 1, 2}, 0.7)}
    base = {m: {"accuracy": 0.25, "ndcg": 0.5} for m in candidates}
    summaries = {m: {"model_key": m, "resources": {"seconds": 5, "peak_mb": 7}} if m == "b" else {"model_key": m} for m in candidates}
    report = compare.compare(spark, candidates, ["a"], summaries=summaries, resampling=comparison.Resampling(30), output=tmp_path / "out", baselines=base)
    assert [(d["model_key"], d["accuracy_delta"], round(d["ndcg_delta"], 9)) for d in report["deltas"]] == [("a", 0.75, 0.4), ("b", 0.125, 0.0), ("c", 0.125, 0.2), ("d", 0.125, 0.2)]
    steps = {}
    for r in report["trace"]:
        steps.setdefault((r["step"], r["criterion"], r["best"], r["remaining"]), []).append(r["model_key"])
    assert steps == {(0, "eligible", None, 3): ["b", "c", "d"], (1, "correct_count", 3.0, 3): ["b", "c", "d"], (2, "exam_mrr", 0.6875, 3): ["b", "c", "d"], (3, "ndcg", 0.7, 2): ["c", "d"], (4, "position", 2.0, 1): ["c"]}
    assert report["winner"] == "c" and report["resources"] == [{"model_key": "b", "seconds": 5, "peak_mb": 7}]
    with open(tmp_path / "out" / "pairs_wide.csv", encoding="utf-8") as file:
        rows = list(csv.DictReader(file))
    held = {(r["model_a"], r["model_b"], r["metric"]): r for r in report["intervals"]}
    assert len(rows) == 6 and len(rows[0]) == 26
    for r in rows:
        for m in ("accuracy", "exam_mrr", "ndcg", "mrr", "recall"):
            one = held[r["model_a"], r["model_b"], m]
            assert (float(r[f"{m}_diff"]), float(r[f"{m}_low"]), r[f"{m}_crosses_zero"]) == (one["mean"], one["low"], str(one["crosses_zero"]))
    with pytest.raises(comparison.EvidenceError, match="d: no baseline"):
        compare.compare(spark, candidates, baselines={m: base[m] for m in "abc"}, resampling=comparison.Resampling(10))


def test_search_command(spark, tmp_path, capsys):
    corpus = lines(tmp_path / "c.jsonl", [{"id": "a", "text": "폐렴 항생제"}, {"id": "b", "text": "심근경색"}])
    assert cli.main(["search", "--query", "폐렴", "--corpus", corpus, "--top-k", "1"]) == 0
    assert capsys.readouterr().out.startswith("1\ta\t")
    corpus = lines(tmp_path / "d.jsonl", [{"id": "a", "text": "폐렴 old"}, {"id": "a", "text": "폐렴 new"}, {"id": "b", "text": "폐렴"}, {"id": "c", "text": "else"}])
    assert cli.main(["search", "--query", "폐렴", "--corpus", corpus, "--top-k", "3"]) == 0
    shown = [line.split("\t") for line in capsys.readouterr().out.splitlines()]
    assert [(r[0], r[1], r[3]) for r in shown] == [("1", "b", "폐렴"), ("2", "a", "폐렴 new"), ("3", "a", "폐렴 new")]


def test_streams(spark, tmp_path):
    from pyspark.sql import types as T

    from quillrank.streaming import live

    docs = spark.createDataFrame([("d1", "alpha beta"), ("d2", "beta gamma"), ("d2", "beta gamma")], "doc_id string, text string")
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "q.json", [{"query_id": "q", "text": "gamma"}])
    stream = live.read_stream(spark, str(tmp_path / "in"), T.StructType([T.StructField("query_id", T.StringType()), T.StructField("text", T.StringType())]))
    query = live.answer_stream(stream, live.frozen_index(docs).cache(), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["d2", "d2"]
    spark.createDataFrame([("a", "2024-01-01 00:01:00"), ("a", "2024-01-01 00:02:00")], "event_type string, t string").select("event_type", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema("event_type string, ts timestamp").parquet(str(tmp_path / "ev"))
    q = live.windowed_counts(events).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select n from counted").collect()[0][0] == 2


def test_checkpoints(tmp_path):
    for step, complete in ((1, True), (5, True), (10, True), (20, False)):
        at = tmp_path / f"checkpoint-{step}"
        at.mkdir()
        if complete:
            (at / preflight.MARKER).touch()
    assert preflight.newest_checkpoint(tmp_path).name == "checkpoint-10" and preflight.newest_checkpoint(tmp_path / "none") is None
    assert [p.name for p in preflight.retain_checkpoints(tmp_path, 2)] == ["checkpoint-1"] and (tmp_path / "checkpoint-20").exists()


def test_bad_line_is_named_by_its_number(spark, tmp_path):
    """Small splits, so that the bad line is far into a file's later split; a second file before it by name is whole."""
    lines(tmp_path / "a.jsonl", [{"id": f"a{i}", "text": "x" * 50} for i in range(300)])
    rows = [json.dumps({"id": f"b{i}", "text": "y" * (i % 90)}) for i in range(2000)]
    rows[1500], rows[3], rows[1700] = '{"id": "oops', "", "[1]"
    (tmp_path / "b.jsonl").write_text("\n".join(rows) + "\n")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        numbers = files.numbered_lines(spark, str(tmp_path / "*.jsonl"))
        assert spark.read.text(str(tmp_path / "b.jsonl")).rdd.getNumPartitions() > 5
        want = {(n, i + 1): v for n in "ab" for i, v in enumerate((tmp_path / f"{n}.jsonl").read_text().split("\n")[:-1])}
        assert {(r["file"][-7], r["line"]): r["value"] for r in numbers.collect()} == want
        bad = files.bad_lines(spark, str(tmp_path / "*.jsonl"), schemas.SEARCH_CORPUS).orderBy("line").collect()
        assert [(r["line"], r["value"]) for r in bad] == [(1501, '{"id": "oops'), (1701, "[1]")]
        with pytest.raises(ValueError, match=r"b\.jsonl:1501: invalid JSON"):
            files.read_json_lines_strict(spark, str(tmp_path / "*.jsonl"), schemas.SEARCH_CORPUS)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep[0])
        spark.conf.set("spark.sql.files.openCostInBytes", keep[1])


def test_gzip_members_do_not_depend_on_partitions(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("text"), (F.col("id") * 7919 % 1000).alias("at"), F.lit("é\"\\\n").alias("b"), F.lit(None).cast("int").alias("none"))
    found = []
    for parts in (1, 4, 16):
        path = str(tmp_path / f"m{parts}")
        digest = sinks.write_gzip_members(rows.repartition(parts), ["at"], path, member_rows=300)
        names = [n for n in sorted(p.name for p in (tmp_path / f"m{parts}").iterdir()) if n.startswith("member")]
        assert len(names) == 4
        found.append((digest, b"".join((tmp_path / f"m{parts}" / n).read_bytes() for n in names)))
    assert found[0] == found[1] == found[2]
    text = gzip.decompress(found[0][1]).decode().splitlines()
    want = [{"at": r["at"], "b": r["b"], "none": None, "text": r["text"]} for r in rows.orderBy("at").collect()]
    assert text == [json.dumps(w, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for w in want]
    with pytest.raises(FileExistsError):
        sinks.write_gzip_members(rows, ["at"], str(tmp_path / "m1"))


def test_ordered_digest_is_a_tree(spark):
    from hashlib import sha256

    def plain(values, fan):
        level = [sha256(v.encode()).hexdigest() for v in values]
        while True:
            level = [sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)] or [sha256(b"").hexdigest()]
            if len(level) == 1:
                return level[0]

    values = [f"line {i % 17}" for i in range(130)]
    for fan, n in ((5, 130), (5, 25), (5, 26), (200, 130), (5, 1), (5, 0)):
        rows = spark.createDataFrame(list(enumerate(values[:n], 1)), "seq long, value string").repartition(3)
        assert sinks.ordered_digest(rows, fan) == plain(values[:n], fan)
    swapped = [*values[:40], values[41], values[40], *values[42:]]
    assert plain(swapped, 5) != plain(values, 5)


def test_built_plan_is_loaded_against_its_digest(spark, tmp_path):
    rows = [{"triplet_id": f"t{i}", "split": "train", "query": f"q{i}", "positive": f"answer number {i % 7}", "hard_negatives": [f"answer number {(i + j) % 7}" for j in (1, 2, 3)], "option_len_rank": i % 3} for i in range(40)]
    path = lines(tmp_path / "t.jsonl", rows)
    one = batches.build(spark, {"s": path}, tmp_path / "one", PlanParams(batch_size=4))
    many = batches.build(spark, {"s": path}, f"file://{tmp_path}/many", PlanParams(batch_size=4), member_rows=7)
    assert one == many and (tmp_path / "many" / "plan.jsonl.gz").is_dir()
    for folder in ("one", "many"):
        plan, sizes, summary = preflight.load_built(spark, tmp_path / folder, one["deterministic_digest"])
        assert summary == one and plan.count() == sum(sizes) == one["batched"]
    member = next((tmp_path / "many" / "plan.jsonl.gz").glob("member-00000001*"))
    held = gzip.decompress(member.read_bytes()).decode().splitlines()
    for p in (tmp_path / "many" / "plan.jsonl.gz").glob(".*.crc"):
        p.unlink()
    for broken in ([held[1], held[0], *held[2:]], [held[0].replace("answer", "Answer"), *held[1:]], held[:-1]):  # swapped, changed, lost
        member.write_bytes(gzip.compress(("\n".join(broken) + "\n").encode()))
        with pytest.raises(preflight.PreflightError):
            preflight.load_built(spark, tmp_path / "many", one["deterministic_digest"])
    summary = tmp_path / "one" / "summary.json"
    summary.write_text(summary.read_text().replace('"candidates": 40', '"candidates": 41'))
    (tmp_path / "one" / ".summary.json.crc").unlink(missing_ok=True)
    with pytest.raises(preflight.PreflightError, match="summary"):
        preflight.load_built(spark, tmp_path / "one")
    with pytest.raises(preflight.PreflightError):
        preflight.load_built(spark, tmp_path / "many", "0" * 64)


def test_staged_output_appears_whole_or_not_at_all(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillrank.sources import folders

    bad = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception), folders.staged(spark, f"file://{tmp_path}/out") as stage:
        folders.write_text(spark, f"{stage}/note", "x")
        bad.write.text(f"{stage}/rows")
    assert not list(tmp_path.iterdir())
    with folders.staged(spark, f"file://{tmp_path}/out") as stage:
        folders.write_text(spark, f"{stage}/note", "é")
    assert folders.read_text(spark, f"{tmp_path}/out/note") == "é"
    with pytest.raises(FileExistsError), folders.staged(spark, str(tmp_path / "out")):
        pass


def test_routes_are_counted_while_rows_are_encoded(spark):
    from pyspark.sql import functions as F

    from quillrank.operators import encoding

    calls = spark.sparkContext.accumulator(0)

    def factory():
        def encode(texts, role):
            calls.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    encoding.register_encoder("lengths", factory)
    rows = spark.createDataFrame([(i, "x" * i) for i in range(25)], "doc_id long, text string").repartition(3)
    watched, seen = encoding.counted(rows, "passage", {"short": F.length("text") < 10, "long": F.length("text") >= 10})
    assert len(encoding.encode(watched, "lengths", "passage").collect()) == 25
    assert seen.get == {"rows": 25, "short": 10, "long": 15} and calls.value == 25  # no second scan
    plain, seen = encoding.counted(rows.limit(0), "query")
    plain.collect()
    assert seen.get == {"rows": 0, "query": 0}


def test_summary_has_routes_settings_and_time(spark, tmp_path):
    corpus = lines(tmp_path / "c.jsonl", [{"doc_id": f"d{i}", "text": f"alpha {i} beta"} for i in range(6)])
    queries = lines(tmp_path / "q.jsonl", [{"query_id": "q1", "text": "alpha 1", "split": "dev"}, {"query_id": "q2", "text": "beta 2", "split": "dev"}])
    (tmp_path / "qrels.tsv").write_text("query_id\tdoc_id\trelevance\nq1\td1\t1\nq2\td2\t1\n")
    task = {"name": "dense", "type": "retrieval", "split": "dev", "corpus_paths": [corpus], "queries_path": queries, "qrels_path": str(tmp_path / "qrels.tsv"), "retriever": {"type": "dense", "dim": 32, "routes": {"query": "ask"}}}
    evaluation = compile_config({"tasks": [task], "bootstrap": {"iterations": 20}})
    block = evaluate.run(spark, evaluation, tmp_path / "out")["tasks"]["dense"]
    assert block["route_counts"] == {"passage": {"rows": 6, "passage": 6}, "query": {"rows": 2, "ask": 2}}
    assert block["seconds"] > 0 and block["config"]["retriever"]["dim"] == 32 and block["config"]["settings"]["queries_path"] == queries
    assert json.loads((tmp_path / "out" / "dense" / "summary.json").read_text())["route_counts"]["query"]["ask"] == 2


def test_manifest_of_a_tree(spark, tmp_path):
    from hashlib import sha256

    from quillrank.operators import manifests

    for name, body in (("a.txt", b"one"), ("sub/b.bin", b"two\0"), ("sub/deep/c", b""), ("extra", b"x")):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(body)
    found = manifests.tree_manifest(spark, f"file://{tmp_path}/t")
    assert {(r["path"], r["bytes"], r["sha256"]) for r in found.collect()} == {(n, len(b), sha256(b).hexdigest()) for n, b in (("a.txt", b"one"), ("sub/b.bin", b"two\0"), ("sub/deep/c", b""), ("extra", b"x"))}
    claims = spark.createDataFrame([("a.txt", 3, sha256(b"one").hexdigest().upper()), ("sub/b.bin", 5, "0"), ("sub/deep/c", None, None), ("sub/deep/c", None, None), ("lost", 1, None)], "path string, bytes long, sha256 string")
    with pytest.raises(comparison.EvidenceError) as error:
        manifests.require_manifest(claims, found)
    assert error.value.issues == ["extra: unlisted", "lost: missing", f"sub/b.bin: digest {sha256(bytes([116, 119, 111, 0])).hexdigest()}", "sub/b.bin: size 5 4", "sub/deep/c: claimed_twice 2"]
    manifests.require_manifest(found, found)


def test_index_follows_arriving_documents(spark, tmp_path):
    """After each batch, a repeated one and one that failed half way too, scores are those of all documents so far at once."""
    import random
    import shutil

    from quillrank.operators.ranking import Bm25Params, bm25_top_k
    from quillrank.streaming.arriving import GrowingIndex, follow

    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    params = Bm25Params(mode="whitespace")
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.sample(words, 3))) for i in range(6)], "query_id string, text string")
    parts = [[(f"d{rng.randrange(40)}", " ".join(rng.choices(words, k=rng.randrange(0, 15)))) for _ in range(n)] for n in (7, 12, 1, 9, 15)]
    index = GrowingIndex(spark, str(tmp_path / "index"), params, compact_every=2)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    assert index.top_k(queries, 5).count() == 0
    so_far = []
    for number, part in enumerate(parts[:4]):
        frame = spark.createDataFrame(part, "doc_id string, text string")
        index.add(frame, number)
        if number == 1:
            index.add(frame, number)  # repeated
        if number == 2:
            (tmp_path / "index" / "done" / "2").unlink()  # failed before its mark
            shutil.rmtree(tmp_path / "index" / "stats" / "batch=2")
            index.add(frame.repartition(3), number)
        so_far += part
        assert rows(index.top_k(queries, 5)) == rows(bm25_top_k(spark.createDataFrame(so_far, "doc_id string, text string"), queries, 5, params))
    assert index.last() == 3 and len(list((tmp_path / "index" / "summed").glob("upto=*"))) == 2
    # The same as a stream of files, two batches of one file each.
    (tmp_path / "in").mkdir()
    for i, part in enumerate(parts[:2]):
        lines(tmp_path / "in" / f"{i}.json", [{"doc_id": a, "text": b} for a, b in part])
    stream = spark.readStream.schema("doc_id string, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    streamed = GrowingIndex(spark, str(tmp_path / "streamed"), params)
    query = follow(stream, streamed, str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert rows(streamed.top_k(queries, 5)) == rows(bm25_top_k(spark.createDataFrame(parts[0] + parts[1], "doc_id string, text string"), queries, 5, params))
