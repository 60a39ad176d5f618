"""The retrieval queries over the driver's tables, each with SQL that gives the same rows.

Benchmark items are the queries and documents the corpus; a document that contains an item's text is relevant to it, and
labelled documents are judged.  Conversations give question-answer pairs, multiple-choice questions (a question's own
answer among those of the next four conversations) and triplets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import text as T
from quillrank.functions import vectors as V
from quillrank.operators import batching, choice, comparison, containment, encoding, manifests, metrics, ranking, statistics
from quillrank.sources.files import numbered_in_order, union_all
from quillrank.sources.sinks import digest_levels
from quillrank.sources.tasks import pairs_tables

WHITESPACE = ranking.Bm25Params(mode="whitespace")
BIGRAM = ranking.Bm25Params(mode="char_bigram", scripts=T.ACCENTED_LATIN)
#: Models that are compared on the multiple-choice questions.
MODELS = {"bm25": WHITESPACE, "bm25_flat": ranking.Bm25Params(mode="whitespace", k1=0.4, b=0.0), "bm25_bigram": BIGRAM}
PLAN = batching.PlanParams(batch_size=8, minimum_batch_size=2, max_mean_length_gap=400, max_quantile_length_gap=400, seed="plan")
THRESHOLDS = (5, 20, 50)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = containment.containment_pairs(_documents(spark, sf_dir), _items(spark, sf_dir))
    return pairs.withColumn("grade", F.lit(1.0))


def _exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, question, answer)``: each user turn that an assistant turn follows."""
    turns = _read(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(told, ["conv_id", "turn"])


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's first exchange: its answer among those of the conversations after it."""
    first = _exchanges(spark, sf_dir).groupBy("conv_id").agg(F.min_by("question", "turn").alias("text"), F.min_by("answer", "turn").alias("answer"))
    wanted = first.select("conv_id", "text", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).withColumn("other", F.col("conv_id") + F.col("j"))
    given = first.select(F.col("conv_id").alias("other"), "answer")
    option = F.struct(F.pmod(F.col("j") + F.col("conv_id"), F.lit(5)).alias("o"), F.col("answer").alias("t"), "j")
    rows = wanted.join(given, "other").groupBy("conv_id", "text").agg(F.array_sort(F.collect_list(option)).alias("os"))
    return rows.select(F.col("conv_id").alias("question_id"), "text", F.transform("os", lambda o: o["t"]).alias("options"),
                       F.array_position(F.transform("os", lambda o: o["j"]), 0).cast("int").alias("answer_index"))


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.answer_rows(choice.bm25_ranked(_questions(spark, sf_dir), MODELS)).withColumnRenamed("question_id", "query_id")


def _triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir)
    own = F.element_at("options", F.col("answer_index"))
    return q.select(
        F.lit("conversations").alias("source"), F.col("question_id").cast("long").alias("seq"), F.lit(None).cast("string").alias("triplet_id"), F.col("question_id").cast("string").alias("question_id"),
        F.when(F.col("question_id") % 10 == 0, "dev").otherwise("train").alias("split"), F.col("text").alias("query"), own.alias("positive"),
        F.expr("filter(options, (o, i) -> i <> answer_index - 1)").alias("hard_negatives"),
        F.size(F.filter("options", lambda o: F.length(o) > F.length(own))).alias("option_len_rank"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.classify(_triplets(spark, sf_dir), PLAN).where("reason is null")


# Tokens and text


def tok_whitespace_tf(spark, sf_dir):
    return ranking.term_frequencies(_documents(spark, sf_dir), "whitespace")


def tok_bigram_tf(spark, sf_dir):
    return ranking.term_frequencies(_documents(spark, sf_dir), "char_bigram", T.ACCENTED_LATIN)


def text_clean(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


def text_norm_key(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.normal_key(F.col("text")).alias("key"))


def script_levels(spark, sf_dir):
    dense, plain = T.script_counts(F.col("text"), T.ACCENTED_LATIN)
    rows = _documents(spark, sf_dir).select("doc_id", dense.alias("d"), plain.alias("p"))
    return rows.select("doc_id", *[T.script_level(F.col("d"), F.col("p"), t).alias(f"level_{t}") for t in THRESHOLDS])


def hashed_encoding(spark, sf_dir):
    return encoding.hashed_slots(_documents(spark, sf_dir), 100, None, "whitespace")


# BM25


def bm25_doc_len(spark, sf_dir):
    return ranking.document_lengths(_documents(spark, sf_dir), "whitespace")


def bm25_corpus_stats(spark, sf_dir):
    return ranking.corpus_stats(bm25_doc_len(spark, sf_dir)).withColumn("avg_len", F.round("avg_len", 9))


def bm25_idf(spark, sf_dir):
    stats = ranking.corpus_stats(bm25_doc_len(spark, sf_dir))
    return ranking.inverse_frequencies(ranking.document_terms(_documents(spark, sf_dir), "whitespace"), stats).withColumn("idf", F.round("idf", 9))


def bm25_topk(spark, sf_dir):
    return ranking.bm25_top_k(_documents(spark, sf_dir), _items(spark, sf_dir), 10, WHITESPACE)


def bm25_topk_bigram(spark, sf_dir):
    return ranking.bm25_top_k(_documents(spark, sf_dir), _items(spark, sf_dir), 10, BIGRAM)


def bm25_topk_joined(spark, sf_dir):
    return ranking.bm25_joined_top_k(_documents(spark, sf_dir), _items(spark, sf_dir), 10, WHITESPACE)


# Vectors


def _vectors(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"), "label")


def _nearest(spark, sf_dir, name: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return ranking.vector_top_k(rows.select(F.col("vec_id").alias("doc_id"), "v"), rows.select(F.col("vec_id").alias("query_id"), "v"), 10, name)


def dense_cosine_topk(spark, sf_dir):
    return _nearest(spark, sf_dir, "cosine")


def dense_dot_topk(spark, sf_dir):
    return _nearest(spark, sf_dir, "dot_product")


def l2_normalize_vectors(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode(V.normalize_lenient(F.col("v"))).alias("i", "x"))
    return rows.select("vec_id", "i", F.round("x", 9).alias("x"))


def dense_label_metrics(spark, sf_dir):
    """Vectors of the same label are relevant: precision of the ten nearest, by label."""
    near, rows = dense_cosine_topk(spark, sf_dir), _vectors(spark, sf_dir)
    a, b = rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("label")), rows.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("other"))
    hits = near.where("query_id <> doc_id").join(a, "query_id").join(b, "doc_id")
    return hits.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("other")).cast("double")), 9).alias("precision"))


def mnrl_batch_loss(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 16).alias("number"), F.col("vec_id").alias("id"), V.normalize_lenient(F.col("v")).alias("v"))
    other = rows.select(F.col("number").alias("m"), F.col("id").alias("candidate"), F.col("v").alias("w"))
    pairs = rows.join(other, F.col("number") == F.col("m"))
    pairs = pairs.select("number", F.col("id").alias("query"), "candidate", V.dot(F.col("v"), F.col("w")).alias("cosine"), (F.col("id") == F.col("candidate")).alias("target"))
    return batching.mnrl_loss(pairs).withColumn("loss", F.round("loss", 6))


# Metrics


def qrels_by_containment(spark, sf_dir):
    return _qrels(spark, sf_dir)


def _per_query(spark, sf_dir) -> DataFrame:
    ranked = ranking.bm25_top_k(_documents(spark, sf_dir), _items(spark, sf_dir), 20, WHITESPACE)
    return metrics.per_query_metrics(_items(spark, sf_dir), ranked, _qrels(spark, sf_dir), _read(spark, sf_dir, "labels").select("doc_id"))


def ndcg_mrr_recall_per_query(spark, sf_dir):
    rows = _per_query(spark, sf_dir)
    return rows.select("query_id", "has_qrel", *[F.round(c, 9).alias(c) for c in ("ndcg", "mrr", "recall")], "unjudged_in_top")


def retrieval_summary(spark, sf_dir):
    return metrics.retrieval_summary(_per_query(spark, sf_dir), _documents(spark, sf_dir), _read(spark, sf_dir, "labels"))


def bootstrap_ci(spark, sf_dir):
    rows = _per_query(spark, sf_dir).where("has_qrel").select(F.col("query_id").alias("id"), F.col("mrr").alias("value"))
    out = statistics.bootstrap_intervals(rows, [], 1000, 0.95, "0")
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


def percentile_forms(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").groupBy("lang")
    return rows.agg(F.round(statistics.linear_percentile("n_chars", 0.5), 9).alias("linear_50"), *[statistics.nearest_rank("n_chars", p / 100).cast("long").alias(f"nearest_{p}") for p in (50, 95, 99)])


def _labelled(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id")


def subgroup_report(spark, sf_dir):
    return metrics.subgroup_report(_labelled(spark, sf_dir), {"lang": "lang", "source": "source"}, "quality").withColumn("mean", F.round("mean", 9))


def subgroup_first_seen(spark, sf_dir):
    """Strata of few sizes, so that many tie: a label's last characters, in the order in which they appear."""
    rows = _labelled(spark, sf_dir).withColumns({"tens": (F.col("doc_id") % 50).cast("string"), "ends": F.substring("source", -1, 1)})
    return metrics.subgroup_report(rows, {"tens": "tens", "ends": "ends"}, "quality", "doc_id").withColumn("mean", F.round("mean", 9))


def manifest_issues(spark, sf_dir):
    """Documents as files whose claims are wrong in every way: some lack, some are too many, doubled, of another size or digest."""
    size, digest = F.octet_length(F.col("text")).cast("long"), F.sha2(F.col("text").cast("binary"), 256)
    docs = _read(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("path"), "doc_id", size.alias("bytes"), digest.alias("sha256"))
    claims = docs.where("doc_id % 7 <> 0").select(
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("gone-"), "path")).otherwise(F.col("path")).alias("path"), (F.col("bytes") + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)).alias("bytes"),
        F.when(F.col("doc_id") % 17 == 0, F.sha2(F.col("sha256"), 256)).otherwise(F.upper("sha256")).alias("sha256"), F.when(F.col("doc_id") % 19 == 0, 2).otherwise(1).alias("times"))
    claims = claims.select("path", "bytes", "sha256", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("i")).drop("i")
    return manifests.manifest_issues(claims, docs.select("path", "bytes", "sha256"))


def _script_strata(spark, sf_dir) -> DataFrame:
    dense, plain = T.script_counts(F.col("text"), T.ACCENTED_LATIN)
    rows = _labelled(spark, sf_dir).select("quality", dense.alias("d"), plain.alias("p"))
    names = {f"script_{t}": f"script_{t}" for t in THRESHOLDS}
    rows = rows.select("quality", *[T.script_level(F.col("d"), F.col("p"), t).alias(f"script_{t}") for t in THRESHOLDS])
    return metrics.subgroup_report(rows, names, "quality")


def code_switch_strata(spark, sf_dir):
    return _script_strata(spark, sf_dir).withColumn("mean", F.round("mean", 9))


def mixed_drop(spark, sf_dir):
    return metrics.mixed_drop(_script_strata(spark, sf_dir), base="en")


def strata_intervals(spark, sf_dir):
    """The judged items' metrics by the script mix and the size of their texts."""
    dense, plain = T.script_counts(F.col("text"), T.ACCENTED_LATIN)
    rows = _per_query(spark, sf_dir).where("has_qrel").join(_items(spark, sf_dir).select("query_id", dense.alias("d"), plain.alias("p"), F.length("text").alias("chars")), "query_id")
    rows = rows.select("query_id", "ndcg", "mrr", "recall", F.when(F.col("chars") >= 200, "long").otherwise("short").alias("size"),
                       *[T.script_level(F.col("d"), F.col("p"), t).alias(f"script_{t}") for t in THRESHOLDS]).cache()  # a row a query, read by all that follows
    names = ["size", *[f"script_{t}" for t in THRESHOLDS]]
    out = metrics.strata_intervals(rows, {n: n for n in names}, ["ndcg", "mrr", "recall"], "query_id")
    return out.select("field", "bucket", "metric", "n", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")], "place")


# Multiple choice


def mcq_rank(spark, sf_dir):
    return choice.bm25_ranked(_questions(spark, sf_dir), {"bm25": WHITESPACE}).drop("model_key")


def mcq_longest_baseline(spark, sf_dir):
    return choice.baselines(_questions(spark, sf_dir)).select("question_id", F.round("longest_option_hit", 9).alias("longest_option_hit"), F.round("random_hit", 9).alias("random_hit"))


def mcq_summary(spark, sf_dir):
    questions = _questions(spark, sf_dir)
    ranked = choice.bm25_ranked(questions, {"bm25": WHITESPACE}).drop("model_key")
    return choice.choice_summary(choice.answer_rows(ranked).join(choice.baselines(questions), "question_id"))


def dense_mcq_rank(spark, sf_dir):
    """Each vector's options are the vectors of the next five ids that exist; the right one is the first with its label, or the first."""
    rows = _vectors(spark, sf_dir)
    wanted = rows.select("vec_id", "v", "label", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("j")).withColumn("other", F.col("vec_id") + F.col("j"))
    given = rows.select(F.col("vec_id").alias("other"), F.col("v").alias("w"), F.col("label").alias("of"))
    grouped = wanted.join(given, "other").groupBy("vec_id", "v", "label").agg(F.array_sort(F.collect_list(F.struct("j", "w", "of"))).alias("os"))
    gold = F.greatest(F.array_position(F.transform("os", lambda o: o["of"]), F.col("label")).cast("int"), F.lit(1))
    questions = grouped.select(F.col("vec_id").alias("question_id"), "v", F.transform("os", lambda o: o["w"]).alias("option_vectors"), gold.alias("answer_index"))
    options = questions.select("question_id", (F.col("answer_index") - 1).alias("gold"), F.posexplode("option_vectors").alias("idx", "w")).drop("w")
    return choice.rank_options(options, choice.vector_option_scores(questions))


# Pairs


def _pair_tables(spark, sf_dir):
    pairs = _exchanges(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("record_id"), F.lit("all").alias("split"), "question", "answer", (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("seq"))
    return pairs_tables(pairs, "all")


def pairs_task_corpus(spark, sf_dir):
    return _pair_tables(spark, sf_dir).corpus


def pairs_task_qrels(spark, sf_dir):
    return _pair_tables(spark, sf_dir).qrels


# Comparison of models


def exam_exact_metrics(spark, sf_dir):
    rows = comparison.exact_metrics(_choices(spark, sf_dir))
    return rows.select("model_key", "questions", "correct_count", F.round("accuracy", 9).alias("accuracy"), F.round("exam_mrr", 9).alias("exam_mrr"))


def _order(spark) -> DataFrame:
    return spark.createDataFrame([(m, i) for i, m in enumerate(MODELS)], "model_key string, position int")


def model_selection(spark, sf_dir):
    rows = comparison.exact_metrics(_choices(spark, sf_dir)).withColumn("exam_mrr", F.round("exam_mrr", 9))
    chosen = comparison.selection(rows, _order(spark), ["bm25_flat"], ("correct_count", "exam_mrr"))
    return chosen.select("model_key", "eligible", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("place", "tied_on")])  # 0: not eligible


def selection_trace(spark, sf_dir):
    rows = comparison.exact_metrics(_choices(spark, sf_dir)).withColumn("exam_mrr", F.round("exam_mrr", 9))
    return comparison.selection_trace(rows, _order(spark), ["bm25_flat"], ("correct_count", "exam_mrr"))


def wide_pairs(spark, sf_dir):
    choices = _choices(spark, sf_dir).cache()  # a row a question and model, read for pairs and intervals
    pairs = statistics.discordant_pairs(comparison.model_pairs(choices, "correct"), ["model_a", "model_b"]).withColumn("p_value", F.round("p_value", 9))
    intervals = comparison.paired_intervals(choices).withColumns({c: F.round(c, 9) + 0.0 for c in ("mean", "low", "high")})
    out = comparison.wide_pairs(pairs, intervals)
    return out.select(*[c for c in out.columns if not c.startswith(tuple(comparison.PASSAGE_VALUES))])  # the tables have no passages judged for several models


def zero_shot_deltas(spark, sf_dir):
    rows = comparison.exact_metrics(_choices(spark, sf_dir))
    base = rows.where("model_key = 'bm25'").drop("model_key").crossJoin(_order(spark).select("model_key"))  # one row with each model
    out = comparison.zero_shot_deltas(rows, base, ["accuracy", "exam_mrr"])
    return out.select("model_key", *[(F.round(c, 9) + 0.0).alias(c) for c in ("accuracy_delta", "exam_mrr_delta")])


def pairwise_discordant(spark, sf_dir):
    rows = statistics.discordant_pairs(comparison.model_pairs(_choices(spark, sf_dir), "correct"), ["model_a", "model_b"])
    return rows.withColumn("p_value", F.round("p_value", 9))


def paired_bootstrap(spark, sf_dir):
    pairs = comparison.model_pairs(_choices(spark, sf_dir), "reciprocal_rank")
    rows = statistics.paired_bootstrap(pairs, ["model_a", "model_b"], 1000, 0.95, "0")
    return rows.select("model_a", "model_b", "n", *[(F.round(c, 9) + 0.0).alias(c) for c in ("mean", "low", "high")], "crosses_zero")  # no negative zero


def paired_intervals(spark, sf_dir):
    rows = comparison.paired_intervals(_choices(spark, sf_dir))
    return rows.select("model_a", "model_b", "metric", "n", *[(F.round(c, 9) + 0.0).alias(c) for c in ("mean", "low", "high")], "crosses_zero")


def holm_adjusted(spark, sf_dir):
    rows = statistics.holm(statistics.discordant_pairs(comparison.model_pairs(_choices(spark, sf_dir), "correct"), ["model_a", "model_b"]), [])
    return rows.select("model_a", "model_b", F.round("adjusted", 9).alias("adjusted"))


def validate_evidence(spark, sf_dir):
    """Evidence with gaps put in on purpose: a model lacks some ids, another has some twice, one is missing, one unknown."""
    rows = _questions(spark, sf_dir).select(F.col("question_id").alias("query_id"))
    bad = rows.select(F.lit("bm25").alias("model_key"), "query_id").unionByName(rows.where("query_id % 7 <> 0").select(F.lit("bm25_flat").alias("model_key"), "query_id"))
    bad = bad.unionByName(rows.where("query_id % 11 = 0").select(F.lit("bm25").alias("model_key"), "query_id")).unionByName(rows.select(F.lit("stray").alias("model_key"), "query_id"))
    return comparison.evidence_violations(bad, list(MODELS))


# Batches


def quarantine_reasons(spark, sf_dir):
    return batching.quarantine_counts(batching.classify(_triplets(spark, sf_dir), PLAN))


def collision_pairs(spark, sf_dir):
    return batching.collision_pairs(_candidates(spark, sf_dir))


def round_robin_order(spark, sf_dir):
    return batching.round_robin(_candidates(spark, sf_dir), PLAN.seed).select("record_id", "option_len_rank", "turn")


def length_stats(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("negative", F.col("negatives")[0]["text"])
    return batching.length_statistics(rows, ["option_len_rank"])


def token_length_stats(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("negative", F.col("negatives")[0]["text"])
    return batching.token_length_statistics(rows, ["query", "positive", "negative"], 64)


def token_length_gaps(spark, sf_dir):
    return batching.token_length_gaps(_candidates(spark, sf_dir).withColumn("negative", F.col("negatives")[0]["text"]))


def ordered_digest_levels(spark, sf_dir):
    """All levels of the ordered digest of the documents' texts."""
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value"))
    levels = list(digest_levels(numbered_in_order(rows, ["doc_id", "value"]).select("seq", "value"), 64))
    return union_all(levels)


def pack_batches(spark, sf_dir):
    return batching.plan_rows(batching.pack(_candidates(spark, sf_dir), PLAN)).select("batch_id", "number", "place", "record_id", "positive", "negative")


def pack_batches_violations(spark, sf_dir):
    return batching.plan_violations(batching.plan_rows(batching.pack(_candidates(spark, sf_dir), PLAN)), PLAN)


def contiguous_groups(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_type", "event_id")
    return batching.contiguous_groups(rows, "event_type", ["event_id"])


def frozen_sampler_order(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 32).alias("number"))
    return batching.sampler_order(rows, "sampler", 1).select("doc_id", "number", "step")


_QUERIES = (
    bm25_topk, bm25_topk_bigram, bm25_topk_joined, bm25_idf, bm25_doc_len, bm25_corpus_stats, tok_whitespace_tf, tok_bigram_tf, text_clean, text_norm_key, script_levels, hashed_encoding,
    dense_cosine_topk, dense_dot_topk, l2_normalize_vectors, dense_label_metrics, mnrl_batch_loss, qrels_by_containment, ndcg_mrr_recall_per_query, retrieval_summary, bootstrap_ci, percentile_forms,
    subgroup_report, subgroup_first_seen, manifest_issues, code_switch_strata, strata_intervals, mixed_drop, mcq_rank, mcq_longest_baseline, mcq_summary, dense_mcq_rank, pairs_task_corpus, pairs_task_qrels, exam_exact_metrics, model_selection, selection_trace, wide_pairs,
    zero_shot_deltas, pairwise_discordant, paired_bootstrap, paired_intervals, holm_adjusted, validate_evidence, quarantine_reasons, collision_pairs, round_robin_order, length_stats, token_length_stats, token_length_gaps, ordered_digest_levels, pack_batches,
    pack_batches_violations, contiguous_groups, frozen_sampler_order)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from quillrank.oracles import ORACLES

    return dict(ORACLES)
