"""Multiple-choice ranking: each question's options are a corpus of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.text import tokens
from quillrank.functions.vectors import similarity
from quillrank.operators.ranking import SCORE_DECIMALS, Bm25Params, idf


def _gold() -> Column:
    """The right option's index from zero; an answer outside the options fails the query."""
    ok = (F.col("answer_index") >= 1) & (F.col("answer_index") <= F.size("options"))
    return F.when(ok, F.col("answer_index") - 1).otherwise(F.raise_error(F.lit("answer_index is outside the options")).cast("int")).cast("int")


def option_rows(questions: DataFrame) -> DataFrame:
    """``(question_id, text, gold, idx, option)`` from ``(question_id, text, options, answer_index)``, answers from one."""
    return questions.select("question_id", "text", _gold().alias("gold"), F.posexplode("options").alias("idx", "option"))


def _with_scores(questions: DataFrame, models: list[Bm25Params]) -> DataFrame:
    """The questions with an array ``scores``: for each model the scores of all options, null for one that shares no term.

    A question's row holds its whole corpus, so nothing is shuffled; models of one tokenizer share its tokens and counts."""
    kinds = list(dict.fromkeys((p.mode, p.scripts) for p in models))
    rows = questions
    for j, (mode, scripts) in enumerate(kinds):
        rows = rows.withColumns({f"_asked{j}": F.array_distinct(tokens(F.col("text"), mode, scripts)), f"_bags{j}": F.transform("options", lambda o: tokens(o, mode, scripts))})
    for j in range(len(kinds)):
        bags = F.col(f"_bags{j}")
        shared = F.filter(f"_asked{j}", lambda t: F.exists(bags, lambda bag: F.array_contains(bag, t)))
        counted = F.transform(shared, lambda t: F.transform(bags, lambda bag: F.size(bag) - F.size(F.array_remove(bag, t))))
        rows = rows.withColumns({f"_tfs{j}": counted, f"_dls{j}": F.transform(bags, lambda bag: F.size(bag).cast("long"))})
    for j in range(len(kinds)):
        rows = rows.withColumns({f"_avg{j}": F.aggregate(f"_dls{j}", F.lit(0).cast("long"), lambda s, x: s + x) / F.nullif(F.size(f"_dls{j}"), F.lit(0)),
                                 f"_terms{j}": F.transform(f"_tfs{j}", lambda tfs: F.struct(tfs.alias("tfs"), idf(F.size(F.filter(tfs, lambda x: x > 0)), F.size(tfs)).alias("idf")))})

    def scores(p: Bm25Params) -> Column:
        j = kinds.index((p.mode, p.scripts))
        terms, average = F.col(f"_terms{j}"), F.col(f"_avg{j}")

        def score(dl: Column, i: Column) -> Column:
            norm = F.when(average > 0, dl / average).otherwise(F.lit(0.0))
            length = p.k1 * (1 - p.b + p.b * norm)
            total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["idf"] * t["tfs"][i] * (p.k1 + 1) / F.when(t["tfs"][i] > 0, t["tfs"][i] + length).otherwise(F.lit(1.0)))
            return F.when(F.exists(terms, lambda t: t["tfs"][i] > 0), F.round(total, SCORE_DECIMALS))

        return F.transform(f"_dls{j}", score)

    return rows.withColumn("scores", F.array(*[scores(p) for p in models]))


def bm25_option_scores(questions: DataFrame, params: Bm25Params = Bm25Params()) -> DataFrame:
    """``(question_id, idx, score)`` of options that share a term with their question; statistics are of that question's options."""
    return _with_scores(questions, [params]).select("question_id", F.posexplode(F.col("scores")[0]).alias("idx", "score")).where("score is not null")


def bm25_ranked(questions: DataFrame, models: dict[str, Bm25Params]) -> DataFrame:
    """``(model_key, question_id, idx, gold, score, rank)``: :func:`rank_options` of each model's scores, without a join or a sort of
    rows; rows that share an id are questions of their own."""
    rows = _with_scores(questions.withColumn("gold", _gold()), list(models.values()))
    each = F.arrays_zip(F.array(*[F.lit(m) for m in models]).alias("model_key"), F.col("scores"))
    rows = rows.select("question_id", "gold", F.explode(each).alias("m")).select("m.model_key", "question_id", "gold", "m.scores")
    order = F.transform("scores", lambda s, i: F.struct(s.isNull().alias("none"), (-s).alias("less"), F.when(s.isNotNull(), i.cast("string")).alias("tie"), i.alias("idx"), s.alias("score")))
    rows = rows.select("model_key", "question_id", "gold", F.posexplode(F.array_sort(order)).alias("place", "o"))
    return rows.select("model_key", "question_id", F.col("o.idx").alias("idx"), "gold", F.col("o.score").alias("score"), (F.col("place") + 1).alias("rank"))


def vector_option_scores(questions: DataFrame, name: str = "cosine") -> DataFrame:
    """``(question_id, idx, score)`` from ``(question_id, v, option_vectors)``; every option is scored."""
    f = similarity(name)
    rows = questions.select("question_id", F.col("v").cast("array<double>").alias("v"), F.posexplode("option_vectors").alias("idx", "ov"))
    return rows.select("question_id", "idx", F.round(f(F.col("v"), F.col("ov").cast("array<double>")), SCORE_DECIMALS).alias("score"))


def rank_options(options: DataFrame, scores: DataFrame) -> DataFrame:
    """``(question_id, idx, gold, score, rank)``: by score, ties by the index as a string; options without a score follow by index."""
    rows = options.select("question_id", "gold", "idx").join(scores, ["question_id", "idx"], "left")
    none = F.col("score").isNull()
    order = Window.partitionBy("question_id").orderBy(none, F.desc("score"), F.when(~none, F.col("idx").cast("string")), "idx")
    return rows.select("question_id", "idx", "gold", "score", F.row_number().over(order).alias("rank"))


def answer_rows(ranked: DataFrame) -> DataFrame:
    """``([model_key,] question_id, correct, rank, reciprocal_rank)`` of the right option."""
    rows = ranked.where(F.col("idx") == F.col("gold"))
    return rows.select(*[c for c in ("model_key",) if c in ranked.columns], "question_id", (F.col("rank") == 1).alias("correct"), "rank", (1.0 / F.col("rank")).alias("reciprocal_rank"))


def baselines(questions: DataFrame) -> DataFrame:
    """``(question_id, longest_option_hit, random_hit)``: a share of the credit where options tie as longest."""
    sizes = F.transform(F.col("options"), lambda o: F.length(F.coalesce(o, F.lit(""))))
    rows = questions.select("question_id", "answer_index", sizes.alias("s"))
    longest = F.array_max("s")
    ties = F.size(F.filter("s", lambda x: x == longest))
    hit = F.when(F.element_at("s", F.col("answer_index").cast("int")) == longest, 1.0 / ties).otherwise(0.0)
    return rows.select("question_id", hit.alias("longest_option_hit"), (1.0 / F.size("s")).alias("random_hit"))


def choice_summary(per_question: DataFrame) -> DataFrame:
    """One row; zeros for no questions."""
    def mean(name: str):
        return F.round(F.coalesce(F.avg(F.col(name).cast("double")), F.lit(0.0)), 4)

    flags = per_question.withColumn("hit", F.col("correct").cast("int"))
    return flags.agg(F.count("*").alias("questions"), mean("hit").alias("accuracy"), mean("reciprocal_rank").alias("mrr"), mean("random_hit").alias("random_baseline"),
                     mean("longest_option_hit").alias("longest_option_baseline"))
