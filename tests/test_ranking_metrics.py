import math
import re

import pytest
from pyspark.sql import functions as F

from quillrank.functions.text import python_tokenizer
from quillrank.operators import choice, encoding, metrics, ranking


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def docs(spark):
    return frame(spark, [("d1", "고혈압 환자 관리"), ("d2", "폐렴 항생제 치료"), ("d3", "당뇨 식이 요법")], "doc_id string, text string")


def slow_bm25(corpus, query, mode, k1=1.2, b=0.75):
    cut = python_tokenizer(mode)
    bags = {d: cut(t) for d, t in corpus}
    n, avg = len(bags), sum(map(len, bags.values())) / max(1, len(bags))
    out = {}
    for term in set(cut(query)):
        df = sum(term in ts for ts in bags.values())
        for d, ts in bags.items():
            tf = ts.count(term)
            if tf:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                out[d] = out.get(d, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ts) / avg))
    return sorted(out.items(), key=lambda x: (-round(x[1], 7), x[0]))


def test_bm25(spark):
    q = frame(spark, [("q", "폐렴 항생제"), ("z", "zzzz"), ("e", "")], "query_id string, text string")
    rows = ranking.bm25_top_k(docs(spark), q, 3).collect()
    assert rows[0]["doc_id"] == "d2" and {r["query_id"] for r in rows} == {"q"}
    assert ranking.bm25_top_k(docs(spark).where("false"), q, 3).count() == 0
    assert ranking.bm25_top_k(docs(spark), q.where("false"), 3).count() == 0
    with pytest.raises(ValueError):
        ranking.bm25_top_k(docs(spark), q, 0)


@pytest.mark.parametrize("mode", ["whitespace", "char_bigram"])
@pytest.mark.parametrize("block", [4096, 0])
def test_bm25_by_plain_loops(spark, mode, block):
    import random

    rng = random.Random(4)
    words = ["심근", "경색증", "alpha", "Beta", "gamma", "폐렴", "a1", "delta"]
    corpus = [(f"d{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [("d0x", "alpha alpha"), ("d0y", "alpha alpha")]
    asked = [(f"q{i}", " ".join(rng.choice(words) for _ in range(4))) for i in range(6)]
    rows = ranking.bm25_top_k(frame(spark, corpus, "doc_id string, text string"), frame(spark, asked, "query_id string, text string"), 7, ranking.Bm25Params(mode=mode, block_queries=block)).collect()
    for q, text in asked:
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        expect = slow_bm25(corpus, text, mode)[:7]
        assert [r["doc_id"] for r in mine] == [d for d, _ in expect] and [r["rank"] for r in mine] == list(range(1, len(expect) + 1))
        assert all(abs(r["score"] - s) < 1e-6 for r, (_, s) in zip(mine, expect))


@pytest.mark.parametrize("block", [2, 4096])
def test_bm25_visits_leave_no_pairs_to_shuffle(spark, block, monkeypatch):
    """Groups of documents meet blocks of queries; pairs are scored and cut to the best in the task."""
    monkeypatch.setattr(ranking, "GROUP_DOCS", 20)
    monkeypatch.setattr(ranking, "SCORE_CELLS", 16)
    corpus = [(i % 60, " ".join(f"w{i * j % 13}" for j in range(i % 9))) for i in range(70)] + [(None, "w1 w2"), (99, None)]
    asked = [(q, f"w{q} w{q * 3 % 13} w{q * 5 % 17} none") for q in range(9)] + [(None, "w1 w1"), (50, ""), (1, "w7")]
    d, q = frame(spark, corpus, "doc_id int, text string"), frame(spark, asked, "query_id int, text string")
    params = ranking.Bm25Params(mode="whitespace", block_queries=block)
    scores = ranking.bm25_scores(d, q, params)
    assert not re.search(r"hashpartitioning\(query_id#\w+, row", scores._jdf.queryExecution().toString())
    texts = {}
    for i, text in asked:
        texts[i] = texts.get(i, "") + " " + text
    expect = {i: slow_bm25([((str(x) if x is not None else "", n), t or "") for n, (x, t) in enumerate(corpus)], text, "whitespace") for i, text in texts.items()}
    flat = sorted(((-1 if i is None else i), x, round(v, 7)) for i, rows in expect.items() for (x, _), v in rows)
    assert sorted((-1 if r[0] is None else r[0], "" if r[1] is None else str(r[1]), round(r[2], 7)) for r in scores.collect()) == flat
    best = {}
    for r in sorted(ranking.bm25_joined_top_k(d, q, 5, params).collect(), key=lambda r: r["rank"]):
        best.setdefault(r["query_id"], []).append(("" if r["doc_id"] is None else str(r["doc_id"]), r["score"]))
    assert best == {i: sorted(((x, round(v, 7)) for (x, _), v in rows), key=lambda t: (-t[1], t[0]))[:5] for i, rows in expect.items() if rows}


@pytest.mark.parametrize("bounds", [{}, {"block_queries": 0}, {"block_pairs": 2}])
def test_bm25_ranks_each_copy_of_a_document(spark, bounds):
    corpus = [("a", "red fox red"), ("a", "red fox red"), ("a", "fox"), ("b", "red hen"), ("c", None), (None, "hen hen"), ("d", "")]
    asked = [("q", "red fox"), ("q", "fox"), ("r", "hen"), ("s", "none")]
    rows = ranking.bm25_top_k(frame(spark, corpus, "doc_id string, text string"), frame(spark, asked, "query_id string, text string"), 4, ranking.Bm25Params(mode="whitespace", **bounds)).collect()
    bags = [(d, (t or "").split()) for d, t in corpus]
    average = sum(len(b) for _, b in bags) / len(bags)
    for q, words in (("q", ["red", "fox"]), ("r", ["hen"]), ("s", ["none"])):
        expect = []
        for d, bag in bags:
            score = 0.0
            for t in words:
                df, tf = sum(t in b for _, b in bags), bag.count(t)
                score += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / average))
            if score:
                expect.append((-round(score, 7), d or ""))
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["rank"], r["doc_id"] or "") for r in mine] == [(i + 1, d) for i, (_, d) in enumerate(sorted(expect)[:4])]
        assert [-r["score"] for r in mine] == pytest.approx([s for s, _ in sorted(expect)[:4]], abs=1e-6)


def test_vector_ranks(spark):
    d = frame(spark, [("d1", [1.0, 0.0]), ("d2", [0.0, 1.0]), ("d3", [0.6, 0.8])], "doc_id string, v array<double>")
    q = frame(spark, [("q", [1.0, 0.0])], "query_id string, v array<double>")
    rows = ranking.vector_top_k(d, q, 3).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in rows] == [("d1", 1.0), ("d3", 0.6), ("d2", 0.0)]
    tie = frame(spark, [("dB", [1.0, 0.0]), ("dA", [1.0, 0.0])], "doc_id string, v array<double>")
    assert [r["doc_id"] for r in ranking.vector_top_k(tie, q, 2).orderBy("rank").collect()] == ["dA", "dB"]
    two = frame(spark, [("x", [3.0, 0.0])], "doc_id string, v array<double>")
    assert ranking.vector_top_k(two, frame(spark, [("q", [2.0, 0.0])], "query_id string, v array<double>"), 1, "dot_product").first()["score"] == 6.0
    with pytest.raises(Exception, match="dimension"):
        ranking.vector_top_k(frame(spark, [("x", [3.0])], "doc_id string, v array<double>"), q, 1).collect()


def scores(spark, ranked, grades, judged=None, **k):
    r = frame(spark, [("q", d, i + 1) for i, d in enumerate(ranked)], "query_id string, doc_id string, rank int")
    g = frame(spark, [("q", d, float(v)) for d, v in grades.items()], "query_id string, doc_id string, grade double")
    j = frame(spark, [(d,) for d in judged], "doc_id string") if judged is not None else None
    return metrics.per_query_metrics(frame(spark, [("q",)], "query_id string"), r, g, j, **k).first()


def test_metrics(spark):
    assert scores(spark, "xya", {"a": 1})["ndcg"] == pytest.approx(0.5)
    assert scores(spark, "ba", {"a": 3, "b": 1})["ndcg"] == pytest.approx(0.79670758)
    far = scores(spark, [*"bcdefghijk", "a"], {"a": 1})
    assert far["ndcg"] == 0 and far["mrr"] == 0 and far["recall"] == 1
    assert scores(spark, "xya", {"a": 1})["mrr"] == pytest.approx(1 / 3)
    assert scores(spark, "xa", {"a": 1, "b": 1})["recall"] == 0.5
    none = scores(spark, "xa", {"b": 0})
    assert not none["has_qrel"] and none["ndcg"] == none["recall"] == 0
    assert scores(spark, "xyab", {"a": 1}, judged=["x"])["unjudged_in_top"] == 2
    twice = scores(spark, "aa", {"a": 1})
    assert twice["ndcg"] == pytest.approx(1 + 1 / math.log2(3)) and twice["recall"] == 1


def test_summary_counts_only_scored_queries(spark):
    rows = frame(spark, [("a", True, 1.0, 1.0, 1.0, 3), ("b", True, 0.0, 0.5, 0.0, 1), ("c", False, 0.0, 0.0, 0.0, 9)], "query_id string, has_qrel boolean, ndcg double, mrr double, recall double, unjudged_in_top long")
    s = metrics.retrieval_summary(rows, docs(spark), docs(spark).limit(2)).first()
    assert (s["queries_total"], s["queries_scored"], s["queries_without_qrel"], s["ndcg"], s["mrr"], s["unjudged_in_top"]) == (3, 2, 1, 0.5, 0.75, 2.0)
    assert (s["corpus_documents"], s["judged_documents"]) == (3, 2)
    assert metrics.retrieval_summary(rows.where("false"), docs(spark), docs(spark)).first()["ndcg"] == 0.0


def test_strata(spark):
    rows = frame(spark, [("a", None, "other", 1.0), ("a", "x", "other", 0.0), ("b", "x", "other", 0.5)], "f string, g string, o string, m double")
    got = {(r["field"], r["bucket"]): (r["n"], r["mean"], r["place"]) for r in metrics.subgroup_report(rows, {"f": "f", "g": "g", "o": "o"}, "m").collect()}
    assert got == {("f", "a"): (2, 0.5, 1), ("f", "b"): (1, 0.5, 2), ("g", "x"): (2, 0.25, 1), ("g", "None"): (1, 1.0, 2)}
    wide = metrics.strata_intervals(rows.withColumn("k", F.col("m") * 2).withColumn("i", F.col("m")), {"f": "f", "o": "o"}, ["m", "k"], "i", 50).collect()
    assert {(r["field"], r["bucket"], r["metric"]): (r["n"], r["mean"], r["place"]) for r in wide} == {
        ("f", "a", "m"): (2, 0.5, 1), ("f", "a", "k"): (2, 1.0, 1), ("f", "b", "m"): (1, 0.5, 2), ("f", "b", "k"): (1, 1.0, 2)}
    ends = {(r["bucket"], r["metric"]): (r["low"], r["high"]) for r in wide}
    assert ends["b", "m"] == (0.5, 0.5) and ends["a", "k"] == tuple(2 * x for x in ends["a", "m"]) == (0.0, 2.0)
    drop = frame(spark, [("t", "ko", 0.8), ("t", "mixed", 0.6), ("u", "ko", 0.8), ("w", "ko", 0.0), ("w", "mixed", 0.1)], "field string, bucket string, mean double")
    assert [tuple(r) for r in metrics.mixed_drop(drop).collect()] == [("t", 0.25)]


def test_vector_products_in_parts(monkeypatch):
    """Single precision only chooses: ties, copies, near ties, zeros, huge and missing numbers equal a plain search in double precision."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 24))
    x[100:200] = x[:100]
    x[200:260] = x[0] + rng.standard_normal((60, 24)) * 1e-8
    x[300:320] = 0
    odd = x.copy()
    odd[5, 0], odd[6, 0], odd[7] = np.nan, 1e200, 1e-200
    monkeypatch.setattr(ranking, "PRODUCT_QUERIES", 32)
    monkeypatch.setattr(ranking, "PRODUCT_DOCS", 128)
    for docs, queries in ((x, x[:150]), (x * 1e6, x[:50]), (x, odd[:40]), (odd, x[:40]), (x[:3], x[:5])):
        for cosine in (True, False):
            s = np.array([(docs * v).sum(1) for v in queries])
            if cosine:
                size = np.sqrt((queries**2).sum(1))[:, None] * np.sqrt((docs**2).sum(1))
                s = np.divide(s, size, out=np.zeros_like(s), where=size != 0)
            s = np.round(s, 7) + 0.0
            q, d, score = ranking._best(queries, docs, 10, cosine)
            for i in range(len(queries)):
                best = np.argsort(-s[i], kind="stable")[:10]
                got = score[q == i]
                assert len(got) == len(best) and np.allclose(got, s[i][best], rtol=1e-13, atol=2e-7, equal_nan=True)
                assert len(set(d[q == i].tolist())) == len(best)
                if not (np.diff(np.sort(s[i][np.isfinite(s[i])])) < 3e-7).any():
                    assert d[q == i].tolist() == best.tolist()
    monkeypatch.undo()
    big = rng.standard_normal((8192, 32))
    tracemalloc.start()
    ranking._best(big[:2048], big, 10, True)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20  # the whole product has 134 MB
    tracemalloc.stop()


def test_choice(spark):
    q = frame(spark, [("a", "alpha beta", ["gamma", "alpha", "alpha beta", "zeta"], 3), ("b", "none", ["x", "yy", "yy"], 2)], "question_id string, text string, options array<string>, answer_index int")
    ranked = choice.rank_options(choice.option_rows(q), choice.bm25_option_scores(q))
    order = {k: [r["idx"] for r in sorted((r for r in ranked.collect() if r["question_id"] == k), key=lambda r: r["rank"])] for k in "ab"}
    assert order["a"][:2] == [2, 1] and order["a"][2:] == [0, 3] and order["b"] == [0, 1, 2]
    other = ranking.Bm25Params(mode="whitespace", k1=0.4, b=0.0)
    both = choice.bm25_ranked(q, {"own": ranking.Bm25Params(), "other": other})
    rows = lambda d: sorted(map(str, d.select("question_id", "idx", "gold", "score", "rank").collect()))
    assert rows(both.where("model_key = 'own'")) == rows(ranked)
    assert rows(both.where("model_key = 'other'")) == rows(choice.rank_options(choice.option_rows(q), choice.bm25_option_scores(q, other)))
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()  # a question's row is its corpus
    answers = {r["question_id"]: (r["correct"], r["rank"]) for r in choice.answer_rows(ranked).collect()}
    assert answers == {"a": (True, 1), "b": (False, 2)}
    base = {r["question_id"]: r for r in choice.baselines(q).collect()}
    assert base["b"]["longest_option_hit"] == 0.5 and base["a"]["longest_option_hit"] == 1.0 and base["a"]["random_hit"] == 0.25
    assert choice.choice_summary(choice.answer_rows(ranked).join(choice.baselines(q), "question_id").where("false")).first()["accuracy"] == 0.0
    bad = frame(spark, [("a", "t", ["x"], 2)], "question_id string, text string, options array<string>, answer_index int")
    with pytest.raises(Exception, match="outside the options"):
        choice.option_rows(bad).collect()
    many = frame(spark, [("a", [1.0], [[1.0]] * 12, 1)], "question_id string, v array<double>, option_vectors array<array<double>>, answer_index int")
    options = many.select("question_id", F.lit(0).alias("gold"), F.posexplode("option_vectors").alias("idx", "w"))
    rows = sorted(choice.rank_options(options, choice.vector_option_scores(many, "dot_product")).collect(), key=lambda r: r["rank"])
    assert [r["idx"] for r in rows][:4] == [0, 1, 10, 11]


def test_hashed_encoder(spark):
    import hashlib

    text = "급성 COPD alpha alpha"
    df = frame(spark, [("d", text), ("e", "")], "doc_id string, text string")
    for dim in (7, 32, 100):
        got = {r["doc_id"]: r["v"] for r in encoding.hashed_vectors(df, dim).collect()}
        expect = [0.0] * dim
        for t in python_tokenizer("char_bigram")(text):
            expect[int(hashlib.md5(t.encode()).hexdigest(), 16) % dim] += 1
        assert got["d"] == expect and got["e"] == [0.0] * dim
    short = {r["doc_id"]: sum(r["v"]) for r in encoding.hashed_vectors(df, 32, max_length=2).collect()}
    assert short["d"] == 1.0


COUNTED = [(i, f"alpha beta{i} 고혈압 Ä x{i % 3} alpha") for i in range(200)] + [(900, None), (901, "")]
SHARED_IDS = [(7, "alpha once more"), (7, ""), (None, "alpha"), (None, "alpha 폐렴"), (901, "late")]


def counts_by_id(spark, mode, count, of=lambda t: t):
    """Counts where ids are of one row each, which need no shuffle, and where rows that share an id, null too, are summed."""
    for rows in (COUNTED, COUNTED + SHARED_IDS):
        expect = {}
        for d, text in rows:
            for t in python_tokenizer(mode)(text or ""):
                expect[d, of(t)] = expect.get((d, of(t)), 0) + 1
        got = count(frame(spark, rows, "doc_id int, text string").repartition(3))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((*k, n)) for k, n in expect.items())
        if rows is COUNTED:
            assert "hashpartitioning" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("mode", ["whitespace", "char_bigram"])
def test_terms_are_counted_where_texts_are_read(spark, mode):
    counts_by_id(spark, mode, lambda df: ranking.term_frequencies(df, mode))


@pytest.mark.parametrize("mode", ["whitespace", "char_bigram"])
def test_slots_are_counted_where_texts_are_read(spark, mode):
    import hashlib

    counts_by_id(spark, mode, lambda df: encoding.hashed_slots(df, 100, None, mode), lambda t: int(hashlib.md5(t.encode()).hexdigest(), 16) % 100)
    assert encoding.hashed_slots(docs(spark), 100).dtypes == [("doc_id", "string"), ("slot", "int"), ("c", "bigint")]
    with pytest.raises(ValueError, match="dim"):
        encoding.hashed_slots(docs(spark), 0)


def test_encoders_are_registered_and_checked(spark):
    class Sizes:
        max_length = 8

        def __call__(self, texts, role):
            return [[float(len(t)), 1.0 if role == "query" else 0.0] for t in texts]

    encoding.register_encoder("sizes", Sizes)
    try:
        rows = encoding.encode(docs(spark), "sizes", "query", prefix="q: ", batch=2, max_length=8).collect()
        assert {r["v"][0] for r in rows} == {12.0, 12.0, 11.0} and all(r["v"][1] == 1.0 for r in rows)
        with pytest.raises(encoding.EncoderError, match="applies 8"):
            encoding.encode(docs(spark), "sizes", "query", max_length=512)
    finally:
        encoding.ENCODERS.pop("sizes")
    with pytest.raises(encoding.EncoderError, match="unknown"):
        encoding.encode(docs(spark), "nothing", "query")


def test_containment(spark):
    import random

    from quillrank.operators.containment import containment_pairs

    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["ab", "b", "cab", "", "d\ne"]) for _ in range(n))
    texts = [say(rng.randrange(0, 40)) for _ in range(80)]
    asked = ["", "b", "ab b", *[t[rng.randrange(0, 5) :][: rng.randrange(1, 60)] for t in texts if len(t) > 10]]
    docs_ = frame(spark, list(enumerate(texts)) + [(999, None)], "doc_id long, text string")
    got = {tuple(r) for r in containment_pairs(docs_, frame(spark, list(enumerate(asked)), "query_id long, text string")).collect()}
    assert got == {(q, d) for q, p in enumerate(asked) for d, t in enumerate(texts) if p in t}


def test_containment_of_passages_of_every_length(spark, monkeypatch):
    """One piece to many, with empty pieces and pieces that are parts of words: all pairs as a plain search gives them."""
    import random

    from quillrank.operators import containment

    rng = random.Random(6)
    words = ["aa", "ab", "b", "abc", "", "c", "ba"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(120)] + [(500, None)]
    passages = [(f"p{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(90)]
    want = {(p, d) for p, x in passages for d, t in docs if t is not None and x in t}
    monkeypatch.setattr(containment, "SHORT_BLOCK", 20)
    got = containment.containment_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "query_id string, text string")).collect()
    assert len(got) == len(want) > 500 and {(r["query_id"], r["doc_id"]) for r in got} == want


def test_strata_by_first_appearance(spark):
    rows = spark.createDataFrame([(3, "z", 1.0), (1, "y", 0.0), (2, "a", 1.0), (4, "a", 1.0), (5, "z", 0.0), (6, None, 1.0)], "at int, f string, m double").repartition(3)
    got = metrics.subgroup_report(rows, {"f": "f"}, "m", "at").orderBy("place").collect()
    assert [(r["bucket"], r["n"]) for r in got] == [("a", 2), ("z", 2), ("y", 1), ("None", 1)] and got[0].asDict().keys() == {"field", "bucket", "n", "mean", "place"}
