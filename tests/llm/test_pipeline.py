import random

import pytest
import sentencepiece

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quillrank.llm import mixing, pieces, toxicity  # noqa: E402

from .data import docs  # noqa: E402
from .test_pairs_search import similarity  # noqa: E402
from .test_substrings import WORD, slow  # noqa: E402


def corpus(spark, folder):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(600)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows, labels = [], []
    for i in range(260):
        words = [rng.choice(vocab) for _ in range(rng.randrange(60, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vilecomb", "snarlish"])
        text = " ".join(words)
        if i % 7 == 0:
            text += "\n" + passage
        if i % 11 == 3:
            text = rows[i - 1][1]
        rows.append((i, text, "en", f"src{i % 4 if i % 3 else 0}", len(text)))
        labels.append((i, 1, int("vilecomb" in text or "snarlish" in text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, {i: t for i, _, t in labels}


def test_stages_by_plain_loops(spark, tmp_path):
    folder = str(tmp_path)
    rows, toxic = corpus(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
    read = spark.read.parquet(f"{folder}/documents.parquet")
    columns = read.columns
    a, b, c, d, e = (f for _, f in corpus_pipeline.STAGES)
    kept = a(spark, read, folder)
    assert kept.columns == columns
    got = {r["doc_id"]: r for r in kept.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(read, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert set(got) == {i for i in scores if not scores[i]}
    assert sum(toxic[i] for i in got) <= 3 and sum(toxic[i] == 0 for i in toxic) - sum(toxic[i] == 0 for i in got) <= 2

    part = kept.collect()
    words = [WORD.findall(r["text"]) for r in part]
    comp = list(range(len(part)))
    for _ in range(4):
        for i in range(len(part)):
            for j in range(i):
                if similarity(words[i], words[j]) >= 0.8:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    expect = {min(part[j]["doc_id"] for j in range(len(part)) if comp[j] == k) for k in set(comp)}
    assert len(expect) < len(part)
    single = b(spark, kept, folder)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(expect) and single.columns == columns

    cut = c(spark, single, folder)
    assert cut.columns == columns and cut.dtypes == read.dtypes
    pairs = sorted((r["doc_id"], r["text"]) for r in single.collect())
    assert sorted((r["doc_id"], WORD.findall(r["text"])) for r in cut.collect()) == sorted((i, k) for i, _, k in slow(pairs))
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    mixed = d(spark, cut, folder)
    assert mixed.columns == columns
    counts = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(cut).groupBy("doc_id").agg({"copy": "count"}).withColumnRenamed("count(copy)", "copies").collect()}
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert sorted((r["doc_id"], r["text"]) for r in mixed.collect()) == sorted((i, texts[i]) for i, n in counts.items() for _ in range(n))

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    last = sorted((r["doc_id"], list(r["ids"])) for r in e(spark, mixed, folder).collect())
    assert last == sorted((r["doc_id"], lib.encode(r["text"])) for r in mixed.collect())
    assert sorted((r["doc_id"], list(r["ids"])) for r in corpus_pipeline.run(spark, folder).collect()) == last


def test_stages_take_odd_rows(spark, tmp_path):
    df = docs(spark, False)
    df.where("doc_id is not null").selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 3
    single = corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in single]
    assert len(ids) == len(set(ids)) or sum(i == 8 for i in ids) <= 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("false"), str(tmp_path)).count() == 0
