import zlib

import numpy as np

from quillrank.llm import toxicity

from .data import docs


def corpus(spark, n=900):
    rng = np.random.default_rng(0)
    clean = [f"word{i}" for i in range(300)]
    bad = ["grumble", "snarlish", "vilecomb"]
    rows = []
    for i in range(n):
        words = list(rng.choice(clean, rng.integers(20, 80)))
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)))
        rows.append((i, " ".join(words), y))
    return spark.createDataFrame(rows, "doc_id long, text string, y int")


def test_held_out_accuracy(spark):
    df = corpus(spark)
    labels = df.selectExpr("doc_id", "y as toxic", "1 as quality")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(df.drop("y"), labels).collect()}
    assert len(got) == 900
    truth = {r["doc_id"]: r["y"] for r in df.collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)
    held = [i for i in got if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97


def test_held_out_labels_are_not_learnt(spark):
    df = corpus(spark, 300)
    labels = df.selectExpr("doc_id", "y as toxic")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    a = sorted(map(tuple, toxicity.toxicity_scores(df, labels).collect()))
    assert a == sorted(map(tuple, toxicity.toxicity_scores(df, flipped).collect()))


def test_odd_rows(spark):
    df = docs(spark)
    labels = df.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    got = toxicity.toxicity_scores(df, labels).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.toxicity_scores(df, labels.where("false")).collect()
    assert all(r["score"] == 0.5 for r in none)
    assert toxicity.toxicity_scores(df.where("false"), labels).count() == 0


def test_sparse_weights_by_plain_loops():
    rng = np.random.default_rng(4)
    params = toxicity.FtrlParams(bits=6, epochs=2, l1=0.5, l2=0.3, alpha=0.4)
    rows = [np.unique(rng.integers(0, 64, 12)) for _ in range(200)]
    y = np.array([float(5 in r) for r in rows])
    z, n, bias, nb = [0.0] * 64, [0.0] * 64, 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= params.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * params.l1) / ((params.beta + n[i] ** 0.5) / params.alpha + params.l2)

    for _ in range(2):
        for x, t in zip(rows, y):
            ws = {int(i): weight(i) for i in x}
            g = 1 / (1 + np.exp(-(sum(ws.values()) + bias))) - t
            for i, w in ws.items():
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / params.alpha
                z[i] += g - s * w
                n[i] += g * g
            nb += g * g
            bias -= params.alpha * g / (params.beta + nb**0.5)
    at, w, b = toxicity.train_ftrl(rows, y, params)
    assert np.allclose([weight(i) for i in range(64)], np.bincount(at, w, 64)) and np.isclose(b, bias)
