"""The hash-prefix forest against brute force."""

import numpy as np
from pyspark.sql import functions as F

from quillrank.llm.forest import Directory, ForestParams, best_of, nearest, strings

SCHEMA = "vec_id long, embedding array<double>, v string, t string, c int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash", 0) for i, v in rows], SCHEMA)


def brute(rows, every=20, k=20):
    """Every pair of distinct (id, vector) rows; the first vector of a query id asks."""
    fine = sorted({(i, tuple(float(a) for a in v)) for i, v in rows if i is not None and v and all(a is not None and np.isfinite(a) for a in v) and any(v)})
    out, asked = {}, {}
    for i, v in fine:
        if i % every == 0:
            asked.setdefault(i, v)
    for q, v in asked.items():
        found = [(-float((np.array(v) * np.array(x)).sum()), i) for i, x in fine if i != q and len(x) == len(v)]
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return {q: x for q, x in out.items() if x}


def answers(df, **more):
    out = {}
    for r in nearest(df, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_odd_rows_equal_brute_force(spark):
    """So few rows that every query reaches the root: nulls, zeros, copies, ties, repeated rows and ids, two lengths."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(150)]
    copy = rows[7][1]
    rows += [(i, copy) for i in range(200, 260)] + [(60, rows[3][1]), (61, rows[3][1]), (61, rows[3][1]), (20, rows[5][1])]
    rows += [(300, None), (320, []), (340, [0.0] * 6), (360, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (380, [float("nan")] * 6), (400, [float("inf")] + [0.0] * 5), (None, copy), (440, [1.0, 2.0]), (460, [3.0, -1.0])]
    assert answers(table(spark, rows)) == brute(rows)
    assert answers(table(spark, rows), params=ForestParams(block_rows=16, block_queries=2), every=10, k=3) == brute(rows, 10, 3)
    assert nearest(table(spark, rows).limit(0)).count() == 0


def test_recall_of_prefixes_and_crowded_blocks(spark):
    """Ranges of prefixes in many blocks, with a group of near copies and lengths that differ: at least 0.9 of the nearest, and true scores."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 16)) * rng.uniform(0.5, 2, (4000, 1))
    x[1000:2000] = x[17] + 1e-4 * rng.normal(size=(1000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = answers(table(spark, rows), params=ForestParams(reach=20.0, block_rows=128, block_queries=16))
    scores = x[::20] @ x.T
    found = 0
    for place, q in enumerate(range(0, 4000, 20)):
        order = [i for i in np.lexsort((np.arange(4000), -scores[place])) if i != q][:20]
        found += len({i for i, _ in got[q]} & set(order))
        assert len(got[q]) == 20 and all(abs(s - float(x[q] @ x[i])) < 1e-9 for i, s in got[q])
    assert found / (200 * 20) >= 0.9


def test_equal_strings_are_dealt_over_blocks():
    params = ForestParams(trees=1, block_rows=4)
    own = Directory(40, 1.0, [np.array([5] * 30 + [9] * 10)])
    edge = own.bounds(params)[0]
    assert np.searchsorted(edge, 5, "right") - np.searchsorted(edge, 5, "left") >= 5


def test_near_vectors_share_longer_prefixes():
    rng, params = np.random.default_rng(1), ForestParams()
    x = rng.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x + 0.02 * rng.normal(size=x.shape)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    a, b = strings(x, np.zeros(200), params), strings(near, np.zeros(200), params)
    top = params.bits * (params.symbols - 1)
    assert (a >> top == b >> top).mean() > 0.5 > 10 * (a[1:] >> top == b[:-1] >> top).mean()


def test_best_of_ties():
    q, x = np.array([[1.0, 0.0]]), np.array([[1.0, 3.0], [1.0, -2.0], [2.0, 0.0], [0.5, 0.0]])
    i, j, score = best_of(q, x, np.array([9, 4, 7, 1]), 2)
    assert i.tolist() == [0, 0] and j.tolist() == [2, 1] and score.tolist() == [2.0, 1.0]
