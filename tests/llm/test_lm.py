import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillrank.llm import lm

from .data import docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = lm.LmParams(words=40, per_class=8, hidden=6, embed=5, window=5, streams=3, updates=20, batch_bytes=20_000, range_bytes=4_000)


def split(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_base_by_brute_force(spark):
    df = docs(spark)
    table = [(r["doc_id"], r["text"]) for r in df.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in table:
        if not held(i):
            counts.update(split(t) + [None])
    n, v = sum(counts.values()), len(counts)
    expect = []
    for i, t in table:
        ws = split(t) + [None]
        expect.append((str(i), held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)))
    got = lm.lm_scores(df, SMALL).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(expect)
    assert any(held(i) for i, _ in table) and all(r["score"] < 0 for r in got)
    assert lm.lm_scores(df.where("false"), SMALL).count() == 0


def network(seed=0, k=21):
    rng = np.random.default_rng(seed)
    net = lm.Network(np.sort(rng.integers(1, 2**63, k).astype(np.uint64))[rng.permutation(k)], SMALL)
    return net, rng


def test_probabilities_sum_to_one():
    net, rng = network()
    h = rng.normal(0, 1, (4, 6)).astype(np.float32)
    every = np.arange(net.k + lm.SHAPES + 1)
    for row in h:
        assert np.exp(net.outputs(np.tile(row[:, None], len(every)), every)).sum() == pytest.approx(1, abs=1e-5)


def test_gradients_by_differences():
    net, rng = network(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(0, net.k + 17, (5, 3)), rng.integers(0, net.k + 17, (5, 3))
    fresh = rng.random((5, 3)) < 0.2
    h0 = rng.normal(0, 0.5, (6, 3))
    _, grads, _ = net.window_gradient(x, y, fresh, h0)
    for name, w in net.w.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if name == "ob" and at[0] >= net.k:
                continue
            keep = w[at]
            losses = []
            for d in (1e-5, -1e-5):
                w[at] = keep + d
                losses.append(net.window_gradient(x, y, fresh, h0)[0])
            w[at] = keep
            assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-3, abs=1e-5)


def slow_logs(net, symbols):
    """Natural-log probability of each symbol, by plain loops over one document."""
    w, n, per = net.w, net.params.hidden, net.params.per_class
    h, before, out = [0.0] * n, net.k + lm.SHAPES, []
    for s in symbols:
        row = [sum(float(a) * float(b) for a, b in zip(w["x"][i], w["e"][before])) + float(w["b"][i, 0]) for i in range(2 * n)]
        gate = [1 / (1 + math.exp(-(row[i] + sum(float(w["u"][i, j]) * h[j] for j in range(n))))) for i in range(n)]
        new = [math.tanh(row[n + i] + gate[i] * sum(float(w["u"][n + i, j]) * h[j] for j in range(n))) for i in range(n)]
        h = [h[i] + gate[i] * (new[i] - h[i]) for i in range(n)]
        dot = lambda m, b, i: sum(float(x) * y for x, y in zip(m[i], h)) + float(b[i, 0])
        logits = [dot(w["c"], w["cb"], i) for i in range(net.classes)]
        own = s // per if s < net.k else net.word_classes + s - net.k
        got = logits[own] - math.log(sum(map(math.exp, logits)))
        if s < net.k:
            words = {i: dot(w["o"], w["ob"], i) for i in range(own * per, min((own + 1) * per, net.k))}
            got += words[s] - math.log(sum(map(math.exp, words.values())))
        out.append(got)
        before = s
    return out


def test_scoring_in_step_equals_one_by_one():
    net, rng = network(2)
    sizes = [1, 1, 40, 7, 3, 0, 12]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    s = rng.integers(0, net.k + 17, bounds[-1])
    together = net.score(s, bounds, block=16)
    for i in range(len(sizes)):
        assert together[i] == pytest.approx(sum(slow_logs(net, s[bounds[i] : bounds[i + 1]].tolist())), abs=1e-3)


def shape_of(word):
    raw = word.encode()
    mark = 1 if raw[-1:] == b"," else 2 if raw[-1:] == b"." else 0 if raw[-1] >= 128 or chr(raw[-1]).isalpha() else 3
    return any(x >= 128 for x in raw) * 8 + mark * 2 + (len(raw) >= 7)


def test_score_by_brute_force(spark):
    """Counts, vocabulary, shapes and the network's formula by plain loops; only the learnt weights are taken over."""
    df = docs(spark).where("length(text) < 3000 or text is null")
    params = lm.LmParams(words=10, per_class=4, hidden=6, embed=5, window=5, streams=3, updates=20, batch_bytes=2_000, range_bytes=1_000, shard_tokens=400, score_tokens=300)
    found, net, _ = lm.learn(df, params, "doc_id", "text")
    table = [(r["doc_id"], r["text"]) for r in df.collect()]
    counts = Counter()
    for i, t in table:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(split(t))
    hash_of = {w: int(lm.batch_tokens(pa.array([w]))[0][0]) for w in {w for _, t in table for w in split(t)}}
    top = sorted((w for w in counts), key=lambda w: (-counts[w], hash_of[w]))[:10]
    assert net.vocabulary.tolist() == [hash_of[w] for w in top]
    mass = Counter()
    for w, c in counts.items():
        if w not in top:
            mass[shape_of(w)] += c + 1
    # Within a shape the known words and one place for unseen ones make up one.
    for kind in {shape_of(w) for w in counts} - {shape_of(w) for w in top}:
        assert sum((c + 1) / (mass[kind] + 1) for w, c in counts.items() if shape_of(w) == kind) + 1 / (mass[kind] + 1) == pytest.approx(1)
    expect = []
    for i, t in table:
        words = split(t)
        symbols = [top.index(w) if w in top else net.k + shape_of(w) for w in words] + [net.k + lm.SHAPES]
        score = sum(slow_logs(net, symbols)) / math.log(10) + sum(math.log10((counts[w] + 1) / (mass[shape_of(w)] + 1)) for w in words if w not in top)
        expect.append((str(i), len(words), score))
    got = sorted((str(r["doc_id"]), r["n_tokens"] - 1, r["score"]) for r in lm.lm_scores(df, params).collect())
    for a, b in zip(got, sorted(expect), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-3, abs=1e-2)


def test_learns_order(spark):
    rng = np.random.default_rng(3)
    cycle = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(150):
        a, n = int(rng.integers(0, 12)), int(rng.integers(20, 60))
        rows.append((i, " ".join(cycle[(a + j) % 12] for j in range(n))))
    params = lm.LmParams(words=40, per_class=8, hidden=12, window=16, streams=8, updates=1200, rate=0.03)
    got = [r for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), params).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.5 * sum(r["base_score"] for r in got)


def test_all_documents_train_the_network(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(8))) for i in range(40)] + [(40 + i, "often seen often") for i in range(4)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    params = lm.LmParams(words=400, per_class=32, hidden=4, window=8, streams=2, updates=1, shard_tokens=100, batch_bytes=200, range_bytes=100)
    found, net, table = lm.learn(df, params, "doc_id", "text")
    counts = Counter(w for _, t in rows for w in split(t))
    h, _, bounds = lm.batch_tokens(df.select("text").toArrow().column(0))
    assert set(net.vocabulary) == set(h) - {lm.END} and len(net.vocabulary) == len(counts) == found.known - 1
    assert table.count() == len(rows) and table.select("shard").distinct().count() > 1
    start = lm.Network(net.vocabulary, params)
    moved = (net.w["e"][: net.k] != start.w["e"][: net.k]).any(1)
    assert moved.all()  # every word of every document was an input
    dealt = lm.learn(df.repartition(7), params, "doc_id", "text")[1]
    assert all(np.allclose(net.w[k], dealt.w[k], atol=1e-4) for k in net.w)
    few = lm.learn(df, lm.LmParams(words=2, per_class=32, hidden=4, window=8, streams=1, updates=1, shard_tokens=100), "doc_id", "text")[1]
    assert few.k == 2 and few.vocabulary[0] in lm.batch_tokens(spark.createDataFrame([("often",)], "text string").toArrow().column(0))[0]
