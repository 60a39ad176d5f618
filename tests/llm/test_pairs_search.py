import numpy as np
import pytest
import xxhash

from quillrank.llm import simhash, topk

from .data import docs, texts


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_by_definition():
    for t in texts():
        assert simhash.fingerprint(None if t is None else t.encode()) == slow_fingerprint(t)


def test_blocks_cover_any_five_positions():
    from itertools import combinations

    assert len(simhash.BLOCKS) == 14
    for five in combinations(range(8), 5):
        assert any(set(b) <= set(five) for b in simhash.BLOCKS)


def test_components_by_brute_force(spark):
    rows = simhash.simhash_components(docs(spark)).collect()
    table = docs(spark).select("doc_id", "text").collect()
    assert len(rows) == len(table)
    fps = [slow_fingerprint(r["text"]) for r in table]
    comp = list(range(len(table)))
    for _ in table:
        for i in range(len(table)):
            for j in range(len(table)):
                if bin(fps[i] ^ fps[j]).count("1") <= 3:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    expect = sorted((str(r["doc_id"]), f"{fps[i]:016x}", min((x["doc_id"] for x, c in zip(table, comp) if c == comp[i] and x["doc_id"] is not None), default=None))
                    for i, r in enumerate(table))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in rows) == expect


def test_links_lose_none_among_random_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = [int(x) for x in base]
    for x in base:
        for _ in range(3):
            y = int(x)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= 1 << int(b)
            fps.append(y)
    fps = sorted(set(fps))
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "first_id long, fp long")
    from quillrank.llm.components import connected_components

    roots = {r["node"]: r["root"] for r in connected_components(simhash.near_links(df)).collect()}
    label = {s: s for s in signed}
    for _ in range(8):
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin(a ^ b).count("1") <= 3:
                    label[signed[i]] = label[signed[j]] = min(label[signed[i]], label[signed[j]])
    assert {s: roots.get(s, s) for s in signed} == label


def true_components(fps):
    """Least member of each fingerprint's component, all pairs compared."""
    label = np.arange(len(fps))
    pairs = []
    for i in range(0, len(fps), 256):
        a, b = np.nonzero(np.bitwise_count(fps[i : i + 256, None] ^ fps[None, :]) <= 3)
        pairs.append(np.stack([a + i, b]))
    a, b = np.concatenate(pairs, 1)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("n, shared", [(2049, 5), (2049, 6), (5000, 5), (5000, 6), (20000, 5), (20000, 6), (2049, 7)])
def test_large_postings_lose_no_link(n, shared):
    rng = np.random.default_rng(n + shared)
    varied = 8 * (8 - shared)
    fps = np.unique(rng.integers(0, 1 << varied, n).astype(np.uint64) | np.uint64(0x1122334455667788 >> varied << varied))
    at = {int(f): i for i, f in enumerate(fps)}
    found = {(at[int(p)], at[int(q)]) for a, b in simhash._links_within(fps) for p, q in zip(a, b)}
    assert all(bin(int(fps[i] ^ fps[j])).count("1") <= 24 for i, j in found)
    assert [r for _, r in sorted(components(range(len(fps)), found).items())] == true_components(fps).tolist()


def test_large_posting_through_spark(spark):
    from quillrank.llm.components import connected_components

    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 1 << 24, 3000).astype(np.uint64) | np.uint64(0x11223344 << 32))
    signed = fps.view(np.int64).tolist()
    roots = {r["node"]: r["root"] for r in connected_components(simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    assert [roots.get(s, s) for s in signed] == [signed[i] for i in true_components(fps)]


def test_postings_over_arrow_batches(spark):
    """One posting that many Arrow batches hold parts of."""
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_links_lose_none_among_random_fingerprints(spark)
        test_large_posting_through_spark(spark)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)


def edited(rng, words, n):
    out = list(words)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"edit{rng.integers(10**9)}"
    return out


def similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_texts_by_brute_force(spark):
    """Families of edited texts, all pairs compared exactly: what is clearly alike or apart must come out so."""
    rng = np.random.default_rng(9)
    vocab = [f"word{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        base = [vocab[i] for i in np.minimum(rng.zipf(1.3, 300), 3000) - 1]
        texts += [base, edited(rng, base, 1), edited(rng, base, 3), edited(rng, base, 30), base + edited(rng, base, 300)[:4]]
    texts += [texts[0]] * 40 + [[]] * 3 + [["one"]] * 2
    df = spark.createDataFrame([(i, " ".join(t), "x", 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, kept_id string, p int, node string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(df).collect()}
    assert len(got) == len(texts)
    family = [i // 5 if i < 300 else 0 if t == texts[0] else -i for i, t in enumerate(texts)]
    alike = apart = 0
    for i, a in enumerate(texts):
        for j in range(i):
            if a == texts[j]:
                assert got[i] == got[j]
            elif family[i] == family[j]:
                alike += similarity(a, texts[j]) >= 0.85
                if similarity(a, texts[j]) >= 0.85:
                    assert got[i] == got[j], (i, j)
            else:
                apart += 1
                assert got[i] != got[j], (i, j)
    assert alike > 100 and apart > 10_000
    for i in range(60):  # thirty edits leave too little
        assert got[5 * i + 3] != got[5 * i]
    kept = simhash.keep_representatives(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_large_families_are_divided(spark, monkeypatch):
    """One family of copies of copies, walked whole and in parts of a few: the same components, those of all pairs compared."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in rng.permutation(900)[:160]]
    texts = [base]
    for _ in range(119):
        texts.append(edited(rng, texts[int(rng.integers(0, len(texts)))], int(rng.integers(1, 5))))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    whole = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(df).collect()}
    monkeypatch.setattr(simhash, "FAMILY_ROWS", 17)
    parts = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(df).collect()}
    assert whole == parts and len(set(label)) > 3
    assert sum(whole[i] == label[i] for i in range(len(texts))) >= 0.98 * len(texts)


def test_components_near_the_threshold_are_exact(spark):
    """Pairs at 0.72 to 0.88 and no others: each of 0.8 or more ends together, each below apart, and only texts with a partner go."""
    rng = np.random.default_rng(4)
    texts, want = [], []
    for family in range(260):
        base = [f"f{family}w{i}" for i in rng.permutation(400)[: int(rng.integers(60, 400))]]
        edits = max(1, round(len(base) * rng.uniform(0.012, 0.033)))
        texts += [base, edited(rng, base, edits)]
        want.append(similarity(*texts[-2:]) >= 0.8)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(df).collect()}
    assert all(got[2 * f] == 2 * f for f in range(260))
    assert not any(got[2 * f + 1] == 2 * f for f in range(260) if not want[f])
    met = sum(got[2 * f + 1] == 2 * f for f in range(260) if want[f])
    assert 60 < sum(want) < 200 and met >= 0.98 * sum(want)  # the index alone may miss
    kept = {r["doc_id"] for r in simhash.keep_representatives(df).collect()}
    assert kept == set(got.values())


def test_representatives_of_odd_rows(spark):
    df = docs(spark)
    kept = simhash.keep_representatives(df.selectExpr("*", "1 as kept_id", "2 as component_id", "3 as place", "4 as c0"))
    rows = kept.collect()
    assert kept.columns[-4:] == ["kept_id", "component_id", "place", "c0"]
    assert len({r["text"] for r in rows}) == len(rows) and sum(not (r["text"] or "").strip() for r in rows) == 1
    strings = simhash.keep_representatives(df.selectExpr("cast(doc_id as string) as doc_id", "text")).collect()
    assert len(strings) == len(rows)
    assert simhash.keep_representatives(df.where("false")).count() == 0


def test_walk_spans_components():
    rng = np.random.default_rng(6)
    for n, p in ((700, 0.002), (3000, 0.0002), (600, 0.0)):
        link = np.triu(rng.random((n, n)) < p, 1)
        link |= link.T | np.eye(n, dtype=bool)
        a, b = simhash._walk(n, lambda x, y: link[np.ix_(x, y)], step=64, width=100)
        i, j = np.nonzero(link)
        assert components(range(n), set(zip(a.tolist(), b.tolist()))) == components(range(n), set(zip(i.tolist(), j.tolist())))


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(0, 1, 8).astype(np.float32).tolist()) for i in range(400)]
    vectors[7] = (7, vectors[9][1])
    vectors[50] = (50, vectors[9][1])
    vectors += [(1000, None), (1001, [1.0] * 7 + [None]), (1002, [float("nan")] * 8), (1003, [float("inf")] + [1.0] * 7), (100, vectors[100][1]),
                (1050, [1.0, 2.0, 3.0]), (1004, [2.0, 2.0, 2.0]), (None, [1.0] * 8), (1100, []), (1150, [0.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "'x' as v", "1 as g", "2 as b", "0 as score")
    got = sorted(tuple(r) for r in topk.exact_top_k(df, every=50, k=5).collect())
    ints = [(i, np.floor(np.float32(v).astype(float) * 256).astype(int)) for i, v in vectors
            if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    expect = set()
    for i, q in ints:
        if i % 50 == 0:
            scored = sorted((-int(q @ x), j) for j, x in ints if j != i and len(x) == len(q))[:5]
            expect |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    assert got == sorted(expect)
    assert topk.exact_top_k(df.where("false")).count() == 0


def test_top_k_over_ranges_groups_and_blocks(spark, monkeypatch):
    """Norms of many sizes, groups that are never visited by some blocks, equal norms, repeated rows, other lengths."""
    for name, value in (("GROUP_ROWS", 40), ("QUERY_BLOCK", 3), ("STEP", 16), ("RANGES", 8)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (600, 12)) * np.exp(rng.normal(0, 1.5, (600, 1)))
    x[::7] = np.sign(x[::7])  # ties of norm and score
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(601 + i, x[i].tolist()) for i in range(5)] + [(700 + i, x[i, :3].tolist()) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.exact_top_k(df, every=10, k=5).collect())
    ints = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in vectors]
    expect = set()
    for i, q in ints:
        if i % 10 == 0:
            scored = sorted((-int(q @ v), j) for j, v in ints if j != i and len(v) == len(q))[:5]
            expect |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    assert got == sorted(expect)


def test_search_group_prunes_and_keeps_all():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 1, (5000, 32)) * np.exp(rng.normal(0, 1, (5000, 1))) * 256).astype(np.int64)
    q = x[:40]
    ids = np.arange(5000)
    _, basis = np.linalg.eigh((x.T @ x).astype(float))
    got = topk.search_group(ids[:40], q, np.full(40, np.iinfo(np.int64).min), ids, x, 5, basis[:, ::-1])
    exact = q @ x.T
    for i in range(40):
        exact[i, i] = -(2**62)
        expect = np.lexsort((ids, -exact[i]))[:5]
        mine = got[0] == i
        assert got[1][mine].tolist() == expect.tolist() and got[2][mine].tolist() == exact[i][expect].tolist()


def test_large_posting_with_few_varying_bytes():
    """A sparse pair that differs in every varying byte: no part of the posting by a single byte holds both."""
    rng = np.random.default_rng(11)
    for n_bytes in (3, 2):
        bits = 8 * n_bytes
        x = rng.permutation(1 << min(bits, 20)).astype(np.uint64)[: 1 << 15]
        place = np.zeros(len(x), np.int64)
        for b in range(bits):
            place ^= np.where(x >> np.uint64(b) & np.uint64(1), b + 1, 0)
        far = x[(place == 0) & (np.bitwise_count(x) % 2 == 0)]  # any two differ in four bits or more
        lone = far[0] ^ np.uint64(0x0101 if n_bytes == 2 else 0x010101)  # one bit in each byte
        block = simhash.POSTING_BLOCK
        simhash.POSTING_BLOCK = 64
        try:
            fps = np.unique(np.append(far[:300], lone) << np.uint64(64 - bits) | np.uint64(0x1234))
            found = {tuple(sorted((int(p), int(q)))) for a, b in simhash._links_within(fps) for p, q in zip(a, b)}
        finally:
            simhash.POSTING_BLOCK = block
        near = {tuple(sorted((int(p), int(q)))) for i, p in enumerate(fps) for q in fps[:i] if bin(int(p) ^ int(q)).count("1") <= 3}
        assert near and len(fps) > 64
        label = lambda pairs: components({int(f) for f in fps}, pairs)
        assert label(found) == label(near)


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_texts_travel_to_families_and_not_their_hashes(spark):
    import pyarrow as pa

    from quillrank.llm import simhash

    texts = ["a B c d e f", "", "x y", None, "a b c d e f a b c d e"]
    sets = simhash.shingle_sets(pa.array(texts), 5)
    assert [len(s) for s in sets] == [2, 0, 1, 0, 6] and set(sets[0].tolist()) < set(sets[4].tolist())
    nodes = spark.createDataFrame([(0, 10, b"\0" * 320), (1, 11, b"\xff" * 320)], "node long, x long, p binary")
    links = simhash.verified_links(spark.createDataFrame([(0, 0), (0, 1)], "family long, node long"), nodes, spark.createDataFrame([(10, "a b"), (11, "c d")], "x long, text string"), 5, 0.8)
    assert links.count() == 0 and links._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # the walk alone


def test_sifted_rows_travel_only_if_they_may_be_meant(spark):
    rows = spark.createDataFrame([(i if i % 50 else None, f"t{i}") for i in range(2000)], "k long, t string")
    keys = spark.createDataFrame([(i,) for i in range(1, 2000, 20)] + [(None,), (-5,)], "key long")
    perhaps, alone = simhash.sifted(rows, "k", keys, "key")
    wanted = {r["key"] for r in keys.collect()}
    some, others = [r["k"] for r in perhaps.collect()], [r["k"] for r in alone.collect()]
    assert len(some) + len(others) == 2000 and not wanted & set(others) and wanted - {-5} <= set(some)
    assert len(some) < 300  # 2,000 keys leave few other bits in common
    assert {r["k"] for r in simhash.sifted(rows, "k", keys.where("false"), "key")[1].collect()} == {r["k"] for r in rows.collect()}


def test_representatives_that_have_no_family_stay_where_they_are(spark):
    """Wide rows are shuffled only if they may have to go."""
    texts = [(i, " ".join(f"w{i * 7919 % 1009}x{j}" for j in range(12))) for i in range(40)] + [(50, " ".join(f"w0x{j}" for j in range(12))), (51, None), (52, "")]
    kept = simhash.keep_representatives(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(40), 51]
    assert "sieve_bits" in kept._jdf.queryExecution().toString()
