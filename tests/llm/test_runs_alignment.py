"""Periodic runs and the alignment of two tokenizers, held against plain loops."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.llm import crossalign
from quillrank.llm.crossalign import AlignParams, cross_alignment
from quillrank.llm.runs import LEAST, _scales, block_of, find_runs, periodic_runs, run_digests
from tests.llm.data import docs, texts


def plain_runs(w, least=LEAST):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        x = 0
        while x + q < n:
            if w[x] != w[x + q]:
                x += 1
                continue
            s = x
            while x + q < n and w[x] == w[x + q]:
                x += 1
            e = x + q
            if e - s >= max(least, 2 * q) and not any(all(w[i] == w[i + p] for i in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_every_period_has_one_scale():
    for least in (12, 5, 40):
        for q in range(1, 300):
            own = [s for s in _scales(700, least) if s[1] <= q <= s[2]]
            assert len(own) == 1 and 2 * own[0][0] - 1 + q <= max(least, 2 * q) and own[0][0] <= block_of(q, least)


def test_runs_equal_plain_loops():
    rng = random.Random(5)
    for _ in range(700):
        n, v = rng.randint(0, 120), rng.choice([1, 2, 2, 3, 5, 50])
        w = [rng.randrange(v) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 3:
                a, p, size = rng.randrange(n), rng.randint(1, 40), rng.randint(1, n)
                for i in range(a + p, min(n, a + size)):
                    w[i] = w[i - p]
        assert [tuple(r) for r in find_runs(np.array(w, np.int64)).tolist()] == plain_runs(w)


def test_run_query_equals_plain_loops(spark):
    df = docs(spark)
    want = Counter()
    for r in df.collect():
        words = (r["text"] or "").encode().split()
        n, h = len(words), None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [x if i < a else words[a + (i - a) % p] for i, x in enumerate(words)]
        runs = plain_runs(words) if n < 1000 else [tuple(x) for x in find_runs(np.array([zlib.crc32(x) for x in words])).tolist()]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        want[(r["doc_id"], len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest(),
              hashlib.sha256(b" ".join(x for i, x in enumerate(words) if i not in gone)).hexdigest())] += 1
    got = run_digests(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want
    assert run_digests(df.limit(0)).count() == 0


def test_runs_and_collapsed_text(spark):
    rows = spark.createDataFrame([("a", "x y z " * 5 + "end"), ("b", None), ("c", "no run here")], "id string, body string")
    got = {r["id"]: r for r in periodic_runs(rows, "id", "body").withColumnRenamed("doc_id", "id").collect()}
    assert [tuple(x) for x in got["a"]["runs"]] == [(0, 15, 3)] and got["a"]["collapsed"] == "x y z end"
    assert got["b"]["runs"] == [] and got["b"]["collapsed"] == "" and got["c"]["collapsed"] == "no run here"


@pytest.fixture(scope="module")
def both():
    return crossalign._tokenizers(None, None, 1 << 18)


def plain_alignment(rows, both):
    """Whole texts, tokens side by side, a loop for each pair."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    whole.encode_special_tokens = True
    of = crossalign._byte_characters()
    found, counts = [], Counter()
    for doc, text in rows:
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        raw_a = [bytes(of[c] for c in whole.id_to_token(i)) for i in a]
        raw_b = [bytes([int(both.b.id_to_piece(i)[3:5], 16)]) if both.b.is_byte(i) else both.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(raw_a) != b" " + text.encode() or b"".join(raw_b) != b" " + text.encode():
            a, b, raw_a, raw_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(ends_a[i] - len(raw_a[i]), ends_b[j] - len(raw_b[j])) < min(ends_a[i], ends_b[j])]
        groups, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            x, y = i, j
        counts.update(links)
        found.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return Counter((d, na, nb, ng, len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), sha) for d, na, nb, ng, ls, sha in found)


def test_alignment_equals_plain_loops(spark, both):
    odd = ["▁ mark", "a ▁b ▁ c", "<s> </s> <unk> <|endoftext|> <0x0A>", "日本 語 \xa0 x　y", "ﬁ  two  spaces ", "\x00nul \x1c sep", "don't we'll 😀 é", " lead", "trail \n"]
    rows = [(i, t) for i, t in enumerate([t for t in texts() if t is None or len(t) < 3000] + odd + odd[:3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_alignment(rows, both)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for params in (AlignParams(), AlignParams(remembered=40, posting_rows=3)):  # units forgotten, ids in many streams
        got = cross_alignment(df.withColumns({"key": F.lit("clash"), "pair": F.lit(1)}), params)
        assert got.columns == names and Counter(tuple(r) for r in got.collect()) == want
    assert cross_alignment(df.limit(0)).count() == 0


def test_units_are_encoded_as_whole_texts(both):
    rng = random.Random(1)
    signs = [" ", "  ", "\n", "\t", "a", "b", "the", "The", "'s", ".", ",", "▁", "é", "\xa0", "　", "日", "本", "1", "23", "<s>", "<|endoftext|>", "\x1c", "\x85", "😀", "\x00", "\r\n", "ﬁ", "́", "Ⅷ"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 25)))
        a, b = both.encode(crossalign._CUT.split(text))
        assert [i for x in a for i in x] == both.a.encode_ordinary(" " + text) and [i for x in b for i in x] == both.b.encode(text)
