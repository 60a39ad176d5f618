import hashlib
import random
import re

import pytest

from quillrank.llm import substrings
from quillrank.llm.substrings import RepeatParams, cut_digests, cut_repeats

from .data import docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, length=20):
    """Kept words of each row by looking at every window."""
    rank = lambda i: (i is None, i or 0)
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            first[key] = min(first.get(key, ((True, 2**64), 0)), (rank(i), s))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (rank(i), s):
                gone |= set(range(s, s + length))
        out.append((i, w, [x for k, x in enumerate(w) if k not in gone]))
    return out


def table(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [say(n) for n in (19, 20, 21, 25, 33, 60)]
    hot = say(70)
    rows = []
    for i in range(160):
        parts = say(rng.randrange(0, 50))
        for _ in range(rng.randrange(0, 3)):
            parts += rng.choice(shared) + say(rng.randrange(0, 6))
        if i % 2:
            copy = list(hot)
            if i % 6 == 1:
                copy[rng.randrange(len(copy))] = "edit"
            parts += copy
        rows.append((rng.randrange(1, 10**6) if i % 9 else i, " ".join(parts) if i % 5 else "\n".join(parts)))
    rows += [rows[3], rows[4], (rows[5][0], "other " + rows[6][1]), (None, rows[7][1]), (None, None), (10**7, " ".join(["x"] * 90)), (10**7 + 1, ""), (10**7 + 2, " ".join(say(30) * 4))]
    return rows


@pytest.mark.parametrize("hot", [5, 1000])
def test_by_brute_force(spark, hot):
    rows = table(hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in cut_digests(df, RepeatParams(hot=hot, batch_bytes=30_000, step=50)).collect())
    expect = sorted((str(i), len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, w, k in slow(rows))
    assert got == expect


def test_hot_windows_walk_over_many_batches(spark):
    """Windows of all documents, keyed whole: Arrow batches of three rows cut their groups anywhere."""
    rows = table(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in cut_digests(df, RepeatParams(hot=2, batch_bytes=400, step=50)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((str(i), len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, w, k in slow(rows))


def test_cut_texts_and_odd_rows(spark):
    df = docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = cut_repeats(df)
    assert got.dtypes == df.dtypes
    mine = sorted((str(r["doc_id"]), WORD.findall(r["text"] or "")) for r in got.collect())
    assert mine == sorted((str(i), k) for i, _, k in slow(rows))
    untouched = {i: (w, k) for i, w, k in slow(rows) if w == k}
    for r in got.where("doc_id is not null and doc_id not in (8, 50)").collect():
        if r["doc_id"] in untouched:
            assert r["text"] == dict(rows)[r["doc_id"]]
    assert cut_digests(df.where("false")).count() == 0 and cut_repeats(df.where("false")).count() == 0


def test_ids_of_other_types(spark):
    df = docs(spark)
    as_text = df.selectExpr("case when doc_id is not null then lpad(cast(doc_id as string), 9, '0') end as doc_id", "text", "1 as number", "2 as own")
    key = lambda r: (str(r["n_words"]), r["n_removed"], r["kept_sha256"])
    a, b = substrings.cut_digests(df).collect(), substrings.cut_digests(as_text).collect()
    assert sorted(map(key, a)) == sorted(map(key, b))
    assert sorted(str(r["doc_id"]).lstrip("0") for r in b) == sorted(str(r["doc_id"]) for r in a)
    cut = substrings.cut_repeats(as_text)
    assert cut.columns == as_text.columns
    assert sorted(str(r["text"]) for r in cut.collect()) == sorted(str(r["text"]) for r in substrings.cut_repeats(df).collect())


def test_words_that_agree_in_their_lower_half_are_apart():
    import numpy as np

    low = np.arange(24, dtype=np.uint64) + np.uint64(1000)
    words = np.stack([low, low | np.uint64(1 << 63), low])
    words[1, :-1] = low[:-1]  # the last word after the anchor differs above the lower 32 bits
    n = len(words)
    marks = substrings.window_marks(np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64) + 20, np.full(n, 12), np.full(n, 12), words[:, :12], words[:, 12:])
    assert marks[0] == 0 and marks[1] == (1 << 13) - 2 and marks[2] == (1 << 13) - 1


def test_batches_follow_the_bytes_of_texts(spark, tmp_path):
    from quillrank.llm.common import batches_of

    spark.range(2000).selectExpr("id as doc_id", "repeat('the same words ', 100) as `the text`").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))  # a few kilobytes on disk
    assert batches_of(stored, 100_000, "the text") == -(-2000 * 1516 // 100_000)
    assert batches_of(stored.where("false"), 100_000, "the text") == 1
