import random

import numpy as np
import sentencepiece

from quillrank.llm import pieces

from .data import docs, texts

ODD = ["  two  spaces ", " lead", "trail ", "a\n\n\nb\t\tc", "日本語のテキスト。漢字" * 40, "a" * 700, " " * 300, "x y z", "emoji 👩‍👩‍👧 🏳️‍🌈", "12345 678.90", "\u0000\u0001", "𝔘𝔫𝔦", "aéé" * 200,
       "the" * 150, "Ünï" + "ß" * 100 + " naïveté"]


def test_ids_equal_the_library():
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    table = [t or "" for t in texts()] + ODD
    rng = random.Random(9)
    alphabet = "abcdefgh ,.\n  ßéЖ中▂0123THE"
    table += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 260))) for _ in range(200)]
    raw = [t.encode() for t in table]
    p = pieces.load(pieces.public_model())
    ids, at = p.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    for i, t in enumerate(table):
        assert ids[at[i] : at[i + 1]].tolist() == lib.encode(t), t
    back, ends = p.decode(ids, at)
    assert [bytes(back[a:b]).decode() for a, b in zip(ends[:-1], ends[1:])] == table


def slow_best(word, scores, unknown):
    best = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        best[end] = max(((best[s][0] + (scores[word[s:end]] if word[s:end] in scores else unknown), best[s][1] + [(s, end)])
                         for s in range(end) if word[s:end] in scores or s == end - 1), key=lambda x: x[0])
    return best[-1]


def test_viterbi_by_brute_force():
    rng = random.Random(1)
    vocab = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(60)} | {"a", "b"} - {"c"})
    scores = {w: -rng.random() * 9 - len(w) * 0.01 for w in vocab}
    p = pieces.Pieces([("<unk>", 0, 2)] + [(w, s, 1) for w, s in scores.items()], merges=False)
    for n in (1, 2, 7, 15):
        words = ["".join(rng.choice("abcd") for _ in range(n)) for _ in range(50)]
        row, start, end = p.viterbi(np.array([[ord(c) for c in w] for w in words], np.uint32))
        for i, w in enumerate(words):
            mine = [(int(a), int(b)) for r, a, b in zip(row, start, end) if r == i]
            total = sum(scores.get(w[a:b], p.unknown_score) for a, b in mine)
            assert mine[0][0] == 0 and mine[-1][1] == n and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))
            assert abs(total - slow_best(w, scores, p.unknown_score)[0]) < 1e-9


def test_tables(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    df = docs(spark)
    got = pieces.encode_texts(df).collect()
    table = df.select("doc_id", "text").collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((str(r["doc_id"]), list(r["ids"])) for r in got)) == sorted((str(r["doc_id"]), lib.encode(r["text"] or "")) for r in table)
    assert sorted(map(key, pieces.decode_texts(pieces.encode_texts(df)).collect())) == sorted((str(r["doc_id"]), r["text"] or "") for r in table)
    digests = pieces.encoding_digests(df).collect()
    assert len(digests) == len(table) and all(r["round_trip"] for r in digests)
    odd = spark.createDataFrame([(1, [5, 99999999, None, -4]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in pieces.decode_texts(odd).collect()}[2] == ""
    assert pieces.encode_texts(df.where("false")).count() == 0
