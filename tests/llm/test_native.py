import re

from quillrank.llm import licenses, mixing
from quillrank.llm.quality import QualityRules, quality_rules

from .data import docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_base_counts(spark):
    df = docs(spark)
    got = sorted(quality_rules(df).collect(), key=str)
    expect = []
    for r in df.collect():
        t = r["text"] or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        repeat = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 1000 else None
        expect.append((r["doc_id"], len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat and len(repeat) or 0 if repeat is not None else None))
    mine = {}
    for r in got:
        mine.setdefault((r["doc_id"], r["n_words"]), []).append(r)
    assert len(got) == len(expect)
    for doc, n, chars, symbols, dups, repeat in expect:
        r = mine[doc, n][0]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (chars, symbols, dups)
        if repeat is not None:
            assert r["n_repeat_words"] == repeat
        assert r["base_failed"] == (n < 50 or 100 * r["n_repeat_words"] > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules(df.where("false")).count() == 0


def test_quality_verdict(spark):
    prose = ["The road to the mill is long and it was made for the carts that are on it in the season of the harvest, %d." % i + " This is of use to the town." * (i % 3) for i in range(40)]
    prose = [" ".join(prose[i : i + 12]) for i in range(28)]
    junk = ["THE%%% OF### 999$$$ MILL&&& " + "IS%%% LONG### AND*** 8$$$ " * 3 + " ".join(f"W{i}%%% Q{i}###" for i in range(80))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(prose + junk)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules(df, rules=QualityRules(max_repeat_percent=100)).collect()}
    assert all(got[i]["kept"] for i in range(28)) and not got[28]["kept"]


def slow_intervals(words, rules):
    """Matches of every rule over the words, by Python's regular expressions, and what containment leaves of them."""
    line = " " + " ".join(words) + " "
    found = []
    for rank, (label, keyword, priority, pattern) in enumerate(rules):
        if keyword not in line:
            continue
        for m in re.finditer(f"( {pattern})(?= )", line):
            found.append((label, priority, rank, line[: m.start()].count(" "), line[: m.end()].count(" ")))
    inside = lambda a, b: b[3] <= a[3] and a[4] <= b[4] and a[2] != b[2] and (
        b[1] > a[1] or b[1] == a[1] and (b[4] - b[3] > a[4] - a[3] or b[4] - b[3] == a[4] - a[3] and b[2] < a[2]))
    return [a for a in found if not any(inside(a, b) for b in found)]


def gated(text):
    from quillrank.llm.licenses import GATE, GATE_WORD

    return any(w in text.lower() for w in GATE) or bool(re.search(GATE_WORD, text))


LICENSE_TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.", "GNU Lesser General Public License v2.1 or later. All\nrights reserved",
    "Licensed under CC BY-NC 4.0. cc_by cc by cc BY", "Released under the MIT License. MIT license MIT license", "Apache License, Version 2.0; apache license apache  license",
    "SPDX-License-Identifier: BSD-3-Clause and SPDX-License-Identifier: GPL-2.0-only", "https://creativecommons.org/licenses/by-sa/4.0/ Creative Commons Attribution-ShareAlike 4.0 International",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "gnu general public licensee", "émit license mit licenseé", "cc0 1.0 Universal copyright (c) 2019",
    "redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the X Y nor may be used to endorse or promote products",
]


def test_license_scan_by_plain_loops(spark):
    from quillrank.llm.licenses import BASE_PHRASES, license_scan, signature_rules

    rules = signature_rules()
    assert len(rules) > 250
    table = [r["text"] for r in docs(spark, False).select("text").collect()] + LICENSE_TEXTS + [" ... ".join(LICENSE_TEXTS * 3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(table)], "doc_id long, text string").selectExpr("*", "'x' as line", "1 as found", "2 as n_base", "'k' as kept")
    got = {r["doc_id"]: r for r in license_scan(df).collect()}
    assert len(got) == len(table)
    for i, t in enumerate(table):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for phrase, label in BASE_PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places)), t
        starts = [k for k, _ in places]
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        kept = slow_intervals(words, rules) if gated(t or "") else []
        assert r["labels"] == ",".join(sorted({x for _, x in places} | {a[0] for a in kept})), t
        assert r["n_signatures"] == len(kept) and 0 <= r["score"] <= 1
    assert license_scan(df.where("false")).count() == 0


def test_every_rule_has_a_gate_word():
    from quillrank.llm.licenses import BASE_PHRASES, signature_rules

    for _, keyword, _, pattern in signature_rules():
        plain = pattern.replace("licen[cs]e", "license")
        assert gated(plain), pattern
        assert keyword in plain or keyword in ("later", "library"), pattern
    assert all(gated(p) for p, _ in BASE_PHRASES)


def test_poisson_inversion_and_rates(spark, monkeypatch):
    import math

    from pyspark.sql import functions as F

    from quillrank.llm.mixing import MixParams, mix_sources, poisson_count, source_rates

    us = [0.0, 0.05, 0.3, 0.5, 0.77, 0.9, 0.999, 1 - 2**-52]
    rows = [(u, rate) for u in us for rate in (0.0, 0.2, 1.0, 3.7, 40.0, 480.0)]
    df = spark.createDataFrame(rows, "u double, rate double").withColumn("k", poisson_count(lambda j: F.col("u"), F.col("rate")))
    for r in df.collect():
        k, p = 0, math.exp(-r["rate"])
        c = p
        while r["rate"] and r["u"] >= c and k < 2000:
            k += 1
            p *= r["rate"] / k
            if c + p == c and k > r["rate"]:
                break
            c += p
        assert r["k"] == k or r["u"] > 1 - 1e-9
    big = spark.range(200).select(F.rand(1).alias("u"), F.lit(2000.0).alias("rate")).withColumn("k", poisson_count(lambda j: (F.col("u") * 977 + j * 0.618) % 1, F.col("rate")))
    assert abs(big.agg(F.avg("k")).first()[0] - 2000) < 30
    table = spark.range(3000).selectExpr("id as doc_id", "concat('t', id) as text", "case when id % 3 > 0 then 'big' when id % 7 = 0 then null else 'small' end as source", "1 as rate", "2 as copy", "3 as u", "4 as copies")
    params = MixParams(weights={"big": 1.0, "small": 3.0}, size=6000)
    rates = {r["mix_source"]: r["rate"] for r in source_rates(table, params).collect()}
    n = {r["source"]: r["n"] for r in table.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert math.isclose(rates["big"], 6000 * 0.25 / n["big"]) and math.isclose(rates["small"], 6000 * 0.75 / n["small"]) and rates[""] == 0
    mixed = mix_sources(table, params)
    got = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {"big", "small"} and abs(got["big"] - 1500) < 150 and abs(got["small"] - 4500) < 300
    first = [r["doc_id"] for r in mixed.limit(60).collect()]
    assert first != sorted(first) and sorted(map(str, mixed.collect())) == sorted(map(str, mix_sources(table.repartition(7), params).collect()))
    from quillrank.llm import mixing

    whole = sorted(map(str, mixed.collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)  # many sources: the salted join
    assert sorted(map(str, mix_sources(table, params).collect())) == whole
    monkeypatch.undo()
    odd = docs(spark)
    assert mix_sources(odd).where("text is null and doc_id is null").count() == 0
    assert mix_sources(odd.where("false")).count() == 0


def test_many_places_of_one_signature(spark):
    """Linear in the matches of one text: copying the list at each would take minutes."""
    import time

    df = spark.createDataFrame([(1, "mit license " * 40_000), (2, "mit license cc by sa 4 0 mit license")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    assert time.time() - began < 60
    assert (got[1]["n_base"], got[1]["n_signatures"], got[1]["last_word"]) == (40_000, 40_000, 79_998)
    assert (got[2]["n_base"], got[2]["n_signatures"], got[2]["labels"]) == (3, 3, "cc-by,cc-by-sa-4.0,mit"), got[2]


def test_mixing_keeps_columns_of_any_name(spark):
    df = docs(spark).selectExpr("*", "'mine' as row_source", "7 as copies", "'c' as c0", "1 as salt", "'r' as mix_source")
    got = mixing.mix_sources(df)
    assert got.columns == [*df.columns, "copy", "rate", "mix_key"]
    rows = got.collect()
    assert rows and all((r["row_source"], r["copies"], r["c0"], r["mix_source"]) == ("mine", 7, "c", "r") for r in rows)
