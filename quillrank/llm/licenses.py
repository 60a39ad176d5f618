"""License scans: ordered signature rules with a keyword prefilter, priorities and interval containment.

A text is first looked through for any keyword at all; only where one stands are its words laid out, one space apart, and
only the rules whose keyword is there are tried.  A rule is a regular expression over the words.  Each match is an interval
of words; an interval that lies inside another one is left out if that one's rule has a higher priority, or the same and
more words, or as many and an earlier place in the table.  All of it is built-in functions on the executors: no shuffle.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases that every scan counts, with their labels.
BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Every phrase and rule has one of these in it, or the word ``cc``; a text without any is not looked at further.
GATE = ("licens", "licenc", "copyright", "cc0", "creative", "domain", "rights", "proprietary", "permission", "redistribut", "advertising", "endorse", "misrepresented",
        "opensource", "clause", "warranties")
GATE_WORD = "(?i)(?<![0-9a-z])cc(?![0-9a-z])"

#: Each family: label, keyword, names as they are written out, identifiers as their words stand, versions.
FAMILIES = (
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", r"agpl", ("1 0", "3", "3 0")),
    ("lgpl", "general", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", r"lgpl", ("2", "2 0", "2 1", "3", "3 0")),
    ("gpl", "general", r"(?:gnu )?general public licen[cs]e", r"(?:gnu )?gpl", ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("gfdl", "documentation", r"gnu free documentation licen[cs]e", r"gfdl", ("1 1", "1 2", "1 3")),
    ("apache", "apache", r"apache (?:software )?licen[cs]e", r"apache", ("1 0", "1 1", "2", "2 0")),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", r"mpl", ("1 0", "1 1", "2", "2 0")),
    ("epl", "eclipse", r"eclipse public licen[cs]e", r"epl", ("1 0", "2 0")),
    ("cddl", "distribution", r"common development and distribution licen[cs]e", r"cddl", ("1 0", "1 1")),
    ("cpl", "common", r"common public licen[cs]e", r"cpl", ("0 5", "1 0")),
    ("eupl", "european", r"european union public licen[cs]e", r"eupl", ("1 0", "1 1", "1 2")),
    ("osl", "open", r"open software licen[cs]e", r"osl", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic", r"academic free licen[cs]e", r"afl", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic", r"artistic licen[cs]e", r"artistic", ("1 0", "2 0")),
    ("bsl", "boost", r"boost software licen[cs]e", r"bsl", ("1 0",)),
    ("python", "python", r"python (?:software foundation )?licen[cs]e", r"psf", ("2", "2 0")),
    ("php", "php", r"php licen[cs]e", r"php", ("3 0", "3 01")),
    ("zpl", "zope", r"zope public licen[cs]e", r"zpl", ("1 1", "2 0", "2 1")),
    ("lppl", "latex", r"latex project public licen[cs]e", r"lppl", ("1 0", "1 1", "1 2", "1 3")),
    ("ofl", "font", r"(?:sil )?open font licen[cs]e", r"ofl", ("1 0", "1 1")),
    ("odbl", "database", r"open database licen[cs]e", r"odbl", ("1 0",)),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", r"ms pl", ()),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", r"ms rl", ()),
    ("ipl", "ibm", r"ibm public licen[cs]e", r"ipl", ("1 0",)),
    ("npl", "netscape", r"netscape public licen[cs]e", r"npl", ("1 0", "1 1")),
    ("apsl", "apple", r"apple public source licen[cs]e", r"apsl", ("1 0", "1 1", "1 2", "2 0")),
    ("qpl", "public", r"q public licen[cs]e", r"qpl", ("1 0",)),
    ("sspl", "server", r"server side public licen[cs]e", r"sspl", ("1 0",)),
    ("busl", "business", r"business source licen[cs]e", r"busl", ("1 1",)),
    ("mulan", "mulan", r"mulan p(?:ermissive|sl)[^ ]*(?: software)? licen[cs]e", r"mulanpsl", ("1 0", "2 0")),
    ("mit", "mit", r"(?:the )?(?:mit|expat) licen[cs]e", r"mit", ()),
    ("x11", "x11", r"x11 licen[cs]e", r"x11", ()),
    ("isc", "isc", r"isc licen[cs]e", r"isc", ()),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib", ()),
    ("bsd", "bsd", r"(?:new |simplified |modified |revised |original )?bsd licen[cs]e", r"bsd", ()),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense", ()),
    ("wtfpl", "want", r"do what the fuck you want to public licen[cs]e", r"wtfpl", ("2",)),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", r"ncsa", ()),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql", ()),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl", ()),
    ("ruby", "ruby", r"ruby licen[cs]e", r"ruby", ()),
    ("vim", "vim", r"vim licen[cs]e", r"vim", ()),
    ("w3c", "w3c", r"w3c (?:software )?(?:notice and )?licen[cs]e", r"w3c", ()),
    ("blueoak", "blue", r"blue oak model licen[cs]e", r"blueoak", ("1 0 0",)),
    ("beerware", "beer", r"beer ?ware licen[cs]e", r"beerware", ()),
)

#: Rules that no family gives: label, keyword, priority, pattern.
SINGLE_RULES = (
    ("mit", "permission", 85, r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "above", 60, r"the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", "permission", 85, r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", 85, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", 86, r"neither the name of (?:[^ ]+ ){1,20}may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", 87, r"all advertising materials mentioning features or use of this software must display"),
    ("zlib", "origin", 85, r"the origin of this software must not be misrepresented"),
    ("gpl", "redistribute", 85, r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl-2.0-or-later", "either", 88, r"either version 2 of the licen[cs]e or (?:at your option )?any later version"),
    ("gpl-3.0-or-later", "either", 88, r"either version 3 of the licen[cs]e or (?:at your option )?any later version"),
    ("apache-2.0", "except", 85, r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", "as", 60, r"distributed on an as is basis without warranties or conditions of any kind"),
    ("mpl-2.0", "source", 85, r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("unlicense", "encumbered", 85, r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public", 50, r"(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("cc0", "cc0", 80, r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "creative", 80, r"creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?"),
    ("all-rights-reserved", "rights", 30, r"all rights reserved"),
    ("proprietary", "confidential", 40, r"(?:proprietary and confidential|confidential and proprietary)"),
    ("copyright-notice", "copyright", 10, r"copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("license-reference", "license", 5, r"licensed under (?:the )?(?:terms of )?(?:the )?[^ ]+"),
    ("license-reference", "licence", 5, r"licenced under (?:the )?(?:terms of )?(?:the )?[^ ]+"),
)


@lru_cache(maxsize=1)
def signature_rules() -> tuple[tuple[str, str, int, str], ...]:
    """The table in order: (label, keyword, priority, pattern over words)."""
    out: list[tuple[str, str, int, str]] = []
    for label, keyword, name, short, versions in FAMILIES:
        out.append((label, keyword, 70, name))
        out.append((label, "spdx", 95, rf"spdx licen[cs]e identifier {short}"))
        for v in versions:
            v_label = f"{label}-{v.replace(' ', '.')}"
            out.append((v_label, keyword, 80, rf"{name}(?: v| version| ver)? ?v?{v}"))
            out.append((v_label, "spdx", 96, rf"spdx licen[cs]e identifier {short} {v}(?: only)?"))
            out.append((f"{v_label}-or-later", "later", 90, rf"{name}(?: v| version)? ?v?{v} or (?:at your option )?(?:any )?later"))
    for version in ("", "1 0", "2 0", "2 5", "3 0", "4 0"):
        for parts in (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd")):
            long = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|ativ)?e?s?(?: works)?"}
            label = "-".join(("cc", *parts, *([version.replace(" ", ".")] if version else [])))
            rank = 72 + 2 * len(parts) + bool(version)
            end = f" {version}" if version else ""
            out.append((label, "cc", rank, rf"cc {' '.join(parts)}{end}"))
            out.append((label, "creative", rank, rf"creative commons {' '.join(long[p] for p in parts)}(?: {version} (?:international|unported|generic)| {version})" if version else rf"creative commons {' '.join(long[p] for p in parts)}"))
            if version:
                out.append((label, "creativecommons", rank, rf"creativecommons org licenses {' '.join(parts)}{end}"))
    for label, end in (("mit", "mit"), ("apache-2.0", "apache 2 0"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-2-clause", "bsd 2 clause"), ("isc", "isc"), ("gpl-3.0", "gpl 3 0"), ("gpl-2.0", "gpl 2 0")):
        out.append((label, "opensource", 78, rf"opensource org licenses {end}"))
    for n, word in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        out.append((f"bsd-{n}-clause", "clause", 82, rf"(?:{n}|{word}) clause bsd"))
        out.append((f"bsd-{n}-clause", "bsd", 82, rf"bsd {n} clause"))
    out += list(SINGLE_RULES)
    return tuple(out)


def _count(padded: Column, phrase: str) -> Column:
    held = F.lit(f" {phrase.replace(' ', '  ')} ")
    return ((F.length(padded) - F.length(F.replace(padded, held, F.lit("")))) / F.length(held)).cast("long")


def _words_in(x: Column) -> Column:
    """Words of a part of the padded layout, where each has a space before and after it."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("long")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score`` and ``n_signatures`` of every row.

    ``score`` is the highest priority among the intervals that remain, over 100, and 0 without any.  A null text counts as
    empty.  Rows are scanned one by one: repeated rows and null ids stay.  A very long text is scanned whole, in time that grows
    with its length and with the signatures in it.  An empty table gives no rows.
    """
    rules = signature_rules()
    keywords = sorted({k for _, k, _, _ in rules})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.lower(text).alias("low"))
    lowered = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    has = reduce(lambda a, b: a | b, [F.contains(F.col("low"), F.lit(w)) for w in GATE])
    has = has | (F.contains(F.col("low"), F.lit("cc")) & F.col("t").rlike(GATE_WORD))
    gated = F.when(has, F.regexp_replace(F.regexp_replace(lowered, f"^{_SEP}|{_SEP}$", ""), _SEP, "  "))
    rows = rows.select("doc_id", F.regexp_count("t", F.lit(_WORD)).cast("long").alias("n_words"), gated.alias("body"))
    rows = rows.withColumn("padded", F.when(F.length("body") > 0, F.concat(F.lit(" "), "body", F.lit(" ")))).drop("body")
    padded = F.col("padded")
    counts = [_count(padded, p) for p, _ in BASE_PHRASES]
    n_base = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in counts])
    firsts, lasts, names = [], [], []
    for (phrase, label), count in zip(BASE_PHRASES, counts):
        held = f" {phrase.replace(' ', '  ')} "
        there = count > 0
        firsts.append(F.when(there, _words_in(F.substring(padded, F.lit(1), F.instr(padded, held) - 1))))
        lasts.append(F.when(there, F.col("n_words") - _words_in(F.substring_index(padded, held, -1)) - len(phrase.split())))
        names.append(F.when(there, F.lit(label)))
    rows = rows.withColumns({"n_base": n_base, "first_word": F.least(*firsts), "last_word": F.greatest(*lasts),
                             "base": F.array_compact(F.array(*names)), "line": F.replace(padded, F.lit("  "), F.lit(" "))})
    table = "array(" + ", ".join(f"named_struct('label', '{label}', 'keyword', '{k}', 'priority', {p}, 'rank', {i}, 'pattern', r'{pattern}')" for i, (label, k, p, pattern) in enumerate(rules)) + ")"
    words = "array(" + ", ".join(f"'{k}'" for k in keywords) + ")"
    rows = rows.withColumn("there", F.expr(f"case when line is not null then filter({words}, k -> contains(line, k)) end"))
    rows = rows.withColumn("tried", F.expr(f"case when size(there) > 0 then filter({table}, r -> array_contains(there, r.keyword) and regexp_like(line, concat(' ', r.pattern, '(?= )'))) end"))
    # A match starts at a space and ends before one: marks that no word holds are put there, and stand at the words before.
    rows = rows.withColumn("found", F.expr(r"""
        flatten(transform(tried, r -> transform(
            filter(transform(split(regexp_replace(line, concat('( ', r.pattern, ')(?= )'), concat(char(1), '$1', char(2))), ' '), (x, i) -> if(contains(x, char(1)), i, -1)), i -> i >= 0),
            i -> struct(r.label as label, r.priority as priority, r.rank as rank, i as start))))"""))
    rows = rows.withColumn("stops", F.expr(r"""
        flatten(transform(tried, r ->
            filter(transform(split(regexp_replace(line, concat('( ', r.pattern, ')(?= )'), concat(char(1), '$1', char(2))), ' '), (x, i) -> if(contains(x, char(2)), i, -1)), i -> i >= 0)))"""))
    rows = rows.withColumn("found", F.expr("zip_with(found, stops, (x, stop) -> struct(x.label as label, x.priority as priority, x.rank as rank, x.start as start, stop as stop))"))
    # By start, longer first, then higher priority: whatever contains an interval stands before it, and is still open there.
    rows = rows.withColumn("found", F.expr("""
        sort_array(transform(found, x -> struct(x.start as start, -x.stop as minus_stop, -x.priority as minus_priority, x.rank as rank, x.label as label)))"""))
    rows = rows.withColumn("kept", F.expr("""
        aggregate(found, struct(cast(array() as array<string>) as labels, 0 as best, 0L as n, cast(array() as array<struct<stop: int, size: int, priority: int, rank: int>>) as open),
            (s, x) -> struct(
                case when exists(s.open, b -> {inside}) then s.labels else array_union(s.labels, array(x.label)) end as labels,
                case when exists(s.open, b -> {inside}) then s.best else greatest(s.best, -x.minus_priority) end as best,
                case when exists(s.open, b -> {inside}) then s.n else s.n + 1 end as n,
                array_append(filter(s.open, b -> b.stop > x.start), struct(-x.minus_stop as stop, -x.minus_stop - x.start as size, -x.minus_priority as priority, x.rank as rank)) as open))""".format(
        inside="b.stop >= -x.minus_stop and b.rank <> x.rank and (b.priority > -x.minus_priority or (b.priority = -x.minus_priority and (b.size > -x.minus_stop - x.start "
               "or (b.size = -x.minus_stop - x.start and b.rank < x.rank))))")))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("kept.labels", F.array().cast("array<string>")))))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
                       F.array_join(labels, ",").alias("labels"), F.greatest(F.coalesce(F.col("kept.best") / 100.0, F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).cast("double").alias("score"),
                       F.coalesce("kept.n", F.lit(0)).cast("long").alias("n_signatures"))
