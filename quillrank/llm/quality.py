"""Quality rules: base counts, and divergence of character-class and common-word histograms from language references.

All of it is built-in functions.  One pass over the texts makes a narrow table of counts; the references are sums of that
table over every document of a language that passes the base rules; the verdict compares each document with the
reference of the language that its own common words point to.  The references are fitted twice: over all documents that
pass the base rules, then over those of them that the first fit finds typical.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

_SPACE = r"[\x20\x09-\x0D]+"

#: Function words of each language, looked for in lower case with punctuation stripped.
COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "are", "this", "be"),
    "fr": ("le", "la", "les", "et", "des", "du", "un", "une", "dans", "qui", "que", "pour", "est", "pas", "sur", "au"),
    "de": ("der", "die", "und", "das", "von", "den", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "zu"),
    "es": ("el", "los", "las", "por", "con", "para", "una", "del", "se", "no", "su", "al", "lo", "como", "y", "de"),
}
#: The language of texts without a common word; its reference is that of all languages together.
ANY = "any"
CLASSES = ("lower", "upper", "digit", "point", "space", "symbol")


@dataclass(frozen=True)
class QualityRules:
    """Thresholds.  Distances are Jensen-Shannon distances to base two, 0 to 1."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_class_distance: float = 0.165
    min_class_chars: int = 200
    max_word_distance: float = 0.75
    min_common_words: int = 20
    languages: dict[str, tuple[str, ...]] = field(default_factory=lambda: COMMON_WORDS)


def _js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of probabilities."""

    def term(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return (half(a) + half(b)) / 2

    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), total))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def text_counts(docs: DataFrame, id_col: str, text_col: str, rules: QualityRules) -> DataFrame:
    """The base counts and histograms of each row, one pass, no shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = F.size("ws")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    rows = rows.select("doc_id", "t", F.filter(F.split("t", _SPACE), lambda w: w != "").alias("ws"),
                       F.regexp_replace("t", r"[a-zß-öø-ÿ\u0100-\u1FFF\u2C00-\uD7FF]+", "").alias("r1"))
    # Each class is what its removal takes away from what the classes before it left.
    rows = rows.withColumn("r2", F.regexp_replace("r1", _SPACE, ""))
    rows = rows.withColumn("r3", F.regexp_replace("r2", r"[.,;:!?'\"()\-]+", ""))
    rows = rows.withColumn("r4", F.regexp_replace("r3", r"[A-ZÀ-ÖØ-Þ]+", ""))
    rows = rows.withColumn("r5", F.regexp_replace("r4", r"[0-9]+", ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    every = sorted({w for ws in rules.languages.values() for w in ws})
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_words"), (F.length("t") - (F.length("r1") - F.length("r2"))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("r2", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), lines.alias("lines"), "ws",
        F.array(*[x.cast("double") for x in (
            F.length("t") - F.length("r1"), F.length("r3") - F.length("r4"), F.length("r4") - F.length("r5"),
            F.length("r2") - F.length("r3"), F.length("r1") - F.length("r2"), F.length("r5"))]).alias("classes"),
        F.when(n >= 3, F.expr("transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2]))")).alias("h"),
        F.filter(F.transform("ws", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?#*$%&|<>)'\"")))), lambda w: w.isin(every)).alias("common"))
    # Only texts with a repeated window order their windows.
    rows = rows.withColumn("d", F.expr("case when size(h) > size(array_distinct(h)) then sort_array(transform(h, (x, i) -> struct(x, i))) end"))
    rows = rows.withColumn("at", F.expr(
        "sort_array(transform(filter(transform(d, (s, j) -> struct(s.i as i, (j > 0 and s.x = d[greatest(j - 1, 0)].x) or (j < size(d) - 1 and "
        "s.x = d[least(j + 1, size(d) - 1)].x) as twice)), s -> s.twice), s -> s.i))"))
    repeat = F.expr("aggregate(transform(at, (i, j) -> case when j < size(at) - 1 then least(3, at[least(j + 1, size(at) - 1)] - i) else 3 end), 0L, (s, x) -> s + x)")
    def among(ws: tuple[str, ...]) -> Column:
        return F.size(F.filter("common", lambda w: w.isin(*ws)))

    hits = [among(ws) for ws in rules.languages.values()]
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeat, F.lit(0)).cast("long").alias("n_repeat_words"), "classes", "common", F.array(*hits).alias("hits"))
    best = F.array_max("hits")
    language = reduce(lambda c, x: c.when((F.col("hits")[x[0]] == best) & (best > 0), F.lit(x[1])), enumerate(rules.languages), F.when(F.lit(False), F.lit("")))
    language = language.otherwise(F.lit(ANY))
    rows = rows.withColumn("language", language)
    words = reduce(lambda c, x: c.when(F.col("language") == x, F.array(*map(F.lit, rules.languages[x]))), rules.languages, F.when(F.lit(False), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("list", words).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "language",
        F.transform("list", lambda c: F.size(F.filter("common", lambda w: w == c)).cast("double")).alias("histogram"),
        ((F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))).alias("base_failed"))


def language_references(counts: DataFrame, rules: QualityRules) -> DataFrame:
    """``(language, class_ref, word_ref)``: a row for each language of the rules and one for all, from all documents that pass the base rules."""
    n_words = {len(w) for w in rules.languages.values()}
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.get("histogram", F.lit(i))).alias(f"w{i}") for i in range(max(n_words))]
    fine = counts.where(~F.col("base_failed"))
    rows = fine.where(F.col("language") != ANY).groupBy("language").agg(*sums).unionByName(fine.agg(*sums).withColumn("language", F.lit(ANY)))
    return rows.select("language", _shares(F.array(*[f"c{i}" for i in range(len(CLASSES))])).alias("class_ref"),
                       _shares(F.filter(F.array(*[f"w{i}" for i in range(max(n_words))]), lambda x: x.isNotNull())).alias("word_ref"))


def judged(counts: DataFrame, references: DataFrame, rules: QualityRules) -> DataFrame:
    """The counts with ``class_distance``, ``word_distance`` (null where a guard or a missing reference exempts) and ``off``."""
    rows = counts.join(F.broadcast(references), "language", "left")  # at most a row for each language of the rules
    chars = F.aggregate("classes", F.lit(0.0), lambda s, x: s + x)
    common = F.aggregate("histogram", F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumns({
        "class_distance": F.when(F.col("class_ref").isNotNull() & (chars >= rules.min_class_chars), _js_distance(_shares(F.col("classes")), F.col("class_ref"))),
        "word_distance": F.when(F.col("word_ref").isNotNull() & (common >= rules.min_common_words), _js_distance(_shares(F.col("histogram")), F.col("word_ref")))})
    off = (F.coalesce("class_distance", F.lit(0.0)) > rules.max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > rules.max_word_distance)
    return rows.withColumn("off", off).drop("class_ref", "word_ref")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """Base counts, ``base_failed``, the two distances and ``kept`` for every row.

    A null text counts as empty: no words, base_failed.  A text without any common word is compared with the
    character classes of all languages together.  What the minimum-length guards exempt is judged by the base rules alone.  Rows are judged one by one, so
    repeated rows and repeated or null ids stay.  An empty table gives no rows.  Two different windows of one text count as
    one only if their 64-bit hashes are equal.
    """
    counts = cut(text_counts(docs, id_col, text_col, rules))
    typical = judged(counts, language_references(counts, rules), rules).where(~F.col("off"))
    rows = judged(counts, language_references(typical, rules), rules)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("off")).alias("kept"),
                       "language", "class_distance", "word_distance")
