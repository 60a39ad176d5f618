import math

import pytest
from pyspark.sql import functions as F

from quillrank.functions import text as T
from quillrank.functions import vectors as V

STRINGS = ["급성심근경색", "COPD, 환자!", "가A나", "급 성", "", "Ünï-ço_de ABC", "a1b2가나다3", "환", "  x  "]


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


def test_bigrams(spark):
    got = one(spark, T.tokens(F.col("t")), t="급성심근경색")
    assert got == ["급성", "성심", "심근", "근경", "경색"]
    assert one(spark, T.tokens(F.col("t")), t="가A나") == ["a", "가나"]
    assert one(spark, T.tokens(F.col("t")), t="환 자") == ["환", "자"]


def test_whitespace(spark):
    assert one(spark, T.tokens(F.col("t"), "whitespace"), t="COPD, 환자!") == ["copd", "환자"]


@pytest.mark.parametrize("mode", ["whitespace", "char_bigram", "any other name"])
@pytest.mark.parametrize("scripts", [T.HANGUL_LATIN, T.ACCENTED_LATIN])
def test_python_tokens_are_the_same(spark, mode, scripts):
    rows = spark.createDataFrame([(s,) for s in STRINGS], "t string").select("t", T.tokens(F.col("t"), mode, scripts).alias("ts")).collect()
    cut = T.python_tokenizer(mode, scripts)
    for r in rows:
        assert r["ts"] == cut(r["t"]), r["t"]


def test_keys(spark):
    import unicodedata

    assert one(spark, T.normal_key(F.col("t")), t="혈 압!") == one(spark, T.normal_key(F.col("t")), t=unicodedata.normalize("NFD", "혈압"))
    assert one(spark, T.clean_text(F.col("t")), t=" a 　 b\u0085\x1c c ") == "a b c"
    assert one(spark, T.normal_key(F.col("t")), t="Straße, № 5") == "strasse5"
    assert spark.range(1).select(T.clean_text(F.lit(None).cast("string")).alias("x")).first()["x"] == ""


def test_row_ids(spark):
    df = spark.createDataFrame([("s", 1, " t1 ", None), ("s", 2, "  ", "q2"), ("s", 3, None, None)], "s string, n int, a string, b string")
    assert [r[0] for r in df.select(T.row_id(F.col("s"), F.col("n"), F.col("a"), F.col("b"))).collect()] == ["t1", "q2", "s:000000003"]


def test_script_levels(spark):
    level = lambda h, la, t: one(spark, T.script_level(F.col("h"), F.col("l"), t), h=h, l=la)
    assert level(50, 7, 5) == "mixed" and level(50, 7, 20) == "ko" and level(1, 30, 20) == "en"
    row = spark.range(1).select(T.script_level(F.lit(None).cast("int"), F.lit(None).cast("int"), 5).alias("x")).first()
    assert row["x"] == "other"


def test_booleans(spark):
    df = spark.createDataFrame([("True",), ("False",)], "t string")
    assert [r[0] for r in df.select(T.checked_bool(F.col("t"))).collect()] == [True, False]
    assert [r[0] for r in df.select(T.printed_bool(T.checked_bool(F.col("t")))).collect()] == ["True", "False"]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("true",)], "t string").select(T.checked_bool(F.col("t"))).collect()
    assert one(spark, T.percent(F.col("x")), x=0.12345) == "12.35%" or one(spark, T.percent(F.col("x")), x=0.12345) == "12.34%"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8])], "a array<double>, b array<double>")
    assert df.select(V.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.6)
    assert df.select(V.dot(F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(0.0)))).first()[0] == 6.0
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert df.select(V.cosine(zero, F.col("b"))).first()[0] == 0.0
    assert df.select(V.normalize_lenient(zero)).first()[0] == [0.0, 0.0]
    assert df.select(V.normalize_strict(F.array(F.lit(3.0), F.lit(4.0)))).first()[0] == [0.6, 0.8]
    for bad in (zero, F.array(F.lit(math.inf), F.lit(1.0))):
        with pytest.raises(Exception, match="finite length"):
            df.select(V.normalize_strict(bad)).collect()
    with pytest.raises(Exception, match="dimension"):
        df.select(V.dot(F.col("a"), F.array(F.lit(1.0)))).collect()
    with pytest.raises(ValueError):
        V.similarity("manhattan")


def test_config_digest():
    assert T.config_digest({"b": 1, "a": "é"}) == T.config_digest({"a": "é", "b": 1}) and len(T.config_digest({}, 16)) == 16


def test_only_texts_that_need_it_go_to_python(spark):
    """Plain texts have their forms from Spark itself; the others as a plain loop gives them, in parts."""
    import unicodedata

    import pyarrow as pa

    from quillrank.functions import text as T

    key = lambda t: "".join(c for c in unicodedata.normalize("NFC", t).casefold() if c.isalnum())
    texts = ["A-b 9_z", "", None, "Caf\u00e9 STRASSE\u00df", "e\u0301 \u212a", "\uac00\u1100\u1161", "\u0130I", "x" * 3000]
    rows = spark.createDataFrame([(i, t, [t, "Q q", None, "\u00c5"] if i % 3 else None) for i, t in enumerate(texts * 100)], "i int, t string, ts array<string>")
    got = rows.select("i", "t", "ts", T.clean_text(F.col("t")).alias("c"), T.normal_key(F.col("t")).alias("k"), T.normal_keys(F.col("ts")).alias("ks")).collect()
    for r in got:
        assert r["c"] == unicodedata.normalize("NFC", r["t"] or "") and r["k"] == key(r["t"] or "")
        assert r["ks"] == [key(t or "") for t in r["ts"] or []]
    sent = []
    T._mapped(pa.array(["a"] * 1000), lambda t: sent.append(t) or t)
    assert len(sent) == 1000 and T._mapped(pa.array([None] * 3, pa.string()), len).null_count == 3


def test_bigrams_of_runs_without_dense_letters():
    from quillrank.functions.text import ACCENTED_LATIN, python_tokenizer

    cut = python_tokenizer("char_bigram", ACCENTED_LATIN)
    assert cut("Plain \u00e9\u00e8 a\u00e9b\u00e8c x\u00e9 no") == ["plain", "a", "b", "c", "x", "no", "\u00e9\u00e8", "\u00e9\u00e8", "\u00e9"]
