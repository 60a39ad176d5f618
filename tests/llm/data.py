"""Small tables with every odd case, for all text operators."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

WORDS = "the of and to in a is that shore lantern copper willow harbour granite meadow thistle ember quarry saffron pebble orchard velvet barley cinder".split()


def texts(seed: int = 3) -> list:
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = say(120)
    passage = say(45)
    out = [None, "", " \n\t ", "one", "one two", "one two three", base, base, base + " tail", base.replace("copper", "silver", 1),
           say(30) + " " + passage + " " + say(30), passage + "\n" + say(10), say(200), say(200) + "\n" + passage, "a\n\nb\na\n a\nb", "x " * 400,
           "GNU General Public License, Apache License. CC BY mit license!", "été naïve straße 日本語 " * 20, "#$%& *** | <a>", say(4000),
           "tab\tand\x0bvt\x0cff\r\nnew", "nbsp kept too", say(60).upper() + "!!", base.upper()]
    return out


def docs(spark, extra: bool = True):
    rows = [(i * 7 + 1, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts())]
    rows += [(None, "null id text", None, None, 12), (8, rows[1][1], "en", "src1", 0), (50, rows[7][1], None, "src0", -1)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # names that operators use inside
        from pyspark.sql import functions as F

        for c in ("b", "h", "fp", "u", "word", "pos", "score", "g", "n"):
            df = df.withColumn(c, F.lit("clash"))
    return df
