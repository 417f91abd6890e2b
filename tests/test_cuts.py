"""Spans cut from one decoded text, and white space taken off by a trim."""

import random
import sys

from pyspark.sql import functions as F

from foliant.functions import python as P
from foliant.functions import text as T


def test_texts_of_as_substring(spark):
    r = random.Random(7)
    rows = []
    for i in range(300):
        text = "".join(r.choices("aé\U0001f600\n ", k=r.randint(0, 12)))
        rows.append((i, None if i % 50 == 0 else text, [(r.choice([None, r.randint(-9, 14)]), r.choice([None, r.randint(-9, 16)])) for _ in range(5)]))
    df = spark.createDataFrame(rows, "id int, t string, s array<struct<start:int,end:int>>")
    want = F.when(F.col("t").isNotNull(), F.transform("s", lambda x: F.substring(F.col("t"), x["start"] + 1, x["end"] - x["start"])))
    got = df.select("id", P.texts_of("t", "s").alias("got"), want.alias("want")).collect()
    assert len(got) == 300 and [(x.id, x.got) for x in got] == [(x.id, x.want) for x in got]


def test_strip_takes_what_the_pattern_takes(spark):
    every = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    white = spark.createDataFrame([(c,) for c in every if c.isspace() or not c.isprintable()], "c string")
    odd = white.where(F.col("c").rlike(r"(?U)^\s$") != F.contains(F.lit(T.WHITE), F.col("c"))).collect()
    assert odd == []
    texts = [(a + "x y\n z" + b,) for a in ("", " \t", " 　", "\n\r") for b in ("", "\n", "  ", "\x85 \n")] + [("",), (" ",), (None,)]
    rows = spark.createDataFrame(texts, "t string")
    pattern = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    flat = pattern(F.regexp_replace("t", r"(?U)\s+", " "))
    assert rows.where(~T.strip(F.col("t")).eqNullSafe(pattern("t")) | ~T.flat(F.col("t")).eqNullSafe(flat)).count() == 0
    plan = rows.select(T.strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
