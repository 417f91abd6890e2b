"""Bodies that are read only where their words are asked for, and patterns tried only where they can hold."""

import random

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import judge, segment
from foliant.sources import submissions

SPAN = "doc_id long, start int, end int, item string, heading_end int, heading_text string, similarity double"


def _filing(r: random.Random) -> tuple[str, list[tuple]]:
    bodies = [
        "plain é words.", "The proxy statement has it. It is Incorporated here BY\nREFERENCE.", "Information reported  on pages 3 of the proxy statement.", "Refer to page 9 of the proxy statement.",
        "reported nothing", "cash $5 " * 900, "risk could " * 700, "legal " * 1200, "xİy " * 30 + "incorporated by reference to the proxy statement.", "", "ｒefer ſ",
    ]
    text, spans = "Cover\n", []
    for code in ("1", "1A", "3", "7", "8", "9A", "10", "11"):
        start, heading = len(text), r.choice(["Item {}. Title", "ITEM {}", "Item 99."]).format(code)
        text += heading + "\n" + r.choice(bodies) + "\n"
        spans.append((start, len(text), code, start + len(heading), heading, 0.9))
    return text, spans


def test_bodies_asked_judge_as_whole_bodies(spark):
    r = random.Random(3)
    made = [_filing(r) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, (t, _) in enumerate(made)], "doc_id long, text string, norm_chars int")
    spanned = spark.createDataFrame([(i, *s) for i, (_, spans) in enumerate(made) for s in spans], SPAN)
    asked = segment.bodies_asked(spanned, docs, tuple(judge.VOCABULARY), judge.SUBSTANTIVE)
    whole = segment.bodies(spanned, docs).withColumns({"head": F.substring("body", 1, 60), "chars": F.length("body"), "says": F.lit(True)})
    rows = lambda df: sorted(map(str, judge.read_bodies(df).collect()))
    assert rows(asked) == rows(whole)
    found = judge.read_bodies(asked)
    assert found.where("found = 'incorporated_by_reference'").count() and found.where("density > 0").count() and found.where("strange").count()
    assert asked.where("body is null and chars > 0").count() > asked.where("body is not null").count() / 2


def test_density_takes_runs_at_once(spark):
    rows = spark.createDataFrame([("a1 $2%\n٣x",), ("",), ("none",), ("123",)], "t string")
    one = F.length(F.regexp_replace("t", r"[^\p{Nd}$%]", "")).cast("double") / F.greatest(F.length("t"), F.lit(1))
    assert rows.where(~T.numeric_density(F.col("t")).eqNullSafe(one)).count() == 0
    assert "]+" in rows.select(T.numeric_density(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_plain_text_as_the_patterns_give_it(spark):
    texts = [a + "x\ry\r\nz" + b for a in ("", " ", "　\n", "\r") for b in ("", "\n", " \x85", "\r\r\n")] + ["", " ", "\r", "ends", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    want = T.strip(F.regexp_replace("t", r"\r\n?", "\n"))
    assert rows.where(~T.plain_text(F.col("t")).eqNullSafe(want)).count() == 0


def test_python_sees_only_texts_with_blocks(spark):
    raw = spark.createDataFrame([(1, "plain"), (2, "a<Document>\n<TYPE>10-K\n<TEXT>body</TEXT></DOCUMENT>"), (3, "a < b"), (4, None), (5, "p<IX:header>CONFORMED PERIOD OF REPORT: 20011231")], "doc_id long, raw_text string")
    got = {r.doc_id: r for r in submissions.select_documents(raw).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == ["plain", "body", "a < b", None] and got[2].n_blocks == 1 and got[3].n_blocks == 0
    assert got[5].format_era == "ixbrl" and str(got[5].period_end) == "2001-12-31" and got[1].period_end is None
