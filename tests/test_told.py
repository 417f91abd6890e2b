"""What bodies say, put together of what was told of the lines within them, is what the bodies read whole give."""

import random

from pyspark.sql import functions as F

from foliant.functions.places import figures_in, last_word
from foliant.functions.text import numeric_density
from foliant.operators import judge, segment
from foliant.plans import segmentation


def _filing(r: random.Random) -> str:
    pick = r.choice
    words = ["risk", "Risk", "risks", "could", "ﬁ could", "_could", "could²", "écould", "couldé", "could́", "́could", "legal", "LEGAL", "proceedings9", "٣legal", "total", "net", "net.", "internal control", "Internal\nControl", "disclosure controls", "$5", "12%", "٣٤", "é", "İ", "plain", "refer to"]
    body = lambda: " ".join(pick(pick((words, ["plain", "word"]))) for _ in range(pick((3, 40)))) + " " + pick(("x y ", "five $ ", "9٣")) * pick((0, 10, 2600))
    lines = ["Cover", "fiscal year ended December 31, 2010"]
    for code, title in (("1", "Business"), ("1A", "Risk Factors"), ("3", "Legal Proceedings"), ("8", "Financial Statements and Supplementary Data"), ("9A", "Controls and Procedures"), ("10", "Directors")):
        blanks = pick(("", "", " " * 30, " " * 57, " " * 70))
        lines += pick(([f"{blanks}Item {code}. {title}"], [f"{blanks}ITEM {code}.", "", f"  {title} "], [f"Item {code}. {title}" + " could risk legal" * pick((0, 1))]))
        for _ in range(pick((0, 1, 1, 2))):
            lines += [body(), pick(("part of it could", " Item 99. Risk", "item of legal kind", "particular net", "Item 8. Xyzzy plugh total"))]
    return "\n".join([*lines, *pick(((), ("SIGNATURES", "total risk"))), *pick(((), ("Item 14. Exhibits",), ("Item 9A. Controls and Procedures" + " x" * 9,)))])


def test_what_lines_tell_of_bodies_is_what_the_bodies_say(spark):
    r = random.Random(11)
    texts = [_filing(r) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, norm_chars int").withColumn("period_end", F.lit("2010-12-31").cast("date"))
    facts = docs.select("doc_id", "period_end", "norm_chars")
    marked = segment.marked(docs, judge.VOCABULARY, judge.FIGURED, judge.SUBSTANTIVE)
    cands = segment.candidates(segment.notable(marked), facts)
    spans = segment.spans(segment.assign(segment.filter_candidates(cands)[0], facts), segment.notable(marked), facts).localCheckpoint()
    got = judge.read_told(segment.told(spans, marked, tuple(judge.VOCABULARY)), segment.pointers(spans, marked)).localCheckpoint()
    whole = segment.bodies(spans, docs).withColumns({"head": F.substring("body", 1, 60), "chars": F.length("body"), "says": F.lit(True)})
    want = judge.read_bodies(whole).localCheckpoint()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for some in ("strange", "not strange and density > 0", "unclean", "item = '9A' and strange", "item = '3' and not strange and end - start > 5000"):
        assert got.where(some).count() > 0, some


def test_last_words_and_figures_as_the_patterns_find_them(spark):
    r = random.Random(4)
    made = ["".join(r.choice(("risk", "could", " ", "_", "é", "²", "́", "s", ".", "٣", "7", "$", "\n", "中")) for _ in range(r.randrange(12))) for _ in range(2000)]
    rows = spark.createDataFrame([(t, last_word(t, ("risk", "could"), 0, len(t)) is not None, figures_in(t, 0, len(t)) / max(len(t), 1)) for t in made], "t string, some boolean, share double")
    assert rows.where(F.col("t").rlike(r"\b(risk|could)\b") != F.col("some")).count() == 0
    assert rows.where(numeric_density(F.col("t")) != F.col("share")).count() == 0 and rows.where("some").count() > 100
    assert last_word("risk could risks", ("risk", "could"), 0, 16) == 5 and last_word("risk could", ("risk",), 1, 10) is None


def test_items_move_no_text(spark):
    """The items of texts without words of reference are read without their texts meeting the spans."""
    body = "These risks could cost $5. " * 300
    text = f"FORM 10-K\nfor the fiscal year ended December 31, 2010\nItem 1. Business\n{body}\nItem 1A. Risk Factors\n{body}\nItem 8. Financial Statements and Supplementary Data\nTotal net $123\n{body}\nSIGNATURES\n"
    s = segmentation.segment_documents(spark.createDataFrame([(1, text)], "doc_id long, raw_text string"))
    kept = s.items.where("start is not null").select("item", "strange", "unclean", F.round("density", 4).alias("density")).collect()
    assert {x.item: (x.strange, x.unclean) for x in kept} == {"1": (False, False), "1A": (False, False), "8": (False, False)}
    assert all((x.density or 0) > 0 for x in kept if x.item != "1") and s.marked.where("spoken is not null").count() == 0
    # the bodies' facts are there though no text is left to be read
    told = segment.told(s._spans, s.marked.drop("spoken"), tuple(judge.VOCABULARY))
    assert told.where("figures > 0").count() == 2 and told.where("last is not null").count() == 2
