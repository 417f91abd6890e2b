"""Statuses without what only the validators need, and what one pass over a text tells of it."""

import random

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.places import notable_in
from foliant.operators import segment
from foliant.plans import segmentation
from foliant.plans.filings import filings

SF = "/root/testdata/sf0.001"


def test_statuses_are_those_of_the_items_and_nothing_else_is_made(spark):
    s = segmentation.segment_documents(filings(spark, SF))
    columns = ["doc_id", "item", "start", "end", "status"]
    own = s.statuses.select(columns)
    assert not {"items", "battery", "manifest"} & set(vars(s))  # no validator, no body but of texts with words of reference
    spoken, texts = s.marked.where("spoken is not null"), s.docs.where("gate is null")
    refers = F.lower("text").contains("refer") | F.lower("text").contains("reported")
    assert 0 < spoken.count() == texts.where(refers).count() < texts.count() / 2
    assert spoken.join(texts, "doc_id").where("spoken <> text").count() == 0
    whole = s.items.select(columns)
    assert own.exceptAll(whole).count() == 0 and whole.exceptAll(own).count() == 0
    assert own.where("status = 'incorporated_by_reference'").count() and own.where("start is null").count()


def test_what_follows_is_given_behind_every_bare_heading(spark):
    r = random.Random(5)
    pick = lambda *a: r.choice(a)
    made = [
        pick("", " ", "\t", " ") + pick("", "Part IV ", "PART ii - ", "part x.", "Part\tI– ") + pick("item", "ITEM ", "Item ", "Item  ") + pick("1", "12", "7", "٣", "123")
        + pick("", "A", " a", " B", "d", "E", "  C") + pick("", "(T)", "(AB)", "(abc)") + pick("", " .", ":", " —", ")", "..") + pick("", " ", "  \x85", "　\t", " Title", "_", "x")
        for _ in range(3000)
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i int, raw string").where(F.col("raw").rlike(T.HEADING))
    code = F.concat(F.regexp_extract("raw", T.HEADING, 1), F.upper(F.regexp_extract("raw", T.HEADING, 2)))
    judged = {x.i: (x.own, x.code) for x in rows.select("i", T.strip(F.regexp_extract("raw", T.HEADING, 3)).alias("own"), code.alias("code")).collect()}
    bare = [i for i, (own, _) in judged.items() if own == ""]
    assert len(bare) > 300 and all(notable_in(made[i] + "\nnext", 600, ())[0][0][2] == "\nnext" for i in bare)
    assert notable_in("Item 1. Business\nnext", 600, ())[0] == [(0, "Item 1. Business", "")]
    for _ in range(300):
        few = r.sample(range(len(made)), 3)
        codes = [judged[i][1] for i in few if i in judged]
        assert notable_in("\n".join(made[i] for i in few), 600, ())[1] == (len(set(codes)) < len(codes))


def test_only_documents_whose_codes_come_again_are_judged_for_contents(spark):
    s = segmentation.segment_documents(filings(spark, SF))
    cands = s.candidates
    tables = lambda got: [sorted(map(str, df.collect())) for df in got]
    few = segment.filter_candidates(cands)
    every = segment.filter_candidates(cands.withColumn("again", F.lit(True)))
    assert tables(few[1:2]) == tables(every[1:2]) and tables([x.drop("again") for x in (few[0], few[2])]) == tables([x.drop("again") for x in (every[0], every[2])])
    assert cands.where("not again").count() > cands.where("again").count() > 0 and few[1].count()
