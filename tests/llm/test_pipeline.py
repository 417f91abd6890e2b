"""The pipeline's stages on sf0.001, each against what its operator must leave."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from foliant.llm import pii
from foliant.llm.storage import cut
from tests.llm.test_pairs import brute_components, brute_hits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, f in cp.STAGES:
        docs = cut(f(spark, docs, SF), name)
        out.append(docs.toPandas())
    return out


def test_stages(spark, stages):
    start, lang, near, clean, private, mixed = stages
    for x in (lang, near, clean, private):
        assert list(x.columns) == cp.COLUMNS
    assert set(lang.doc_id) == set(start.doc_id)  # all have a known language
    parts = brute_components(list(zip(lang.doc_id, lang.text)))
    assert set(near.doc_id) == {i for i, (_, _, kept) in parts.items() if kept}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    hits = brute_hits(list(zip(near.doc_id, near.text)), list(zip(bench.item_id, bench.text)))
    assert set(clean.doc_id) == {i for i, h in hits.items() if not h[4]}
    assert set(private.doc_id) == set(clean.doc_id)
    before = dict(zip(clean.doc_id, clean.text))
    for i, text, n in zip(private.doc_id, private.text, private.n_chars):
        assert n == len(text) and not [s for s in pii.base_spans(text) if s[0] in ("email", "ip")]
        if not pii.base_spans(before[i]):
            assert "<email>" in text or "<phone>" in text or "<card>" in text or text == before[i]
    assert set(mixed.doc_id) == set(private.doc_id) and (mixed.taken <= 3 * mixed["size"]).all()
    by = mixed.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 1).all()
    assert dict(zip(mixed.doc_id, mixed.text)) == dict(zip(private.doc_id, private.text)) and set(cp.COLUMNS) < set(mixed.columns)


def test_near_duplicate_stage_keeps_rows_without_id(spark):
    rows = [(None, "no id", "en", "s", 5), (1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "t", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.source) for r in cp.near_duplicate_stage(spark, docs, SF).collect())
    assert got == [("1", "s"), ("None", "s")]


def test_stages_with_odd_rows(spark):
    """Nulls in every column, empty and repeated rows go through all stages; an empty table stays empty."""
    words = "the quick brown fox jumps over the lazy dog and runs through the green field again "
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, words, "en", "s", 9), (1, words, "en", "s", 9), (2, None, None, None, None), (3, "", "en", None, 0), (None, words * 2, "en", "s", 1), (None, words * 2, "en", "s", 1), (4, "1234 5678", None, "s", 9)]
    rows += [(None, words + bench, "en", "s", 1), (5, "say " + bench, "en", None, 1), (6, "mail joe@example.com now please, the fox and the dog", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in cp.STAGES:
        docs = cut(f(spark, docs, SF), name)
    got = sorted((str(r.doc_id), str(r.source), r.text[:9]) for r in docs.collect())
    assert got == sorted([("1", "s", "the quick"), ("None", "s", "the quick"), ("None", "s", "the quick"), ("6", "None", "mail <ema")])
    empty = docs.select(*cp.COLUMNS).limit(0)
    for name, f in cp.STAGES:
        empty = cut(f(spark, empty, SF), name)
    assert empty.count() == 0
