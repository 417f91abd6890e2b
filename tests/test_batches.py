"""What a Python function gets of whole texts at a time."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from foliant.sources import staging, submissions


@F.arrow_udf(IntegerType())
def together(texts: pa.Array) -> pa.Array:
    return pa.array([len(texts)] * len(texts), pa.int32())


def test_batches_of_texts_are_bounded(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(0, 1000, 1, 1).select(F.col("id").cast("string").alias("t"))
    staged = staging.stage(rows.select(together("t").alias("n")), "batches", texts=True)
    assert staged.count() == 1000 and staged.agg(F.max("n")).first()[0] <= staging.TEXT_ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_bodies_do_not_come_from_python(spark):
    raw = spark.createDataFrame([(1, "é<DOCUMENT>\n<TYPE>10-K\n<TEXT>übody</TEXT></DOCUMENT><DOCUMENT>open"), (2, None), (3, "none")], "doc_id int, raw_text string")
    rows = submissions.with_blocks(raw)
    got = {r.doc_id: [tuple(b) for b in r.blocks] for r in rows.collect()}
    assert got == {1: [("10-K", "", "", 1, "übody"), ("", "", "", got[1][1][3], "open")], 2: [], 3: []}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan.split("ArrowEvalPython", 1)[1].split("\n", 1)[0]
