"""Submissions read by byte ranges against the same text read whole."""

import os
import random

import pytest
from pyspark.sql import functions as F

from foliant.sources import large, submissions

BITS = [
    "<DOCUMENT>", "<DOCUMENT>", "</DOCUMENT>", "</DOCUMENT>\n", "<document>", "</document>", "<TYPE>10-K\n", "\n<TYPE>EX-13\n", "<SEQUENCE>2\n", "<FILENAME>a.htm\n", "<TEXT>", "</TEXT>", "<DOCU", "MENT>",
    "</DOC", "word ", "é ü ", "x" * 40, "\r\n", "<D<DOCUMENT>",
]


def whole(spark, folder):
    rows = submissions.with_blocks(submissions.read_files(spark, folder)).select("doc_id", F.explode("blocks").alias("b"))
    return sorted((r.doc_id.rsplit("/", 1)[1], r.start, r.type, r.sequence, r.filename, r.body) for r in rows.select("doc_id", "b.start", "b.type", "b.sequence", "b.filename", "b.body").collect())


@pytest.mark.parametrize("split", [64, 128 << 20])
def test_blocks_at_borders(spark, tmp_path, split):
    r = random.Random(split)
    for i in range(10):
        data = "".join(r.choices(BITS, k=r.randint(0, 12))).encode("utf-8" if i % 4 else "cp1252")
        (tmp_path / f"f{i}").write_bytes((b"\xef\xbb\xbf" if i % 5 == 3 else b"") + data)
    (tmp_path / "empty").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = large.read_blocks(spark, str(tmp_path)).cache()
        rows = sorted((os.path.basename(x.doc_id), x.start, x.type, x.sequence, x.filename, x.body) for x in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == whole(spark, str(tmp_path))
    first = {}
    for name, start, kind, *_ in rows:
        if kind in ("10-K", "10-K405"):
            first.setdefault(name, start)
    assert {os.path.basename(x.doc_id): x.start for x in large.accepted_block(got).collect()} == first
