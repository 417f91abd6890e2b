"""Submissions of any length, read as byte ranges: a row a ``<DOCUMENT>`` block, never a file.

Spark's text source cuts files into splits and records at a separator; a record that begins in one
split and ends in the next is read whole by the first. With ``<DOCUMENT>`` as the separator the
records are pieces that begin with a block (or with the file). What one piece cannot know comes
from narrow rows about all pieces: whether the file is UTF-8, how many characters lie before, and
whether the block before was left open (it then goes on over the next tag, to the first
``</DOCUMENT>``). So a file may have any length; one block must fit a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.python import decode_cp1252
from foliant.functions.taxonomy import ACCEPTED_FORMS
from foliant.sources.staging import stage
from foliant.sources.submissions import with_blocks

TAG = "<DOCUMENT>"


def pieces(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """doc_id (path), split, seq, size (of the file), bytes: a file's pieces, without the tags before them, in the order of (split, seq)."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", TAG)
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("bytes"),
    )


def _running(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the pieces before: within splits first, then over the splits of a file."""
    split = Window.partitionBy("doc_id", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("doc_id", "split").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("doc_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("doc_id", "split", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return rows.join(sums, ["doc_id", "split"]).withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(split), F.lit(0))).drop("_before")


def read_blocks(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """doc_id (path), start, type, sequence, filename, body of all blocks of the files below ``path``.

    The same blocks as ``submissions.with_blocks`` finds in the decoded file (a byte order mark is
    a character, as there), for files of any length. An empty file has none.
    """
    raw = stage(pieces(spark, path, glob), "pieces")
    low = F.lower(F.col("bytes").cast("string"))
    # the tag itself opens a block, or lies within one; what is open at a piece's end does not depend on the pieces before
    last = lambda tag: F.call_function("locate", F.reverse(F.lit(tag)), F.reverse(low))
    opened, closed = last("<document>"), last("</document>")
    first = F.row_number().over(Window.partitionBy("doc_id", "split").orderBy("seq")) == 1
    about = raw.select(
        "doc_id", "split", "seq", "size", F.octet_length("bytes").alias("n_bytes"), F.length(F.col("bytes").cast("string")).alias("n_chars"),
        F.is_valid_utf8("bytes").alias("valid"), opened.alias("opened"), closed.alias("closed"),
    )
    # one pass over the bytes; what follows reads narrow rows
    about = stage(about.withColumn("lead", F.when((F.col("split") == 0) & first, 0).otherwise(len(TAG))), "about-pieces")
    files = about.groupBy("doc_id").agg(F.bool_and("valid").alias("utf8"), (F.first("size") - F.sum(F.col("n_bytes") + F.col("lead"))).alias("missing"))
    # bytes that no record holds: a byte order mark, and a tag at the file's end
    files = files.withColumn("mark", F.when(F.col("missing") % len(TAG) == 3, 3).otherwise(0)).withColumn("tail", F.col("missing") >= len(TAG))
    about = about.join(files, "doc_id")
    # a piece stays open if it has no closing tag behind its last opening one, its own first tag included
    # (places from the end: the smaller is the later; 0 is none)
    has_own = F.col("lead") > 0
    open_end = F.when(F.col("closed") == 0, has_own | (F.col("opened") > 0)).otherwise((F.col("opened") > 0) & (F.col("opened") < F.col("closed")))
    mark = F.when(F.col("utf8"), F.when(F.col("mark") > 0, 1).otherwise(0)).otherwise(F.col("mark"))
    about = about.withColumn("open_end", open_end).withColumn("chars", F.col("lead") + F.when(F.col("utf8"), F.col("n_chars")).otherwise(F.col("n_bytes")))
    about = _running(about, "chars", "_at").withColumn("_at", F.col("_at") + mark)
    order = Window.partitionBy("doc_id").orderBy("split", "seq")
    about = about.withColumn("goes_on", F.coalesce(F.lag("open_end").over(order), F.lit(False)))
    about = about.withColumn("new", F.when(F.col("goes_on"), 0).otherwise(1))
    about = _running(about, "new", "_unit").withColumn("_unit", F.col("_unit") + F.col("new"))
    ends = Window.partitionBy("doc_id").orderBy(F.col("split").desc(), F.col("seq").desc())
    about = about.withColumn("tail", F.col("tail") & (F.row_number().over(ends) == 1))
    sizes = Window.partitionBy("doc_id", "_unit")
    narrow = about.select("doc_id", "split", "seq", "lead", "utf8", "_at", "_unit", "tail", F.count(F.lit(1)).over(sizes).alias("_n"))

    held = raw.drop("size").join(narrow, ["doc_id", "split", "seq"])
    text = F.when(F.col("utf8"), F.decode("bytes", "UTF-8"))
    held = held.where("utf8").withColumn("raw_text", text).unionByName(held.where("not utf8").withColumn("raw_text", decode_cp1252("bytes"))).drop("bytes")
    # a tag at the file's very end is a block without text, or the last characters of an open one
    begins = F.when(F.col("lead") > 0, F.lit(TAG)).otherwise(F.lit(""))
    held = held.withColumn("raw_text", F.concat(begins, "raw_text", F.when(F.col("tail"), F.lit(TAG)).otherwise(F.lit(""))))
    alone = held.where("_n = 1").select("doc_id", F.col("_at").alias("_start"), "raw_text")
    parts = F.array_sort(F.collect_list(F.struct("split", "seq", "raw_text")))
    joined = held.where("_n > 1").groupBy("doc_id", "_unit").agg(F.min("_at").alias("_start"), F.array_join(F.transform(parts, lambda x: x["raw_text"]), "").alias("raw_text"))
    units = alone.union(joined.select("doc_id", "_start", "raw_text"))
    found = stage(with_blocks(units).drop("raw_text"), "units", texts=True).select("doc_id", "_start", F.explode("blocks").alias("b"))
    return found.select("doc_id", (F.col("_start") + F.col("b.start")).alias("start"), "b.type", "b.sequence", "b.filename", "b.body")


def accepted_block(blocks: DataFrame) -> DataFrame:
    """The first block of each file that declares an accepted form."""
    good = blocks.where(F.col("type").isin(*ACCEPTED_FORMS))
    first = good.groupBy("doc_id").agg(F.min("start").alias("start"))
    return good.join(first, ["doc_id", "start"])
