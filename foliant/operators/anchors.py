"""Finding an item in the visible text of its source: core index, occurrences, best agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.python import anchors_in, solid_at

AGREEMENT_CHARS, AGREEMENT_MIN = 400, 15


def core_index(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_i, core, core_start, core_end) of chunks (doc_id, chunk_i, raw) that are not blank."""
    rows = chunks.select("doc_id", "chunk_i", "raw", T.core(F.col("raw")).alias("core")).where("core <> ''")
    order = Window.partitionBy("doc_id").orderBy("chunk_i")
    start = F.coalesce(F.sum(F.length("core")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("core_start", start).withColumn("core_end", F.col("core_start") + F.length("core"))


def core_text(index: DataFrame) -> DataFrame:
    """(doc_id, core_text): the chunks' cores in order, without separators."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_i", "core")))
    return index.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["core"]), "").alias("core_text"))


def locate(offsets: DataFrame, index: DataFrame) -> DataFrame:
    """offsets (doc_id, core_offset) with the chunk that holds each, and the place in its raw text: a range join."""
    hit = offsets.join(index, "doc_id").where("core_offset >= core_start and core_offset < core_end")
    k = (F.col("core_offset") - F.col("core_start")).cast("int")
    return hit.select("doc_id", "core_offset", "chunk_i", solid_at("raw", k).alias("offset"))


def find_anchors(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, item, hits, anchor): items (doc_id, item, heading_text, item_text) in texts (doc_id, core_text).

    A single occurrence is taken; of several the one whose following text agrees longest with the
    item's own, if it agrees well enough; ties to the first. A document's items are nested into one
    row, with no more of their texts than is compared, and meet its text there: one scan finds the
    places of all headings.
    """
    rows = items.select("doc_id", "item", T.core(F.col("heading_text")).alias("needle"), T.core(F.col("item_text")).alias("own"))
    n = F.length("needle")
    after = F.when(F.startswith("own", "needle"), F.substring(F.col("own"), n + 1, F.lit(AGREEMENT_CHARS))).otherwise(F.substring("own", 1, AGREEMENT_CHARS))
    rows = rows.select("doc_id", F.struct("item", "needle", after.alias("target")).alias("i"))
    nested = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("i")).alias("items"))
    found = anchors_in(AGREEMENT_CHARS, AGREEMENT_MIN)(F.col("core_text"), F.col("items.needle"), F.col("items.target"))
    met = texts.join(nested, "doc_id").select("doc_id", F.explode(F.arrays_zip(F.col("items.item").alias("item"), found.alias("at"))).alias("x"))
    return met.select("doc_id", "x.item", "x.at.hits", "x.at.anchor")


def nearest_fraction(places: Column, size: Column, fraction: Column) -> Column:
    """The place whose share of the text is nearest to a fraction; the first, if that is null."""
    scored = F.transform(places, lambda p: F.struct(F.round(F.abs(p / F.greatest(size, F.lit(1)) - fraction), 12).alias("d"), p.alias("p")))
    return F.when(fraction.isNull(), F.get(places, F.lit(0))).otherwise(F.array_min(scored)["p"])
