"""What an inspector shows of an item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.python import shown_of
from foliant.operators.segment import places

DISPLAY_CHARS, TRACE_ROWS = 40_000, 400


def item_view(items: DataFrame, docs: DataFrame, display: int = DISPLAY_CHARS, runs: DataFrame | None = None) -> DataFrame:
    """doc_id, item, status, chars, text (display limit), truncated; with runs also shown_chars and display_text.

    items: doc_id, item, status, start, end; docs: doc_id, text. A document's items meet its
    text as one row. runs (doc_id, runs: array of start, end) are left out of display_text, which
    is null where it is the text itself; chars are the span's either way.
    """
    nested = items.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "item", "status")).alias("spans"))
    rows = docs.select("doc_id", "text").join(nested, "doc_id")
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    rows = rows.withColumn("runs", empty) if runs is None else rows.join(runs, "doc_id", "left").withColumn("runs", F.coalesce("runs", empty))
    # a text is cut where Python has it, and only what is shown comes back
    rows = rows.withColumn("seen", shown_of(display)("text", places("spans"), places("runs")))
    both = F.zip_with("spans", "seen", lambda s, x: F.struct(s.alias("s"), x.alias("seen")))
    rows = rows.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.s.*", "x.seen.*")
    shown = [] if runs is None else ["shown_chars", "display_text"]
    return rows.select("doc_id", "item", "status", (F.col("end") - F.col("start")).alias("chars"), "text", (F.col("shown_chars") > display).alias("truncated"), *shown)


def status_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("doc_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("extracted", "incorporated_by_reference", "omitted", "missing")))


def scrub_trace(trace):
    """The first rows of a trace, paths cut to their last part."""
    return F.transform(F.slice(trace, 1, TRACE_ROWS), lambda t: F.struct(t["layer"].alias("layer"), F.regexp_replace(t["payload"], r'"(?:[^"/]*/)+([^"/]*)"', '"$1"').alias("payload")))


def json_safe(*columns: str):
    """The columns as one JSON object: dates and times become text, nulls stay as nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss"})
