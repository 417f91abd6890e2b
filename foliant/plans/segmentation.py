"""The whole pipeline from raw texts to envelopes."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant import __version__
from foliant.operators import furniture, judge, segment
from foliant.sources import submissions
from foliant.sources.staging import stage

ENVELOPE_ITEM = ("item", "part", "title", "heading_text", "start", "end", "status", "method", "confidence", "evidence")


class Segmented:
    """Tables of one run: documents, their notable lines and candidates, and the items with all that is found of them.

    raw: doc_id, raw_text. Each table is made, and staged, when it is first asked for. Refused
    documents leave before the lines are looked for.
    """

    def __init__(self, raw: DataFrame):
        self.raw = raw

    @cached_property
    def docs(self) -> DataFrame:
        return submissions.select_documents(self.raw).withColumn("gate", judge.gate())

    @property
    def _texts(self) -> DataFrame:
        return self.docs.where("gate is null").select("doc_id", "text", "period_end", "norm_chars")

    @property
    def _facts(self) -> DataFrame:
        return self._texts.drop("text")

    @cached_property
    def marked(self) -> DataFrame:
        return stage(segment.marked(self._texts, judge.VOCABULARY, judge.FIGURED, judge.SUBSTANTIVE), "marked", texts=True)

    @property
    def notable(self) -> DataFrame:
        return segment.notable(self.marked)

    @cached_property
    def candidates(self) -> DataFrame:
        return stage(segment.candidates(self.marked), "candidates")

    @cached_property
    def _filtered(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return segment.filter_candidates(self.candidates)

    @property
    def survivors(self) -> DataFrame:
        return self._filtered[0]

    @cached_property
    def manifest(self) -> DataFrame:
        return stage(self._filtered[1], "manifest")

    @property
    def rejected(self) -> DataFrame:
        return self._filtered[2]

    @cached_property
    def _spans(self) -> DataFrame:
        return stage(segment.spans(segment.assign(self.survivors), self.notable), "spans")

    @cached_property
    def _pointing(self) -> DataFrame:
        return stage(segment.pointers(self._spans, self.marked), "pointing", texts=True)

    @cached_property
    def statuses(self) -> DataFrame:
        """The items' places and statuses alone, without what the validators need."""
        return segment.statuses(self._spans, self._pointing, self._facts)

    @cached_property
    def items(self) -> DataFrame:
        read = judge.read_told(segment.told(self._spans, self.marked, tuple(judge.VOCABULARY)), self._pointing)
        return stage(segment.items(read, self._facts), "items")

    @cached_property
    def battery(self) -> DataFrame:
        return stage(judge.validate(self.items, self.manifest), "battery")

    @cached_property
    def scored(self) -> DataFrame:
        return judge.score(self.items, self.battery)

    @cached_property
    def warnings(self) -> DataFrame:
        return judge.all_warnings(self.items, self.docs.drop("text"), self.battery)

    @cached_property
    def status(self) -> DataFrame:
        return judge.doc_status(self.scored, self.warnings, self.docs.drop("text"))


def segment_documents(raw: DataFrame) -> Segmented:
    """raw: doc_id, raw_text."""
    return Segmented(raw)


def envelopes(raw: DataFrame, exclude_boilerplate: bool = False, digested: bool = False) -> DataFrame:
    """One nested row a document: doc_status, items, warnings, meta, trace, cost and, if asked for, boilerplate.

    digested: normalized_text is the text's sha256, so that no text is moved.
    """
    s = segment_documents(raw)
    docs = s.docs.withColumn("text", F.sha2("text", 256)) if digested else s.docs
    evidence = F.struct(F.col("similarity").alias("title_similarity"), (F.col("end") - F.col("start")).alias("chars"), "warnings", "confidence_base").alias("evidence")
    row = F.struct("ord", *(evidence if c == "evidence" else F.col(c) for c in ENVELOPE_ITEM))
    ordered = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(*(x[c].alias(c) for c in ENVELOPE_ITEM)))
    items = s.scored.groupBy("doc_id").agg(ordered.alias("items"), F.array_contains(F.collect_set("item"), "1A").alias("modern"), F.count_if(F.col("status") == "extracted").alias("n_extracted"), F.bool_or("ambiguous").alias("ambiguous"))
    shown = lambda x: F.struct(*(x[c].alias(c) for c in ("code", "item", "message")))
    warned = F.transform(F.array_sort(F.collect_list(F.struct("stage", "seq", "code", "item", "message"))), shown)
    warnings = s.warnings.groupBy("doc_id").agg(warned.alias("warnings"), F.count(F.lit(1)).alias("n_warnings"))
    # items and warnings are told once a document, for its status too
    out = docs.join(items, "doc_id", "left").join(warnings, "doc_id", "left").join(s.manifest, "doc_id", "left").withColumn("doc_status", judge.status_of())
    empty = lambda c: F.when(F.col("items").isNotNull(), F.coalesce(c, F.array().cast("array<string>")))
    meta = F.struct(
        F.lit(__version__).alias("extractor_version"), "input_sha256", "form_type", "period_end", "form_type_declared", "form_type_sniffed",
        "format_era", F.when(F.col("modern"), "modern").when(F.col("items").isNotNull(), "legacy").alias("taxonomy_era"), empty(F.col("manifest")).alias("toc_manifest"),
        "document_selected", "n_blocks", "block_types", "raw_chars", "norm_chars",
    )
    trace = F.array(
        F.struct(F.lit("normalize").alias("layer"), F.to_json(F.struct("format_era", "norm_chars")).alias("payload")),
        F.struct(F.lit("status").alias("layer"), F.to_json(F.struct("n_extracted")).alias("payload")),
    )
    cost = F.struct(F.lit(0).alias("llm_calls"), F.lit(0).alias("tokens"), F.lit(0.0).alias("usd"))
    # a batch has no time of its own for one document
    timings = F.struct(F.lit(None).cast("double").alias("total_ms"))
    out = out.select(
        "doc_id", F.col("text").alias("normalized_text"), "doc_status", F.expr("coalesce(warnings, array())").alias("warnings"), meta.alias("meta"), trace.alias("trace"),
        timings.alias("timings"), cost.alias("cost"), F.expr("coalesce(items, array())").alias("items"),
    )
    if exclude_boilerplate:
        marked = furniture.find(s.docs.select("doc_id", "text"))
        found = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("boilerplate"))
        out = out.join(found, "doc_id", "left").withColumn("boilerplate", F.expr("coalesce(boilerplate, array())"))
    return out
