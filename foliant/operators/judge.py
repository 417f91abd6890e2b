"""Label-free validators, confidence and document status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.taxonomy import ACCEPTED_FORMS
from foliant.operators import segment

COLLAPSE_CHARS = 2000
UNATTRIBUTED_MAX, LAST_ITEM_MAX, MISSING_MAX, SUBSTANTIVE = 0.17, 0.50, 0.25, 5000
# Vocabulary of items, those whose figures are counted, warnings that make a document ambiguous, confidences.
VOCABULARY = {"1A": ("risk", "adversely", "could"), "3": ("legal", "proceedings"), "8": ("total", "net"), "9A": ("internal control", "disclosure controls")}
FIGURED = ("8", "1A")
AMBIGUOUS = ("toc_manifest_mismatch", "last_item_dominates", "expected_items_mostly_missing")
STRICT, BASE_STRICT, BASE_WEAK, BASE_POINTER, BASE_OMITTED, BASE_MISSING, PENALTY, CEILING = 0.8, 0.95, 0.75, 0.85, 0.80, 0.40, 0.15, 0.95


def gate():
    """failed, unsupported, or null for documents that are segmented; from norm_chars and form_type."""
    form = F.coalesce(F.col("form_type").isin(*ACCEPTED_FORMS), F.lit(False))
    return F.when(F.col("norm_chars") < COLLAPSE_CHARS, "failed").when(~form, "unsupported")


def read_bodies(rows: DataFrame) -> DataFrame:
    """Spans with ``body`` (see ``segment.bodies_asked``) -> their status and what the validators need of the text, without it."""
    body, chars = F.col("body"), F.col("chars")
    title_end = F.col("heading_end") - F.col("start")
    rows = segment.pointer_status(rows, F.when(F.col("says"), F.substring(body, F.greatest(title_end, F.lit(0)) + 1, chars)))
    head = F.split("head", "\n")[0]
    named = F.concat(F.regexp_extract(head, T.HEADING, 1), F.upper(F.regexp_extract(head, T.HEADING, 2)))
    inside = (title_end > 0) & (F.col("heading_end") < F.col("end"))
    cut = F.when(inside, title_end).otherwise(F.coalesce(F.nullif(F.locate("\n", body), F.lit(0)), F.lit(0)))
    substantive = (F.col("found") == "extracted") & (chars >= SUBSTANTIVE)
    prose = F.lower(F.substring(body, cut + 1, chars))
    lacks = F.lit(False)
    for code, words in VOCABULARY.items():
        lacks = F.when(F.col("item") == code, ~prose.rlike(r"\b(" + "|".join(words) + r")\b")).otherwise(lacks)
    return rows.select(
        "doc_id", "item", "start", "end", "heading_end", "heading_text", "similarity", "found", "norm_chars",
        (named != F.col("item")).alias("unclean"),
        F.when(substantive & F.col("item").isin(*FIGURED), T.numeric_density(body)).alias("density"),
        (substantive & lacks).alias("strange"),
    )


def read_told(rows: DataFrame, pointing: DataFrame) -> DataFrame:
    """As ``read_bodies``, from spans with what their lines tell (see ``segment.told``) and the spans that point elsewhere (``segment.pointers``)."""
    rows = rows.join(pointing, ["doc_id", "item"], "left").withColumn("found", F.coalesce("found", F.lit("extracted")))
    chars = F.col("end") - F.col("start")
    inside = (F.col("heading_end") > F.col("start")) & (F.col("heading_end") < F.col("end"))
    prose = F.when(inside, F.col("heading_end")).when(F.col("line_end") < F.col("end"), F.col("line_end") + 1).otherwise(F.col("start"))
    substantive = (F.col("found") == "extracted") & (chars >= SUBSTANTIVE)
    lacks = F.col("item").isin(*VOCABULARY) & ~F.coalesce(F.col("last") >= prose, F.lit(False))
    return rows.select(
        "doc_id", "item", "start", "end", "heading_end", "heading_text", "similarity", "found", "norm_chars",
        (F.col("named") != F.col("item")).alias("unclean"),
        F.when(substantive & F.col("item").isin(*FIGURED), F.coalesce("figures", F.lit(0)).cast("double") / F.greatest(chars, F.lit(1))).alias("density"),
        (substantive & lacks).alias("strange"),
    )


def _percent(share):
    return F.concat(F.bround(share * 100).cast("int").cast("string"), F.lit("%"))


def validate(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, seq, code, item, message): warnings of the battery, in its order.

    items: see ``segment.items``, of spans read by ``read_told``; manifest: doc_id, manifest.
    """
    out, held = F.col("status") == "extracted", F.col("start").isNotNull()
    whole = items.groupBy("doc_id").agg(
        F.count_if(F.col("status") == "missing").alias("missing"),
        F.count(F.lit(1)).alias("expected"),
        F.min(F.when(out, F.col("start"))).alias("first"),
        F.max(F.when(out, F.col("end"))).alias("end"),
        F.max(F.when(out, F.struct("start", "end", "item"))).alias("last"),
        F.greatest(F.max("norm_chars"), F.lit(1)).alias("n"),
        F.collect_set(F.when(held, F.col("item"))).alias("accepted"),
        F.max(F.when(F.col("item") == "8", F.col("density"))).alias("d8"),
        F.max(F.when(F.col("item") == "1A", F.col("density"))).alias("d1a"),
    )
    whole = whole.join(manifest, "doc_id", "left").withColumn("unmet", F.filter("manifest", lambda c: ~F.array_contains("accepted", c)))
    outside = (F.col("first") + (F.col("n") - F.col("end"))) / F.col("n")
    last = (F.col("last.end") - F.col("last.start")) / F.col("n")
    nothing = F.lit(None).cast("string")
    text = lambda *parts: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in parts))
    count = lambda c: F.col(c).cast("string")
    tests = [
        (1, "toc_manifest_mismatch", F.size("unmet") > 0, nothing, text("listed in the contents, but not found: ", F.array_join("unmet", ", "))),
        (2, "expected_items_mostly_missing", F.col("missing") / F.col("expected") > MISSING_MAX, nothing, text(count("missing"), " of ", count("expected"), " expected items have no heading")),
        (3, "unattributed_content", outside > UNATTRIBUTED_MAX, nothing, text(count("first"), " characters before the first item, ", (F.col("n") - F.col("end")).cast("string"), " after the last")),
        (4, "last_item_dominates", last > LAST_ITEM_MAX, F.col("last.item"), text("item ", F.col("last.item"), " takes ", _percent(last), " of the document")),
        (600, "numeric_density_inversion", F.col("d8") <= F.col("d1a"), F.lit("8"), text("item 8 has no more figures than item 1A")),
    ]
    rows_of = [F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(seq).alias("seq"), F.lit(code).alias("code"), item.alias("item"), message.alias("message"))) for seq, code, t, item, message in tests]
    by_doc = whole.select("doc_id", F.explode(F.filter(F.array(*rows_of), lambda x: x.isNotNull())).alias("w")).select("doc_id", "w.*")
    single = [("unclean", 100, "boundary_hygiene", " does not begin with its heading"), ("strange", 700, "keyword_fingerprint", " has none of its words")]
    item = F.col("item")
    marks = [F.when(F.col(c), F.struct((F.lit(s) + F.col("ord")).alias("seq"), F.lit(code).alias("code"), item.alias("item"), text("item ", item, says).alias("message"))) for c, s, code, says in single]
    by_item = items.select("doc_id", F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("w")).select("doc_id", "w.*")
    return by_doc.unionByName(by_item)


def score(items: DataFrame, warnings: DataFrame) -> DataFrame:
    """items with method, confidence_base, confidence, warnings of the item, ambiguous."""
    # a document's warnings are one row: its items meet them, and each other, by doc_id alone
    held = F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("seq", "code", "item")))).alias("held")
    rows = items.join(warnings.groupBy("doc_id").agg(held, F.bool_or(F.col("code").isin(*AMBIGUOUS)).alias("flagged")), "doc_id", "left")
    own = F.transform(F.filter("held", lambda w: w["item"] == F.col("item")), lambda w: w["code"])
    rows = rows.withColumn("warnings", own).drop("held")
    none_out = ~F.bool_or(F.col("status") == "extracted").over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("ambiguous", none_out | F.coalesce("flagged", F.lit(False))).drop("flagged")
    strict = F.coalesce("similarity", F.lit(0.0)) >= STRICT
    base = (
        F.when(F.col("status") == "extracted", F.when(strict, BASE_STRICT).otherwise(BASE_WEAK))
        .when(F.col("status") == "incorporated_by_reference", BASE_POINTER)
        .when(F.col("status") == "omitted", BASE_OMITTED)
        .otherwise(BASE_MISSING)
    )
    found = F.coalesce("warnings", F.array().cast("array<string>"))
    value = F.least(F.when(F.col("ambiguous"), BASE_WEAK).otherwise(CEILING), base - PENALTY * F.size(found))
    method = F.when(F.col("start").isNull(), "status_keyword").when(strict, "heading_strict").otherwise("heading_lenient")
    return rows.withColumns({"method": method, "confidence_base": base, "warnings": found, "confidence": F.bround(value, 2)})


def all_warnings(items: DataFrame, docs: DataFrame, battery: DataFrame) -> DataFrame:
    """(doc_id, stage, seq, code, item, message): refusal and selection, missing items, unknown period, then the battery.

    docs: all documents, with ``gate`` (see ``gate``), selection_warnings, period_end, form_type, raw_chars, norm_chars.
    """
    none = F.lit(None).cast("string")
    columns = ["doc_id", "stage", "seq", "code", "item", "message"]
    chosen = docs.select("doc_id", F.lit(0).alias("stage"), F.posexplode("selection_warnings").alias("seq", "w")).select("doc_id", "stage", "seq", "w.code", none.alias("item"), "w.message")
    failed = F.concat(F.col("raw_chars").cast("string"), F.lit(" raw characters left "), F.col("norm_chars").cast("string"))
    unsupported = F.concat(F.lit("form "), F.coalesce("form_type", F.lit("none")), F.lit(" is not segmented"))
    refused = docs.where("gate is not null").select(
        "doc_id", F.lit(0).alias("stage"), F.lit(1000).alias("seq"), F.when(F.col("gate") == "failed", "normalization_collapse").otherwise("unsupported_form").alias("code"),
        none.alias("item"), F.when(F.col("gate") == "failed", failed).otherwise(unsupported).alias("message"),
    )
    missing = items.where("status = 'missing'").select(
        "doc_id", F.lit(1).alias("stage"), F.col("ord").alias("seq"), F.lit("expected_item_missing").alias("code"), "item", F.concat(F.lit("no heading of item "), "item").alias("message")
    )
    unknown = docs.where("gate is null and period_end is null").select(
        "doc_id", F.lit(2).alias("stage"), F.lit(0).alias("seq"), F.lit("period_end_unknown").alias("code"), none.alias("item"), F.lit("no period of report: the expected items are a guess").alias("message")
    )
    rows = chosen.unionByName(refused).unionByName(missing).unionByName(unknown)
    return rows.unionByName(battery.withColumn("stage", F.lit(3))).select(*columns)


def doc_status(scored: DataFrame, warnings: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, doc_status): failed, unsupported, ambiguous, success_with_warning or success."""
    some = warnings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_warnings"))
    unclear = scored.groupBy("doc_id").agg(F.bool_or("ambiguous").alias("ambiguous"))
    rows = docs.select("doc_id", gate().alias("gate")).join(unclear, "doc_id", "left").join(some, "doc_id", "left")
    return rows.select("doc_id", status_of().alias("doc_status"))


def status_of():
    """A document's status, from gate, ambiguous (of any item) and n_warnings."""
    return F.coalesce("gate", F.when(F.col("ambiguous"), "ambiguous").when(F.col("n_warnings") > 0, "success_with_warning").otherwise("success"))
