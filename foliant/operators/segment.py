"""From normalized text to items: lines, candidates, contents pages, boundaries, status.

All steps work on narrow tables keyed by doc_id: a document's few notable lines are taken out of
its row together with their offsets, so no table of all lines is made or moved. What bodies say is
read in that pass too, line by line; only texts with words of reference meet the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import taxonomy
from foliant.functions import text as T
from foliant.functions.places import notable_lines, notable_stretches
from foliant.functions.python import code_ratio, line_starts, spans_read, texts_of
from foliant.sources.staging import stage

SIMILARITY_FLOOR = 0.37
DENSE_CODES, DENSE_GAP = 5, 400
NEXT_LINE_WINDOW = 600
REMAINDER_MAX = 300
#: Without one of these a body has no words of reference (see ``pointer_status``).
REFERRING = ("refer", "reported")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, raw, stripped, start, end: lines with 0-based offsets; end takes in the newline."""
    rows = docs.where("text is not null").select("doc_id", "text", line_starts("text").alias("starts"), F.length("text").alias("whole"))
    both = F.arrays_zip(F.split("text", "\n", -1).alias("raw"), F.col("starts").alias("start"))
    rows = rows.select("doc_id", "whole", F.posexplode(both).alias("line_no", "x")).select("doc_id", "line_no", "x.raw", "x.start", "whole")
    return rows.select("doc_id", "line_no", "raw", T.strip(F.col("raw")).alias("stripped"), "start", F.least(F.col("start") + F.length("raw") + 1, F.col("whole")).cast("int").alias("end"))


def _code(line: Column) -> Column:
    return F.concat(F.regexp_extract(line, T.HEADING, 1), F.upper(F.regexp_extract(line, T.HEADING, 2)))


def marked(docs: DataFrame, vocabulary: dict[str, tuple[str, ...]] | None = None, figured: tuple[str, ...] = (), least: int = 0) -> DataFrame:
    """The rows of ``notable``, and norm_chars and spoken of each doc_id, text, norm_chars (and period_end, if there), from one pass over a text.

    The pass finds lines that begin like notable ones; the patterns judge those. spoken: the text,
    if words of reference stand in it, beside the first line that the pass found. With a vocabulary
    (words by code) all lines found are given, with figures and last of the text up to the next one
    (see ``places.stretches_in``): as bodies begin and end at such lines, theirs are put together of them.
    """
    told = () if vocabulary is None else ("x.figures", "x.last")
    find = notable_lines(NEXT_LINE_WINDOW, REFERRING) if vocabulary is None else notable_stretches(NEXT_LINE_WINDOW, REFERRING, vocabulary, figured, least)
    carried = ["norm_chars", *(["period_end"] if "period_end" in docs.columns else [])]
    rows = docs.where("text is not null").select("doc_id", "text", *carried, find("text").alias("found"))
    rows = rows.select("doc_id", "text", *carried, "found.again", "found.said", F.posexplode("found.lines").alias("place", "x"))
    kinds = {"heading": T.HEADING, "officers": T.EXECUTIVE_OFFICERS, "tail": T.TAIL}
    rows = rows.select(
        "doc_id", F.col("x.raw").alias("raw"), T.strip(F.col("x.raw")).alias("stripped"), F.col("x.start").alias("start"), F.col("x.after").alias("after"),
        *(F.col("x.raw").rlike(p).alias(k) for k, p in kinds.items()), "again", *carried, F.when(F.col("said") & (F.col("place") == 0), F.col("text")).alias("spoken"), *told,
    )
    return rows if told else rows.where("heading or officers or tail or spoken is not null")


def notable(marked_: DataFrame) -> DataFrame:
    """doc_id, raw, stripped, start, after, the flags heading, officers, tail, and the document's ``again`` of each notable line.

    Notable are headings, executive officers' and closing lines. after: the characters that follow
    a heading without a title, within the window. again: whether two headings are of one code.
    """
    return marked_.where("heading or officers or tail").drop("norm_chars", "period_end", "spoken", "figures", "last")


def candidates(rows: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Heading lines of expected codes, with their features.

    rows: ``notable``; periods: doc_id, period_end. Without periods rows are ``marked`` ones that hold period_end
    themselves, and no rows are moved; norm_chars is then given too. A bare heading takes the next line as its
    title where that line reads like one and the line after it is no heading.
    """
    # one match tells the code and the title: a heading's pattern spans its line
    read = F.split(F.regexp_replace("raw", T.HEADING, "$1$2\u0001$3"), "\u0001", 2)
    head = rows.where("heading").withColumn("_read", read)
    head = head.withColumn("item", F.upper(F.get("_read", F.lit(0)))).withColumn("_title", F.get("_read", F.lit(1))).drop("_read")
    carried = ["norm_chars"] if periods is None else []
    if periods is not None:
        head = head.join(periods.select("doc_id", "period_end"), "doc_id")
    head = head.where(taxonomy.expects(F.col("item"), F.col("period_end")))
    line_end = F.col("start") + F.length("raw")
    # looked at behind bare headings only
    filled = F.when(F.col("own") == "", F.filter(F.transform(F.split("after", "\n", -1), T.strip), lambda x: x != ""))
    next_line = lambda i: F.coalesce(F.get("filled", F.lit(i)), F.lit(""))
    names = F.element_at(taxonomy.aliases(), F.col("item"))
    own = T.strip(F.col("_title"))
    head = head.select("*", own.alias("own"), names.alias("names")).select("*", filled.alias("filled"))
    head = head.select("*", next_line(0).alias("after1"), next_line(1).alias("after2"))
    # exact titles are settled natively; only the rest is compared by the Python function
    shown = F.when(F.col("own") != "", F.col("own")).otherwise(F.col("after1"))
    head = head.withColumn("shown", T.norm_title(shown))
    exact = (F.col("shown") == "") | F.array_contains("names", F.col("shown"))
    head = head.withColumn("ratio", code_ratio(taxonomy.alias_lists())(F.when(~exact, F.col("shown")), F.when(~exact, F.col("item"))))
    head = head.withColumn("score", F.when(F.col("shown") == "", 0.0).when(exact, 1.0).otherwise(F.col("ratio")))
    via = (F.col("own") == "") & (F.col("score") >= SIMILARITY_FLOOR) & ~F.col("after2").rlike(T.HEADING)
    head = head.withColumn("title_on_next_line", via).withColumn("title", F.when(F.col("own") != "", F.col("own")).when(via, F.col("after1")).otherwise(F.lit("")))
    # only blanks stand before the promoted line
    promoted = line_end + F.call_function("locate", F.col("after1"), F.col("after")) - 1 + F.length("after1")
    return head.select(
        "doc_id", "item", "start",
        F.when(via, promoted).otherwise(line_end).cast("int").alias("heading_end"),
        F.col("stripped").alias("heading_text"), "title",
        F.when(F.col("title") == "", 0.0).otherwise(F.bround("score", 3)).alias("similarity"),
        (F.col("title") != "").alias("titled"),
        "title_on_next_line",
        (F.col("stripped") == F.upper("stripped")).alias("upper"),
        "again", *carried,
    )


def contents_runs(cands: DataFrame, member: Column) -> DataFrame:
    """cands with run_id, n_codes, dense, echo, recurs, contents for the rows that are members.

    Runs are islands of members at most DENSE_GAP apart. A dense run names DENSE_CODES codes. It
    echoes where half its codes stood earlier outside any dense run. A member recurs where its
    code comes again later, not in an echo; a dense run is a contents page where half its codes
    recur. Occurrences are looked for among all rows.
    """
    # one exchange serves all windows, which are each within a document
    rows = cands.withColumn("member", member).repartition("doc_id")
    by_start = Window.partitionBy("doc_id", "member").orderBy("start")
    rows = rows.withColumn("gap", F.when(F.col("start") - F.lag("start").over(by_start) > DENSE_GAP, 1).otherwise(0))
    rows = rows.withColumn("run_id", F.sum("gap").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("doc_id", "member", "run_id")
    code = Window.partitionBy("doc_id", "item")
    codes = lambda when: F.size(F.collect_set(F.when(when, F.col("item"))).over(run))
    rows = rows.withColumn("n_codes", codes(F.lit(True))).withColumn("dense", F.col("member") & (F.col("n_codes") >= DENSE_CODES))
    rows = rows.withColumn("before", F.coalesce(F.min(F.when(~F.col("dense"), F.col("start"))).over(code) < F.col("start"), F.lit(False)))
    rows = rows.withColumn("echo", F.col("dense") & (codes(F.col("before")) * 2 >= F.col("n_codes")))
    rows = rows.withColumn("recurs", F.coalesce(F.max(F.when(~F.col("echo"), F.col("start"))).over(code) > F.col("start"), F.lit(False)))
    rows = rows.withColumn("contents", F.col("dense") & (codes(F.col("recurs")) * 2 >= F.col("n_codes")))
    return rows.drop("gap", "before")


def filter_candidates(cands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(survivors, manifest by doc_id, rejected rows with why). cands: see ``candidates``."""
    why = F.when(~F.col("titled"), F.lit("no title on heading line")).when(F.col("similarity") < SIMILARITY_FLOOR, F.concat(F.lit("title similarity "), F.col("similarity").cast("string")))
    judged = cands.withColumn("why", why)
    # no code comes again where each has one heading: such documents have no contents page
    runs = lambda rows, member: contents_runs(rows.where("again"), member)
    passed = judged.where("why is null")
    single = passed.where("not again").withColumns({"recurs": F.lit(False), "contents": F.lit(False)})
    # survivors, manifest and rejected rows are all taken from it
    kept = stage(runs(passed, F.lit(True)).select(single.columns).union(single), "kept")
    drop = F.col("contents") & F.col("recurs")
    survivors = kept.where(~drop).select(*cands.columns)
    listed = lambda rows: rows.where("contents").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "item"))), lambda x: x["item"]).alias("manifest"))
    bare = listed(runs(cands, ~F.col("titled"))).withColumnRenamed("manifest", "bare")
    manifest = listed(kept).join(bare, "doc_id", "full_outer").select("doc_id", F.coalesce("manifest", "bare").alias("manifest"))
    rejected = judged.where("why is not null").select(*cands.columns, "why").union(kept.where(drop).select(*cands.columns, F.lit("table-of-contents cluster").alias("why")))
    return survivors, manifest, rejected


def assign(survivors: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Ordered greedy choice: for each expected code its first survivor at or after the cursor.

    Without periods all survivors are of expected codes (see ``candidates``) and hold norm_chars, which is given too.

    The cursor moves to the heading's end; a code without one leaves it. One fold per document over
    the codes that were found (23 at most), each with its own places only.
    """
    rows = survivors.repartition("doc_id")  # serves both groupings
    places = F.array_sort(F.collect_list(F.struct("start", "heading_end", "heading_text", "similarity"))).alias("places")
    carried = ["norm_chars"] if periods is None else []
    held = [F.max(c).alias(c) for c in carried]
    found = rows.groupBy("doc_id", "item").agg(places, *held).groupBy("doc_id").agg(F.collect_list(F.struct("item", "places")).alias("codes"), *held)
    if periods is None:
        found = found.withColumn("expected", F.array(*map(F.lit, taxonomy.ORDER)))
    else:
        found = found.join(periods.select("doc_id", taxonomy.expected_codes(F.col("period_end")).alias("expected")), "doc_id")
    ranked = F.transform("codes", lambda x: F.struct(F.array_position("expected", x["item"]).alias("ord"), x["item"].alias("item"), x["places"].alias("places")))
    found = found.select("doc_id", *carried, F.array_sort(F.filter(ranked, lambda x: x["ord"] > 0)).alias("codes"))
    kind = "array<struct<start:int,item:string,heading_end:int,heading_text:string,similarity:double>>"
    zero = F.struct(F.lit(0).alias("cursor"), F.array().cast(kind).alias("taken"))

    def take(state, code):
        hit = F.get(F.filter(code["places"], lambda x: x["start"] >= state["cursor"]), F.lit(0))
        own = lambda x: F.struct(x["start"].alias("start"), code["item"].alias("item"), *(x[c].alias(c) for c in ("heading_end", "heading_text", "similarity")))
        # a transform of one element: the place is looked for once
        return F.get(F.transform(F.array(hit), lambda x: F.when(x.isNull(), state).otherwise(F.struct(x["heading_end"].alias("cursor"), F.concat(state["taken"], F.array(own(x))).alias("taken")))), F.lit(0))

    return found.select("doc_id", *carried, F.explode(F.aggregate("codes", zero, take)["taken"]).alias("a")).select("doc_id", *carried, "a.*")


def spans(accepted: DataFrame, rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """accepted with ``end``: the next heading, clipped at executive officers and at the signatures.

    rows: ``notable``; sizes: doc_id, norm_chars, which accepted holds itself without them.
    """
    order = Window.partitionBy("doc_id").orderBy("start")
    out = accepted if sizes is None else accepted.join(sizes.select("doc_id", "norm_chars"), "doc_id")
    out = out.withColumn("next", F.lead("start").over(order)).withColumn("last", F.col("next").isNull())
    out = out.withColumn("bound", F.coalesce("next", "norm_chars"))
    marks = rows.where("officers or tail").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").alias("at"), "officers", "tail")).alias("marks"))
    out = out.join(marks, "doc_id", "left")
    first = lambda test: F.array_min(F.transform(F.filter("marks", lambda m: (m["at"] >= F.col("heading_end")) & test(m)), lambda m: m["at"]))
    officers = F.when(F.col("item") != "10", first(lambda m: m["officers"] & (m["at"] < F.col("bound"))))
    tail = F.when(F.col("last"), first(lambda m: m["tail"]))
    return out.select("doc_id", "item", "start", F.least("bound", officers, tail).cast("int").alias("end"), "heading_end", "heading_text", "similarity")


def places(spans: str) -> Column:
    """start and end of an array of spans."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _with_spans(spanned: DataFrame, docs: DataFrame) -> DataFrame:
    row = ("start", "end", "item", "heading_end", "heading_text", "similarity")
    nested = spanned.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*row))).alias("spans"))
    return docs.select("doc_id", "text", "norm_chars").join(nested, "doc_id")


def bodies_asked(spanned: DataFrame, docs: DataFrame, codes: tuple[str, ...], least: int) -> DataFrame:
    """As ``bodies``, with ``head``, ``chars`` and ``says`` (see ``spans_read``) of each body, and the body itself only where its words are asked for.

    These are the bodies that may point to another document, and those of the codes with ``least`` characters.
    """
    asked = spans_read(REFERRING, codes, least)("text", F.transform("spans", lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "item", "heading_end")))))
    cut = F.zip_with("spans", "read", lambda s, r: F.struct(s.alias("s"), r.alias("r")))
    rows = _with_spans(spanned, docs).withColumn("read", asked)
    return rows.select("doc_id", "norm_chars", F.explode(cut).alias("x")).select("doc_id", "norm_chars", "x.s.*", "x.r.*")


def told(spanned: DataFrame, marked_: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """spanned with norm_chars, named, line_end, figures and last of each body, from the lines within it; no text is read.

    marked_: see ``marked``, of a vocabulary of the codes. named: the code that the first 60 characters of a heading's line give;
    last: the last place of a word of the body's code.
    """
    row = ("start", "end", "item", "heading_end", "heading_text", "similarity")
    nested = spanned.groupBy("doc_id").agg(F.collect_list(F.struct(*row)).alias("spans"))
    rows = marked_.select(
        "doc_id", F.col("start").alias("at"), (F.col("start") + F.length("raw")).alias("line_end"), F.when(F.col("heading"), _code(F.substring("raw", 1, 60))).alias("named"),
        "norm_chars", "figures", "last",
    ).join(nested, "doc_id")
    own = F.get(F.filter("spans", lambda s: (s["start"] <= F.col("at")) & (F.col("at") < s["end"])), F.lit(0))
    rows = rows.withColumn("s", own).drop("spans").where("s is not null")
    first = lambda c: F.max(F.when(F.col("at") == F.col("s.start"), F.col(c))).alias(c)
    place = F.array_position(F.array(*map(F.lit, codes)), F.col("s.item")).cast("int") - 1
    last = F.when(place >= 0, F.get("last", place))
    held = rows.groupBy("doc_id", F.col("s.item").alias("_item")).agg(F.max("s").alias("s"), F.max("norm_chars").alias("norm_chars"), first("named"), first("line_end"), F.sum("figures").alias("figures"), F.max(last).alias("last"))
    return held.select("doc_id", "s.*", "norm_chars", "named", "line_end", "figures", "last")


def bodies(spanned: DataFrame, docs: DataFrame) -> DataFrame:
    """spanned with ``body`` (the span's text) and ``norm_chars``; docs: doc_id, text, norm_chars.

    A document's spans meet its text as one row, which is cut into bodies where it stands.
    """
    rows = _with_spans(spanned, docs).withColumn("texts", texts_of("text", places("spans")))
    cut = F.zip_with("spans", "texts", lambda s, t: F.struct(s.alias("s"), t.alias("body")))
    return rows.select("doc_id", "norm_chars", F.explode(cut).alias("x")).select("doc_id", "norm_chars", "x.s.*", "x.body")


def pointer_status(rows: DataFrame, body: Column | None = None) -> DataFrame:
    """rows with ``found``: whether a body is its content or points to another document's.

    Only bodies with words of reference are flattened and split into sentences; each step is a
    projection of its own, so no array is built twice.
    """
    rows = rows.withColumn("_own", F.col("body") if body is None else body)
    refers = F.col("_own").rlike(r"(?iU)by\s+reference|reported\s+on\s+pages|refer\s+to")
    rows = rows.withColumn("_flat", F.when(refers, T.flat(F.col("_own")))).withColumn("_parts", T.sentences(F.col("_flat")))
    rows = rows.withColumn("_points", F.transform("_parts", T.is_pointer))
    stop = F.array_position("_points", False).cast("int")
    rows = rows.withColumn("_n", F.when(stop > 0, stop - 1).otherwise(F.size("_parts")))
    rows = rows.withColumn("_lead", F.array_join(F.slice("_parts", F.lit(1), F.greatest(F.col("_n"), F.lit(0))), " "))
    rest = F.filter("_parts", lambda s, i: (i >= F.col("_n")) & ~F.get("_points", i))
    prose = F.aggregate(rest, F.lit(0), lambda a, s: a + F.length(s))
    away = F.col("_flat").rlike(T.BY_REFERENCE) & F.col("_lead").rlike(T.BY_REFERENCE) & F.col("_lead").rlike(T.OTHER_DOCUMENT) & (prose <= REMAINDER_MAX)
    found = F.when(F.coalesce(away, F.lit(False)), "incorporated_by_reference").otherwise("extracted")
    return rows.withColumn("found", found).drop("_own", "_flat", "_parts", "_points", "_n", "_lead")


def pointers(spanned: DataFrame, marked_: DataFrame) -> DataFrame:
    """doc_id, item, found of the spans that point to another document; only texts with words of reference are moved."""
    spoken = marked_.where("spoken is not null").select("doc_id", F.col("spoken").alias("text"), "norm_chars")
    rows = bodies_asked(spanned, spoken, (), 0).where("says")
    title_end = F.greatest(F.col("heading_end") - F.col("start"), F.lit(0))
    found = pointer_status(rows, F.substring("body", title_end + 1, F.col("chars")))
    return found.where("found = 'incorporated_by_reference'").select("doc_id", "item", "found")


def statuses(spanned: DataFrame, pointing: DataFrame, facts: DataFrame) -> DataFrame:
    """doc_id, item, start, end, status of each document and expected code, as ``items`` gives them. pointing: see ``pointers``."""
    held = spanned.select("doc_id", "item", "start", "end").join(pointing, ["doc_id", "item"], "left")
    held = held.withColumn("found", F.coalesce("found", F.lit("extracted")))
    return with_status(expected_items(facts).join(held, ["doc_id", "item"], "left")).select("doc_id", "item", "start", "end", "status")


def with_status(rows: DataFrame) -> DataFrame:
    """rows of expected codes with ``status`` in the place of ``found``, which is null where a code has no heading."""
    absent = F.when(F.col("item").isin(*taxonomy.MAY_BE_ABSENT), "omitted").otherwise("missing")
    return rows.withColumn("status", F.coalesce("found", absent)).drop("found")


def items(judged: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each document and expected code: label, span, status, and what its body says.

    judged: spans with ``found`` and the body's facts; facts: doc_id, period_end.
    """
    label = F.broadcast(taxonomy.label_dim(facts.sparkSession).drop("ord"))
    p = F.col("period_end")
    fits = (F.col("item") == F.col("code")) & F.when(p.isNull(), F.col("valid_from").isNull()).otherwise(
        (F.col("valid_from").isNull() | (p >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (p < F.col("valid_to")))
    )
    rows = expected_items(facts).join(label, fits).drop("code", "valid_from", "valid_to")
    return with_status(rows.join(judged, ["doc_id", "item"], "left"))


def expected_items(facts: DataFrame) -> DataFrame:
    """doc_id, period_end, item, ord: a range join of periods with the dates that codes were added."""
    dim = F.broadcast(taxonomy.item_dim(facts.sparkSession))
    due = F.col("added_on").isNull() | (F.col("period_end") >= F.col("added_on"))
    return facts.select("doc_id", "period_end").join(dim, due).select("doc_id", "period_end", F.col("code").alias("item"), "ord")
