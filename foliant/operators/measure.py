"""Rates over judged checks, calibration, screens, comparison of two tools and benchmark statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.python import text_ratio
from foliant.sources.staging import small, stage

CONFIDENT = 0.8
SUCCESS = ("success", "success_with_warning")
# The groups of checks behind the rates.
PRESENCE, ANCHOR, BAND, FALSE_POSITIVE = ("item_present",), ("text_contains",), ("min_chars", "max_chars"), ("item_absent", "known_items_only", "text_not_contains", "only_items")


def rate(part: Column, whole: Column) -> Column:
    """part / whole to 4 places; null where there is nothing to rate."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), 4)


def check_rates(judged: DataFrame) -> DataFrame:
    """(metric, value, sample) of the rates behind metrics 1 to 5."""
    within = lambda names: F.col("type").isin(*names)
    groups = {"presence_recall": PRESENCE, "anchor_containment": ANCHOR, "boundary_band": BAND, "false_positive": FALSE_POSITIVE}
    cells = [F.struct(F.lit(n).alias("metric"), F.count_if(within(g) & F.col("passed")).alias("good"), F.count_if(within(g)).alias("sample")) for n, g in groups.items()]
    rows = judged.agg(F.array(*cells).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    value = rate(F.col("good"), F.col("sample"))
    return rows.select("metric", F.when(F.col("metric") == "false_positive", F.bround(1 - value, 4)).otherwise(value).alias("value"), "sample")


def failed_declarations(declared: DataFrame, failures: DataFrame, crashed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(declared checks with failed, failures that no declared check matches), by canonical key.

    declared and failures: case_id, check_key; a crashed case fails all of its checks.
    """
    keys = failures.select("case_id", "check_key").distinct()
    rows = declared.join(keys.withColumn("hit", F.lit(True)), ["case_id", "check_key"], "left").join(crashed.select("case_id", F.lit(True).alias("crash")).distinct(), "case_id", "left")
    failed = F.coalesce("hit", "crash", F.lit(False))
    return rows.withColumn("failed", failed).drop("hit", "crash"), failures.join(declared, ["case_id", "check_key"], "left_anti")


def silent_failures(items: DataFrame) -> DataFrame:
    """One row of counts over items (doc_status, confidence, targeted, failed)."""
    sure = F.coalesce("confidence", F.lit(0.0)) >= CONFIDENT
    good = F.col("doc_status").isin(*SUCCESS)
    targeted, silent = F.count_if(sure & good & F.col("targeted")), F.count_if(sure & good & F.col("targeted") & F.col("failed"))
    return items.agg(
        rate(silent, targeted).alias("silent_failure_rate"), targeted.alias("targeted"), silent.alias("silent"),
        F.count_if(sure & good & ~F.col("targeted")).alias("unaudited"), F.count_if(sure & ~good).alias("excluded"),
    )


def calibration(items: DataFrame) -> DataFrame:
    """confidence, n_targeted, failed, n_debt_targeted, debt_failed of targeted items (with debt)."""
    debt, failed = F.col("debt"), F.col("failed")
    return items.where("targeted and confidence is not null").groupBy("confidence").agg(
        F.count_if(~debt).alias("n_targeted"), F.count_if(~debt & failed).alias("failed"), F.count_if(debt).alias("n_debt_targeted"), F.count_if(debt & failed).alias("debt_failed")
    )


RANKS = 1024


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, n, before, total: each distinct value of a key, how often it comes, and how many rows are smaller.

    Counts are taken first, then running sums in two levels: over RANKS ranges of each key's
    values, and over the values of a range. No key's rows meet in one task. Nulls are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    span = counts.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("n").alias("total"))
    share = F.coalesce(F.try_divide((F.col(value) - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double")), F.lit(0.0))
    rows = counts.join(span, key).withColumn("_range", F.least(F.floor(share * RANKS), F.lit(RANKS - 1)))
    over = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, "_range").agg(F.sum("n").alias("_n"))
    sums = sums.select(key, "_range", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, [key, "_range"])
    return rows.select(key, value, "n", (F.col("_before") + F.col("_within")).alias("before"), "total", "_range")


def _at(value: str, index: Column) -> Column:
    """The value at a 0-based index of the sorted rows."""
    return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("n")), F.col(value)))


def floor_index(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per key the values at index min(n - 1, floor(n * p)) of the sorted values."""
    index = lambda p: F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(p)))
    return value_counts(df, key, value).groupBy(key).agg(*(_at(value, index(p)).alias(name) for name, p in shares.items()))


def nearest_rank(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per key the values at index ceil(n * p) - 1 of the sorted values."""
    index = lambda p: F.least(F.col("total") - 1, F.greatest(F.ceil(F.col("total") * F.lit(p)) - 1, F.lit(0)))
    return value_counts(df, key, value).groupBy(key).agg(*(_at(value, index(p)).alias(name) for name, p in shares.items()))


def interpolated(df: DataFrame, key: str, value: str, shares: dict[str, float], digits: int = 6) -> DataFrame:
    """Per key the values at place (n - 1) * p, between two rows in proportion."""
    rows = value_counts(df, key, value)

    def pick(p: float) -> Column:
        place = F.max((F.col("total") - 1) * F.lit(p))
        low = _at(value, F.floor((F.col("total") - 1) * F.lit(p)))
        high = _at(value, F.least(F.floor((F.col("total") - 1) * F.lit(p)) + 1, F.col("total") - 1))
        return low + (high - low) * (place - F.floor(place))

    return rows.groupBy(key).agg(*(F.round(pick(p), digits).alias(name) for name, p in shares.items()))


def coverage(items: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, coverage, gap_frac, gap_before, gap_after: covered share and largest gap between spans."""
    spans = items.where("start is not null and end is not null").select("doc_id", "item", "start", "end").join(docs.select("doc_id", "norm_chars"), "doc_id")
    order = Window.partitionBy("doc_id").orderBy("start")
    rows = spans.withColumn("gap", F.lead("start").over(order) - F.col("end")).withColumn("after", F.lead("item").over(order))
    n = F.greatest(F.max("norm_chars"), F.lit(1))
    widest = F.max_by(F.struct("item", "after"), F.when(F.col("gap") > 0, F.struct("gap", (-F.col("start")).alias("at"))))
    return rows.groupBy("doc_id").agg(
        F.round(F.sum(F.col("end") - F.col("start")) / n, 6).alias("coverage"),
        F.round(F.greatest(F.coalesce(F.max("gap"), F.lit(0)), F.lit(0)) / n, 6).alias("gap_frac"),
        widest["item"].alias("gap_before"), widest["after"].alias("gap_after"),
    )


def locate_by_runway(notable: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, item, located, runway, hits: of each code's heading lines the one with the longest way to the next heading.

    A forward as-of join, as a lead over the headings of a document.
    """
    line = r"(?i)^[ \t\u00a0]*item[ \t\u00a0]*(\d{1,2})([ \t]?)([A-D])?(?![A-Za-z0-9])"
    rows = notable.where(F.col("raw").rlike(line)).join(docs.select("doc_id", "norm_chars"), "doc_id")
    number, letter = F.regexp_extract("raw", line, 1), F.upper(F.regexp_extract("raw", line, 3))
    # a letter that stands apart may be the code's or the title's: such a line counts for both
    apart = (letter != "") & (F.regexp_extract("raw", line, 2) != "")
    codes = F.when(letter == "", F.array(number)).when(apart, F.array(number, F.concat(number, letter))).otherwise(F.array(F.concat(number, letter)))
    order = Window.partitionBy("doc_id").orderBy("start")
    rows = rows.select("doc_id", codes.alias("codes"), "start", (F.coalesce(F.lead("start").over(order), F.col("norm_chars")) - F.col("start")).alias("runway"))
    best = F.max(F.struct("runway", (-F.col("start")).alias("at")))
    return rows.select("doc_id", F.explode("codes").alias("item"), "start", "runway").groupBy("doc_id", "item").agg((-best["at"]).alias("located"), best["runway"].alias("runway"), F.count(F.lit(1)).alias("hits"))


SHORT_SPAN, LEAST_RUNWAY, LEAST_COVERAGE = 100, 300, 0.42


def screen(scored: DataFrame, status: DataFrame, covered: DataFrame, located: DataFrame) -> DataFrame:
    """doc_id, item, status, confidence, population, findings: each item against measures that no label decides.

    scored: see ``judge.score``; covered: ``coverage``; located: ``locate_by_runway``. population:
    confident items of documents that are a success. findings: short_span, heading_divergence,
    missing_but_located, low_span_coverage, large_interior_gap.
    """
    rows = scored.select("doc_id", "item", "status", "confidence", "start", "end").join(status, "doc_id")
    rows = rows.join(covered.select("doc_id", "coverage", "gap_frac"), "doc_id", "left").join(located.select("doc_id", "item", "located", "runway"), ["doc_id", "item"], "left")
    good, held = F.col("doc_status").isin(*SUCCESS), F.col("start").isNotNull()
    tests = [
        ("short_span", good & held & (F.col("end") - F.col("start") < SHORT_SPAN)),
        ("heading_divergence", held & ~F.col("located").between(F.col("start"), F.col("end") - 1)),
        ("missing_but_located", ~held & (F.col("runway") >= LEAST_RUNWAY)),
        ("low_span_coverage", good & (F.col("coverage") < LEAST_COVERAGE)),
        ("large_interior_gap", good & (F.col("gap_frac") > 0)),
    ]
    found = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in tests)), lambda x: x.isNotNull())
    return rows.select("doc_id", "item", "status", "confidence", (good & (F.coalesce("confidence", F.lit(0.0)) >= CONFIDENT)).alias("population"), found.alias("findings"))


def screened_rate(screened: DataFrame) -> DataFrame:
    """One row: flagged and confident items, and their rate."""
    total, flagged = F.count_if("population"), F.count_if(F.col("population") & (F.size("findings") > 0))
    return screened.agg(flagged.alias("flagged"), total.alias("confident"), rate(flagged, total).alias("screened_rate"))


def span_lengths(scored: DataFrame, status: DataFrame) -> DataFrame:
    """(every, chars) of the spans in documents that are a success."""
    rows = scored.where("start is not null").join(status.where(F.col("doc_status").isin(*SUCCESS)), "doc_id")
    return rows.select(F.lit("all").alias("every"), (F.col("end") - F.col("start")).alias("chars"))


ABSENT = ("missing", "omitted")


def best_sections(sections: DataFrame) -> DataFrame:
    """One section a document and code (upper-cased) of another tool's (doc_id, item, confidence, ...): the most confident, ties to the first text.

    Sections may hold ``words``, the length of their text's words (see ``compare_tools``), in the place of the text; ties then go to the shorter one.
    """
    named = sections.where(F.coalesce("item", F.lit("")) != "").withColumn("item", F.upper("item"))
    held, tie = ("words", -F.col("words")) if "words" in sections.columns else ("text", F.reverse(F.col("text")))
    best = F.max_by(F.struct("confidence", held), F.struct(F.coalesce("confidence", F.lit(0.0)), tie))
    return named.groupBy("doc_id", "item").agg(best.alias("b")).select("doc_id", "item", "b.confidence", f"b.{held}")


def compare_tools(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Our items (doc_id, item, status, text) against another tool's sections (doc_id, item, text), by presence and length.

    class: presence (one has it; direction says which), content (both; length_ratio), or
    agree_absent. Items that only they have are left out: the expected items are ours. Either side may hold
    ``words``, the length of ``text.same_words``, in the place of its text, so that no text is moved.
    """
    held = "words" if "words" in ours.columns else "text"
    rows = ours.join(theirs.select("doc_id", "item", F.col(held).alias(f"their_{held}")), ["doc_id", "item"], "left")
    mine, other = ~F.col("status").isin(*ABSENT), F.col(f"their_{held}").isNotNull()
    kind = F.when(mine != other, "presence").when(mine & other, "content").otherwise("agree_absent")
    direction = F.when(mine & ~other, "only_ours").when(~mine & other, "only_theirs")
    a, b = (F.col(c) if held == "words" else F.length(T.same_words(F.col(c))) for c in (held, f"their_{held}"))
    ratio = F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(1.0)
    return rows.select("doc_id", "item", "status", held, f"their_{held}", kind.alias("class"), direction.alias("direction"), F.when(kind == "content", F.bround(ratio, 4)).alias("length_ratio"))


def content_similarity(compared: DataFrame) -> DataFrame:
    """compared with similarity of the items that both tools have, by matching blocks (see ``functions.similarity``)."""
    both = F.col("class") == "content"
    return compared.where(both).withColumn("similarity", F.bround(text_ratio(T.same_words(F.col("text")), T.same_words(F.col("their_text"))), 4))


def ranked_disagreements(compared: DataFrame, by: str, below: float) -> DataFrame:
    """Presence, and content below the cut, with a rank within each document and class: the least alike first, ties by item.

    Presence with rank is a document's disagreements in the order of their codes. Ordering the
    corpus by (class descending, ``by``, doc_id, item) gives one list; it is left to the reader of
    the table, so that no job sorts what is only filtered.
    """
    rows = compared.where((F.col("class") == "presence") | ((F.col("class") == "content") & (F.col(by) < below)))
    order = Window.partitionBy("doc_id", "class").orderBy(F.col(by).asc_nulls_first(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def compare_presence(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Two tools' items (doc_id, item, chars): presence on either side and the ratio of lengths."""
    a, b = ours.withColumnRenamed("chars", "ours"), theirs.withColumnRenamed("chars", "theirs")
    rows = a.join(b, ["doc_id", "item"], "full_outer")
    kind = F.when(F.col("ours").isNull(), "only_theirs").when(F.col("theirs").isNull(), "only_ours").otherwise("both")
    return rows.select("doc_id", "item", kind.alias("presence"), F.round(F.try_divide(F.least("ours", "theirs"), F.greatest("ours", "theirs")), 6).alias("length_ratio"))


def widest_cut(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the middle of the widest gap of the sorted values; ties to the higher gap."""
    rows = value_counts(df, key, value)
    within = Window.partitionBy(key, "_range").orderBy(value)
    near = rows.select(key, F.col(value).alias("lo"), F.lead(value).over(within).alias("hi")).where("hi is not null")
    ends = rows.groupBy(key, "_range").agg(F.min(value).alias("least"), F.max(value).alias("lo"))
    far = ends.select(key, "lo", F.lead("least").over(Window.partitionBy(key).orderBy("_range")).alias("hi")).where("hi is not null")
    same = rows.where("n > 1").select(key, F.col(value).alias("lo"), F.col(value).alias("hi"))
    best = F.max(F.struct((F.col("hi") - F.col("lo")).alias("gap"), "lo", "hi"))
    return near.union(far).union(same).groupBy(key).agg(best.alias("b")).select(key, "b.gap", ((F.col("b.lo") + F.col("b.hi")) / 2).alias("cut"))


def r_squared(y: str, x: str) -> Column:
    """Of y on x; null for fewer than 3 rows or where either is constant."""
    ok = (F.count(F.lit(1)) >= 3) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return F.when(ok, F.round(F.regr_r2(y, x), 4))


def plateau(df: DataFrame, key: str, order: str, value: str, within: float) -> DataFrame:
    """Per key the first place from which all later values stay within a distance of the greatest.

    That is the first place behind the last one whose value lies further off. Both are aggregates
    and tasks combine them first, so a key may hold any number of rows. Rows of one place stand or
    fall together; null values are within any distance. A key whose last value lies off has none.
    """
    same = lambda name: F.col(key).eqNullSafe(F.col(name))
    peaks = df.groupBy(F.col(key).alias("_key")).agg(F.max(value).alias("_peak"))
    off = df.join(small(peaks), same("_key")).where(F.col("_peak") - F.col(value) > within)
    last = stage(off.groupBy(F.col(key).alias("_key")).agg(F.max(order).alias("_last")), "last-off")
    rows = df.join(small(last), same("_key"), "left").where(F.col("_last").isNull() | (F.col(order) > F.col("_last")))
    return rows.groupBy(key).agg(F.min(order).alias("from"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """WCAG relative luminance of 8-bit colour parts."""
    part = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * part(r) + 0.7152 * part(g) + 0.0722 * part(b)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


# ---- runs and their metrics


def run_score(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """suite, passed, total, score, baseline, red, verdict of results (suite, passed); baseline: suite, score.

    The invariant suite has to pass whole; another is a regression where it scores below its baseline.
    """
    sums = results.groupBy("suite").agg(F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"), F.count(F.lit(1)).alias("total"))
    rows = sums.withColumn("score", F.col("passed") / F.col("total")).join(baseline.select("suite", F.col("score").alias("baseline")), "suite", "left")
    below = F.coalesce(F.col("score") < F.col("baseline"), F.lit(False))
    broken = (F.col("suite") == "invariant") & (F.col("passed") < F.col("total"))
    verdict = F.when(broken, "invariant violation").when(below, "regression").otherwise("accepted")
    return rows.withColumns({"red": (F.col("passed") < F.col("total")) | below, "verdict": verdict})


def success_by_kind(results: DataFrame) -> DataFrame:
    """kind, passed, sample, value of results (kind, passed, doc_status): passed cases of documents that are a success."""
    good = F.count_if(F.coalesce("passed", F.lit(False)) & F.col("doc_status").isin(*SUCCESS))
    return results.groupBy("kind").agg(good.alias("passed"), F.count(F.lit(1)).alias("sample"), rate(good, F.count(F.lit(1))).alias("value"))


def deterministic_share(scored: DataFrame) -> DataFrame:
    """One row: the share of extracted items that no fallback found, and their number."""
    out = F.col("status") == "extracted"
    plain = F.count_if(out & (F.col("method") != "llm_fallback"))
    return scored.agg(rate(plain, F.count_if(out)).alias("value"), F.count_if(out).alias("sample"))


def render(metrics: DataFrame, bands: DataFrame | None = None) -> DataFrame:
    """(n, seq, line): metrics (n, metric, value, sample) as lines of a report, the calibration's bands (confidence, targeted, failed) under number 8.

    Values without a denominator read ``None``.
    """
    value = F.coalesce(F.col("value").cast("string"), F.lit("None"))
    lines = metrics.select("n", F.lit(0).alias("seq"), F.concat(F.lpad(F.col("n").cast("string"), 2, " "), F.lit(". "), F.rpad("metric", 32, " "), F.lit(" "), value, F.lit("   (n="), F.col("sample").cast("string"), F.lit(")")).alias("line"))
    if bands is None:
        return lines
    seq = F.row_number().over(Window.orderBy("confidence"))  # a row a level of confidence, of which there are few
    shown = F.concat(F.lit("       conf="), F.rpad(F.col("confidence").cast("string"), 5, " "), F.lit(" targeted="), F.rpad(F.col("targeted").cast("string"), 4, " "), F.lit(" failed="), F.col("failed").cast("string"))
    head = bands.sparkSession.createDataFrame([(8, 0, " 8. calibration")], "n int, seq int, line string")
    return lines.union(head).union(bands.select(F.lit(8).alias("n"), seq.alias("seq"), shown.alias("line")))


def metric_table(judged: DataFrame, silent: DataFrame, by_kind: DataFrame, share: DataFrame) -> DataFrame:
    """(n, metric, value, sample) of the metrics that are one number each."""
    numbers = F.element_at(F.create_map(*(x for k, v in (("presence_recall", 1), ("anchor_containment", 3), ("boundary_band", 4), ("false_positive", 5)) for x in (F.lit(k), F.lit(v)))), F.col("metric"))
    rates = check_rates(judged).select(numbers.alias("n"), "metric", "value", "sample")
    same = rates.where("n = 1").select(F.lit(2).alias("n"), F.lit("status_accuracy").alias("metric"), "value", "sample")
    six = silent.select(F.lit(6).alias("n"), F.lit("silent_failure").alias("metric"), F.col("silent_failure_rate").alias("value"), F.col("targeted").alias("sample"))
    seven = by_kind.where("kind = 'golden'").select(F.lit(7).alias("n"), F.lit("golden_success").alias("metric"), "value", "sample")
    cost = share.select(F.lit(10).alias("n"), F.lit("cost_per_filing").alias("metric"), F.lit(0.0).alias("value"), "sample")
    eleven = share.select(F.lit(11).alias("n"), F.lit("deterministic_share").alias("metric"), "value", "sample")
    return rates.union(same).union(six).union(seven).union(cost).union(eleven)


# ---- benchmark

MIB, GIB = 1 << 20, 1 << 30
REFUSED = ("unsupported", "failed")
RATIO_FLOOR, PLATEAU = 0.001, 0.5
CHARS_PER_TOKEN = 4
#: (model, dollars a million input tokens, tokens of its context): a price table to be given by the caller.
MODELS = (("large", 5.0, 1_000_000), ("small", 1.0, 200_000))


def bench_records(timed: DataFrame) -> DataFrame:
    """One record a fixture of timed runs (fixture, raw_bytes, chars, doc_status, synthetic, repeat, seconds)."""
    facts = ("raw_bytes", "chars", "doc_status", "synthetic")
    rows = timed.groupBy("fixture").agg(
        *(F.max(c).alias(c) for c in facts), F.count(F.lit(1)).alias("repeats"), F.median("seconds").alias("median_s"), F.min("seconds").alias("min_s"),
        F.min(F.struct("repeat", "seconds"))["seconds"].alias("first_s"), F.avg("seconds").alias("mean_s"), F.max("seconds").alias("max_s"),
    )
    speed = F.round(F.try_divide(F.col("raw_bytes") / MIB, F.col("median_s")), 4)
    return rows.withColumn("refused", F.col("doc_status").isin(*REFUSED)).withColumn("mib_per_s", speed)


def bench_summary(records: DataFrame) -> DataFrame:
    """One row: extremes, throughput of processed fixtures, warm-up and spread of those that take long enough to tell."""
    done = ~F.col("refused")
    told = (F.col("median_s") >= RATIO_FLOOR) & (F.col("min_s") > 0)
    size = lambda c: F.struct(c, (-F.col("fixture")).alias("at"))
    rows = records.withColumns(
        {
            "speed": F.when(done, F.col("mib_per_s")),
            "warmup": F.when(told, F.col("first_s") / F.col("min_s")),
            "repeat_spread": F.when(told, (F.col("max_s") - F.col("min_s")) / F.col("median_s")),
            "every": F.lit(1),
        }
    )
    out = rows.groupBy("every").agg(
        F.count(F.lit(1)).alias("fixtures"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("chars").alias("chars"),
        F.max_by("fixture", size("median_s")).alias("slowest"), F.max_by("fixture", size("raw_bytes")).alias("largest"),
        F.round(F.sum("median_s"), 3).alias("sum_of_medians"), F.count_if(done).alias("processed"), F.count_if(~done).alias("refused"),
        F.min("speed").alias("speed_min"), F.max("speed").alias("speed_max"), F.round(F.try_divide(F.max("speed"), F.min("speed")), 2).alias("speed_spread"),
        F.count_if(told).alias("told"), F.count_if(~told).alias("untold"), F.round(F.max("warmup"), 4).alias("warmup_max"), F.round(F.max("repeat_spread"), 4).alias("repeat_spread_max"),
    )
    for c in ("speed", "warmup", "repeat_spread"):
        out = out.join(interpolated(rows, "every", c, {f"{c}_median": 0.5}, 4), "every", "left")
    return out.drop("every")


def populations(records: DataFrame, sized: DataFrame, batch_mib_per_s: float) -> DataFrame:
    """population, n, mean_bytes, mib_per_s, seconds_per_filing, n_1000_seconds, n_1000_gib: what other numbers of filings would take.

    All fixtures at the batch's speed; those that are no copies at their own; and these with others
    that are only sized (sized: raw_bytes), at the same speed.
    """
    real = records.where("not synthetic")
    own = real.agg(F.try_divide(F.sum("raw_bytes") / MIB, F.sum("median_s")).alias("own"))
    parts = [("all", records.select("raw_bytes")), ("real", real.select("raw_bytes")), ("real_and_sized", real.select("raw_bytes").union(sized.select("raw_bytes")))]
    rows = None
    for name, sizes in parts:
        one = sizes.agg(F.lit(name).alias("population"), F.count(F.lit(1)).alias("n"), F.avg("raw_bytes").alias("mean"))
        rows = one if rows is None else rows.union(one)
    # one row meets three: the speed of the real fixtures
    rows = rows.withColumn("one", F.lit(1)).join(own.withColumn("one", F.lit(1)), "one")
    speed = F.when(F.col("population") == "all", F.lit(batch_mib_per_s)).otherwise(F.coalesce("own", F.lit(batch_mib_per_s)))
    each = F.col("mean") / MIB / speed
    return rows.select(
        "population", "n", F.round("mean").alias("mean_bytes"), F.round(speed, 4).alias("mib_per_s"), F.round(each, 6).alias("seconds_per_filing"),
        F.round(each * 1000, 1).alias("n_1000_seconds"), F.round(F.col("mean") * 1000 / GIB, 4).alias("n_1000_gib"),
    )


def counterfactual_cost(records: DataFrame, models=MODELS) -> DataFrame:
    """what, model, chars, est_tokens, usd, fits: what a model would cost for the median, the largest and all filings."""
    rows = records.withColumn("every", F.lit(1))
    sums = rows.groupBy("every").agg(F.max_by("chars", F.struct("raw_bytes", "chars")).cast("double").alias("largest"), F.sum("chars").cast("double").alias("corpus"))
    sums = sums.join(interpolated(rows, "every", "chars", {"median": 0.5}), "every")
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("what"), F.col(n).alias("chars")) for n in ("median", "largest", "corpus")))).alias("x")).select("x.*")
    priced = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(p).alias("price"), F.lit(c).alias("context")) for m, p, c in models)))
    tokens = F.col("chars") / CHARS_PER_TOKEN
    return rows.withColumn("m", priced).select(
        "what", "m.model", F.floor("chars").cast("long").alias("chars"), F.bround(tokens).cast("long").alias("est_tokens"), F.round(tokens / 1e6 * F.col("m.price"), 9).alias("usd"), (tokens <= F.col("m.context")).alias("fits")
    )
