"""Every check type on envelopes written by hand, passing and failing; cases, reports and histories."""

import json

import pytest
from pyspark.sql import Row

from foliant.operators import checks
from foliant.sources import submissions

ITEM = "struct<item:string,part:string,title:string,heading_text:string,start:int,end:int,status:string,method:string,confidence:double,evidence:struct<title_similarity:double>>"
META = "struct<extractor_version:string,input_sha256:string,form_type:string,format_era:string,document_selected:string,taxonomy_era:string,toc_manifest:array<string>>"
SCHEMA = (
    f"doc_id long, normalized_text string, doc_status string, warnings array<struct<code:string,item:string,message:string>>, meta {META}, trace array<string>, "
    f"cost struct<llm_calls:int,tokens:int,usd:double>, items array<{ITEM}>, boilerplate array<struct<start:int,end:int,kind:string>>"
)
TEXT = "Item 1. Business\nACME\nWe sell tools.\n" + "tools " * 200 + "\nItem 2. Properties\nSee the proxy statement.\n"
CUT = TEXT.index("Item 2")
HEAD = TEXT.index("ACME")


def item(code, start, end, status="extracted", confidence=0.95, heading=None, method="heading_strict"):
    return (code, "I", "Business" if code == "1" else "Properties", heading, start, end, status, method, confidence, (1.0,))


def envelope(doc_id, text=TEXT, status="success", warnings=(), items=None, runs=((HEAD, HEAD + 5, "running_head"),), era="modern"):
    if items is None:
        items = [item("1", 0, CUT, heading="Item 1. Business"), item("2", CUT, len(TEXT), "incorporated_by_reference", 0.85, "Item 2. Properties"), item("16", None, None, "omitted", 0.8, method="status_keyword")]
    meta = ("1", "sha", "10-K", "txt", "whole file", era, [] if era else None)
    return (doc_id, text, status, list(warnings), meta, ["t"], (0, 0, 0.0), items, None if runs is None else list(runs))


GOOD = 1
ODD = {
    2: envelope(2, warnings=[("boundary_hygiene", "1", "m")]),  # a success with warnings
    3: envelope(3, status="failed", era=None, runs=None),  # a refusal with items
    4: envelope(4, items=[item("1", 0, CUT + 5, heading="Item 1. Business"), item("2", CUT, len(TEXT), heading="Item 9")]),  # overlap, wrong heading
    5: envelope(5, items=[item("99", 0, 50, heading="Item 1. Business", method="guess")], status="success_with_warning", warnings=[("w", None, "m")], runs=((HEAD + 1, HEAD + 3, "running_head"), (HEAD, HEAD + 5, "page_number"))),
    6: envelope(6, runs=()),
}
CASES = [
    (dict(type="item_present", item="1"), GOOD, True), (dict(type="item_present", item="2"), GOOD, False), (dict(type="item_present", item="2", value="incorporated_by_reference"), GOOD, True),
    (dict(type="item_absent", item="9"), GOOD, True), (dict(type="item_absent", item="1"), GOOD, False), (dict(type="item_absent", item="2"), GOOD, True), (dict(type="item_absent", item="2", flag=True), GOOD, False),
    (dict(type="text_contains", item="1", value="sell tools"), GOOD, True), (dict(type="text_contains", item="16", value="x"), GOOD, False), (dict(type="text_contains", item="2", value="sell"), GOOD, False),
    (dict(type="text_not_contains", item="16", value="x"), GOOD, True), (dict(type="text_not_contains", item="1", value="sell"), GOOD, False),
    (dict(type="min_chars", item="1", low=1000.0), GOOD, True), (dict(type="min_chars", item="2", low=1000.0), GOOD, False), (dict(type="min_chars", item="16", low=0.0), GOOD, False), (dict(type="min_chars", item="9", low=0.0), GOOD, True),
    (dict(type="max_chars", item="2", high=100.0), GOOD, True), (dict(type="max_chars", item="1", high=100.0), GOOD, False), (dict(type="max_chars", item="9", high=100.0), GOOD, False),
    (dict(type="norm_contains", value="proxy"), GOOD, True), (dict(type="norm_contains", value="nothing"), GOOD, False), (dict(type="norm_not_contains", value="nothing"), GOOD, True), (dict(type="norm_not_contains", value="proxy"), GOOD, False),
    (dict(type="warning_present", value="boundary_hygiene"), 2, True), (dict(type="warning_present", value="boundary_hygiene", item="2"), 2, False), (dict(type="warning_absent", value="boundary_hygiene"), GOOD, True), (dict(type="warning_absent", value="boundary_hygiene", item="1"), 2, False),
    (dict(type="item_field", item="1", field="title", value="Business"), GOOD, True), (dict(type="item_field", item="1", field="title", value="X"), GOOD, False), (dict(type="item_field", item="16", field="start"), GOOD, True), (dict(type="item_field", item="9", field="title"), GOOD, False),
    (dict(type="confidence", low=0.8), GOOD, True), (dict(type="confidence", low=0.9), GOOD, False), (dict(type="confidence", item="1", value="0.95"), GOOD, True), (dict(type="confidence", item="1", high=0.9), GOOD, False), (dict(type="confidence", item="9", low=0.1), GOOD, False),
    (dict(type="envelope_shape"), GOOD, True), (dict(type="envelope_shape"), 2, False), (dict(type="envelope_shape"), 3, False), (dict(type="envelope_shape"), 5, False), (dict(type="envelope_shape"), 6, True),
    (dict(type="known_items_only"), GOOD, True), (dict(type="known_items_only"), 5, False),
    (dict(type="only_items", names=["1", "2", "16"]), GOOD, True), (dict(type="only_items", names=["1"]), GOOD, False),
    (dict(type="expected_set_complete", names=["1", "16"]), GOOD, True), (dict(type="expected_set_complete", names=["1", "9"]), GOOD, False),
    (dict(type="no_overlap_ordered"), GOOD, True), (dict(type="no_overlap_ordered"), 4, False), (dict(type="verbatim"), GOOD, True), (dict(type="verbatim"), 4, False),
    (dict(type="doc_status", value="success"), GOOD, True), (dict(type="doc_status", names=["failed"]), GOOD, False), (dict(type="doc_status", names=["failed", "unsupported"]), 3, True),
    (dict(type="no_empty_success"), GOOD, True), (dict(type="no_empty_success"), 5, False), (dict(type="no_empty_success"), 3, True),
    (dict(type="boilerplate", flag=True), GOOD, True), (dict(type="boilerplate", flag=True), 3, False), (dict(type="boilerplate", flag=False), 3, True), (dict(type="boilerplate", value="ACME"), GOOD, True), (dict(type="boilerplate", value="ACME", high=0.0), GOOD, False),
    (dict(type="boilerplate", field="page_number"), GOOD, False), (dict(type="boilerplate", high=0.0), 6, True), (dict(type="boilerplate"), 3, False),
    (dict(type="boilerplate_spans_sane"), GOOD, True), (dict(type="boilerplate_spans_sane"), 5, False), (dict(type="boilerplate_spans_sane"), 3, False), (dict(type="boilerplate_spans_sane"), 6, True),
    (dict(type="boilerplate_stripped", names=["ACME"]), GOOD, True), (dict(type="boilerplate_stripped", names=["sell"]), GOOD, False), (dict(type="boilerplate_stripped", low=9.0), GOOD, False), (dict(type="boilerplate_stripped"), 5, False),
    (dict(type="deterministic"), GOOD, True), (dict(type="deterministic"), 2, False), (dict(type="offsets_invariant_under_exclusion"), GOOD, True), (dict(type="offsets_invariant_under_exclusion"), 4, False),
    (dict(type="no_such_type"), GOOD, None), (dict(type="item_present", item="1"), 77, None),
]


def declare(spark, cases):
    names = [x.split()[0] for x in checks.CHECK.split(", ")]
    rows = [(doc, *({"check_id": f"{i:03}", **c}.get(n) for n in names)) for i, (c, doc, _) in enumerate(cases)]
    return spark.createDataFrame(rows, f"doc_id long, {checks.CHECK}")


def test_every_check(spark):
    assert {c["type"] for c, _, _ in CASES} - {"no_such_type"} == set(checks.TYPES)
    rows = spark.createDataFrame([envelope(GOOD), *ODD.values()], SCHEMA)
    again = spark.createDataFrame([envelope(GOOD), envelope(2, warnings=[]), *(ODD[i] for i in (3, 4, 5, 6))], SCHEMA)
    off = spark.createDataFrame([envelope(GOOD, runs=None), envelope(4, runs=None)], SCHEMA)
    got = {r.check_id: r.passed for r in checks.evaluate_checks(declare(spark, CASES), rows, again, off).collect()}
    wrong = [(c, doc, want, got[f"{i:03}"]) for i, (c, doc, want) in enumerate(CASES) if got[f"{i:03}"] is not want]
    assert not wrong and len(got) == len(CASES), wrong


def test_cases_run(spark):
    rows = spark.createDataFrame([envelope(GOOD), ODD[2]], SCHEMA).drop("boilerplate")
    cases = [(dict(type="item_present", item="1"), 1, None), (dict(type="verbatim"), 1, None), (dict(type="item_present", item="1"), 2, None), (dict(type="envelope_shape"), 2, None), (dict(type="odd"), 2, None)]
    got = {r.doc_id: r for r in checks.run_cases(checks.evaluate_checks(declare(spark, cases), rows, reasons=True)).collect()}
    assert (got[1].passed, got[1].n_checks, got[1].n_failed, got[1].n_errors) == (True, 2, 0, 0)
    assert (got[2].passed, got[2].n_checks, got[2].n_failed, got[2].n_errors, [tuple(f) for f in got[2].failures]) == (False, 3, 1, 1, [("envelope_shape", "envelope_shape does not hold"), ("odd", "no check is named odd")])


def test_cases_and_reports_on_disk(spark, tmp_path):
    made = {"a": {"id": "a", "task": "t", "suites": ["fast"]}, "b": {"id": "b", "task": "t"}, "c": {"id": "c", "task": "t", "suites": ["slow", "debt"]}, "d": {"id": "d", "task": "t", "suites": ["slow"]}}
    (tmp_path / "cases" / "below").mkdir(parents=True)
    for name, case in made.items():
        (tmp_path / "cases" / f"{name}.json").write_text(json.dumps(case, indent=1))
    (tmp_path / "cases" / "notes.md").write_text("no case")
    (tmp_path / "cases" / "below" / "e.json").write_text(json.dumps({"id": "e"}))
    ids = lambda suite: {r.id for r in submissions.read_cases(spark, str(tmp_path / "cases"), suite).collect()}
    assert ids(None) == ids("all") == {"a", "b", "c", "d"} and ids("fast") == {"a", "b", "c"} and ids("slow") == {"c", "d"}
    run = spark.createDataFrame([Row(ts="1", score=0.5)])
    for _ in range(2):
        submissions.append_history(run, str(tmp_path / "history"))
    assert spark.read.json(str(tmp_path / "history")).count() == 2
    asked = dict(plain=("fast", False, None, False), red=("fast", True, None, False), all=("all", False, None, False), no=("all", True, False, False), folder=("fast", False, False, True), yes=("fast", False, True, False))
    wrote = {k: submissions.write_report(run, str(tmp_path / k), *v) for k, v in asked.items()}
    assert wrote == {"plain": False, "red": True, "all": True, "no": False, "folder": True, "yes": True} and not (tmp_path / "no").exists()


@pytest.mark.parametrize("length, name, why", [(5, "x.HTM", None), (0, "x.htm", "bad_input"), (5, "x.pdf", "bad_input"), ((25 << 20) + 1, "x.txt", "too_large")])
def test_uploads(spark, length, name, why):
    from pyspark.sql import functions as F

    assert spark.range(1).select(submissions.refuse_upload(F.lit(name), F.lit(length)).alias("w")).first().w == why


def test_artifacts(spark, tmp_path):
    from pyspark.sql import functions as F

    submissions.write_artifact(spark.createDataFrame([Row(fixture="a", median_s=0.5)]), str(tmp_path / "bench"), "bench", F.lit("0123456789abcdef"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "bench")).select("kind", "git_sha", "fixture", "median_s").collect()] == [("bench", "0123456789ab", "a", 0.5)]


def test_two_tools(spark):
    import difflib

    from foliant.operators import measure

    ours = [(1, "1", "extracted", "We sell  tools\u00a0here. " * 9), (1, "2", "missing", None), (1, "3", "extracted", "only ours"), (1, "16", "omitted", None)]
    theirs = [(1, "1", 0.9, "We sold tools here. " * 9), (1, "1", 0.4, "worse"), (1, "2", None, "theirs"), (1, None, 0.9, "no code"), (1, "77", 0.9, "unknown")]
    best = measure.best_sections(spark.createDataFrame(theirs, "doc_id long, item string, confidence double, text string"))
    rows = measure.compare_tools(spark.createDataFrame(ours, "doc_id long, item string, status string, text string"), best)
    got = {r.item: (r["class"], r.direction) for r in rows.collect()}
    assert got == {"1": ("content", None), "2": ("presence", "only_theirs"), "3": ("presence", "only_ours"), "16": ("agree_absent", None)}
    alike = measure.content_similarity(rows)
    a, b = ("We sell tools here. " * 9).strip(), ("We sold tools here. " * 9).strip()
    assert [r.similarity for r in alike.collect()] == [round(difflib.SequenceMatcher(None, a, b).ratio(), 4)]
    full = rows.join(alike.select("doc_id", "item", "similarity"), ["doc_id", "item"], "left")
    assert [r.item for r in measure.ranked_disagreements(full, "similarity", 1.0).orderBy("doc_id", measure.F.col("class").desc(), "rank").collect()] == ["2", "3", "1"]


def test_declared_as_a_column_and_many_runs(spark):
    """Checks as a column judge as those in rows do; a text with thousands of runs is cut once, not once a run."""
    import time

    from pyspark.sql import functions as F

    n = 20_000
    long = "Item 1. Business\n" + "words go on é\nACME\n" * n
    first, step = len("Item 1. Business\nwords go on é\n"), len("words go on é\nACME\n")
    runs = tuple((first + i * step, first + i * step + 5, "running_head") for i in range(n))
    odd = ((first - 1, first + 4, "running_head"), *runs[1:])
    items = [item("1", 0, len(long), heading="Item 1. Business")]
    rows = spark.createDataFrame([envelope(1, long, items=items, runs=runs), envelope(2, long, items=items, runs=odd)], SCHEMA)
    cases = [dict(type="boilerplate", value="ACME", low=float(n)), dict(type="boilerplate_spans_sane"), dict(type="boilerplate_stripped", names=["ACME"]), dict(type="verbatim"), dict(type="text_contains", item="1", value="ACME")]
    declared = declare(spark, [(c, doc, None) for c in cases for doc in (1, 2)])
    struct = [x.split() for x in checks.CHECK.split(", ")]
    lit = lambda v, kind: (F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(kind)
    column = F.array(*(F.struct(*(lit({"check_id": c["type"], **c}.get(n), kind).alias(n) for n, kind in struct)) for c in cases))
    began = time.time()
    got = {(r.doc_id, r.type): r.passed for r in checks.evaluate_checks(column, rows).collect()}
    assert time.time() - began < 60
    assert got == {(r.doc_id, r.type): r.passed for r in checks.evaluate_checks(declared, rows).collect()}
    assert [got[1, c["type"]] for c in cases] == [True, True, True, True, True]
    assert [got[2, c["type"]] for c in cases] == [True, False, True, True, True]  # the newline before a run is white space
