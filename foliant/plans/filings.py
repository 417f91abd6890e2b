"""Filings made from the rows of ``documents`` by string expressions that Spark and DuckDB share.

The whole text of a document is item 7 of its filing. ``doc_id % 23`` gives the shape: contents
pages, echoes, bare headings, missing headings, pointers, clips, oversized last items, other
forms, running heads, no period, headings out of order, page tags and numbers, headings without
and with inexact titles, contents that name what is missing, figures in the wrong item, headings
far from the margin, submissions without an annual report's block, HTML and inline XBRL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.functions.taxonomy import ADDED, ORDER, TITLES
from foliant.sources.staging import stage

NL = "chr(10)"
YEAR = "(1993 + doc_id % 33)"
_SHAPE = "(doc_id % 23)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inexact(code: str) -> str:
    """A title that is nearly the code's, half of it, or another's: strong, weak, and below the floor."""
    title = TITLES[code][1][0]
    return (title + "s etc", title[: max(4, len(title) // 2)] + " of late", "Xyzzy plugh")[ORDER.index(code) % 3]


def _due(code: str) -> str:
    """Whether a filing whose year ends on December 31 names the code."""
    added = ADDED.get(code)
    return "1 = 1" if added is None else f"{YEAR} >= {int(added[:4])}"


def _plain(code: str) -> str:
    return f"Matters of section {code} are described here for the year. They could change with the market and with the seasons."


def _body(code: str) -> str:
    plain = f"repeat({_q(_plain(code) + ' ')}, CASE WHEN {_SHAPE} = 2 THEN 5 ELSE 1 END)"
    if code == "7":
        return f"text || {NL} || {plain}"
    if code == "8":
        plain8 = f"repeat('Total net sales are told in words here for the whole of the year.' || {NL}, 100)"
        return f"CASE WHEN {_SHAPE} = 17 THEN {plain8} ELSE repeat('Total net sales were $1,234,567 or 12% of 9,876,543.' || {NL}, 1 + {_SHAPE} * 12) END"
    if code == "1A":
        figures = f"repeat('These risks could cost $12,345,678 or 90% of 1,234,567,890.' || {NL}, 120)"
        return f"CASE WHEN {_SHAPE} = 17 THEN {figures} ELSE repeat('These risks could adversely affect the company and its results.' || {NL}, 1 + {_SHAPE} * 9) END"
    if code == "3":
        return f"CASE WHEN {_SHAPE} = 8 THEN repeat('Nothing of this kind is known to the company at present. ', 100) ELSE {plain} END"
    if code in ("10", "11", "12"):
        one = "Information in response to this item is in the proxy statement. That information is incorporated into this report by reference."
        two = "The information required is incorporated herein by reference to the annual report to shareholders. See Item 7 of this report for more."
        long_ = "The proxy statement has it. It is incorporated by reference. " + "The company also states its policies here in its own words. " * 6
        return f"CASE {_SHAPE} WHEN 6 THEN {_q(one)} WHEN 7 THEN {_q(two)} WHEN 8 THEN {_q(long_)} ELSE {plain} END"
    return plain


def _item(code: str, title: str) -> str:
    bare = f"CASE WHEN {_SHAPE} = 3 THEN {_q(f'Item {code}.')} || {NL} || {NL} || {_q(title)}"
    untitled = f"WHEN {_SHAPE} = 14 AND {_q(code)} IN ('3', '9') THEN {_q(f'Item {code}.')} || {NL} || 'qqq zzz'"
    like = f"WHEN {_SHAPE} = 15 THEN {_q(f'Item {code}. {inexact(code)}')}"
    far = f"WHEN {_SHAPE} = 18 AND {_q(code)} = '3' THEN repeat(' ', 70) || {_q(f'Item {code}. {title}')}"
    head = f"{bare} {untitled} {like} {far} ELSE {_q(f'Item {code}. {title}')} END"
    absent = f"({_SHAPE} IN (5, 16) AND {ORDER.index(code)} > 0 AND {ORDER.index(code)} % 3 = CASE {_SHAPE} WHEN 16 THEN 1 ELSE doc_id % 3 END)"
    tag = f"CASE {_SHAPE} WHEN 10 THEN 'ACME CORPORATION ANNUAL REPORT' || {NL} WHEN 13 THEN '<PAGE>' || {NL} ELSE '' END"
    furniture = f"CASE WHEN {_SHAPE} IN (10, 13) THEN {tag} || '{ORDER.index(code) + 1}' || {NL} ELSE '' END"
    again = f"CASE WHEN {_SHAPE} = 12 AND {_q(code)} IN ('2', '9') THEN {_q(f'Item 1. {TITLES['1'][1][0]}')} || {NL} || 'Repeated matter.' || {NL} ELSE '' END"
    body = f"CASE WHEN {_SHAPE} = 4 AND {_q(code)} <> '7' THEN 'None.' ELSE {_body(code)} END"
    if code == "4":
        # officers named before the last item: the rest up to the next heading is nobody's, a little or most of the filing
        gap = f"{NL} || 'Executive Officers of the Registrant' || {NL} || repeat('Names, ages and offices follow in full. ' || {NL}, CASE WHEN doc_id % 4 = 1 THEN 60 ELSE 60 + CAST(floor(length(text) / 20) AS INTEGER) END)"
        body = f"{body} || CASE WHEN {_SHAPE} = 0 AND doc_id % 2 = 1 THEN {gap} ELSE '' END"
    return f"CASE WHEN ({_due(code)}) AND NOT {absent} THEN {furniture} || {head} || {NL} || {body} || {NL} || {again} ELSE '' END"


def _listing() -> str:
    rows = [f"CASE WHEN {_due(c)} THEN {_q(f'Item {c}. {TITLES[c][1][0]}')} || {NL} ELSE '' END" for c in ORDER]
    return "(" + " || ".join(rows) + ")"


def filing_expr() -> str:
    """A filing's plain text, from doc_id and text."""
    form = f"CASE WHEN {_SHAPE} = 9 AND doc_id % 2 = 0 THEN 'FORM 10-Q' ELSE 'FORM 10-K' END"
    period = f"CASE WHEN {_SHAPE} IN (11, 21) THEN '' ELSE 'For the fiscal year ended December 31, ' || CAST({YEAR} AS VARCHAR(4)) END"
    cover = f"{form} || {NL} || 'ANNUAL REPORT' || {NL} || {period} || {NL}"
    contents = f"CASE WHEN {_SHAPE} IN (1, 2, 4, 16) THEN {_listing()} || repeat('The pages that follow hold the report. ', 12) || {NL} ELSE '' END"
    bodies = " || ".join(_item(c, TITLES[c][1][0]) for c in ORDER)
    officers = f"CASE WHEN {_SHAPE} = 7 THEN 'Executive Officers of the Registrant' || {NL} || 'Names and ages follow.' || {NL} ELSE '' END"
    large = f"CASE WHEN {_SHAPE} = 8 THEN repeat('Annex matter goes on without a heading of its own. ' || {NL}, 900) ELSE '' END"
    tail = f"'SIGNATURES' || {NL} || 'Signed on behalf of the registrant.'"
    echo = f"CASE WHEN {_SHAPE} = 2 THEN {NL} || {_listing()} ELSE '' END"
    short = f"'FORM 10-K' || {NL} || 'Cut short.'"
    whole = f"({cover} || {contents} || {bodies} || {officers} || {large} || {tail} || {echo})"
    return f"CASE WHEN {_SHAPE} = 9 AND doc_id % 2 = 1 THEN {short} ELSE {whole} END"


def markup_expr() -> str:
    """The filing as it stands in a file: plain text, or HTML (shape 20) or inline XBRL (21), a paragraph a line."""
    lines = f"replace(replace(replace(replace(filing, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), {NL}, '</p>' || {NL} || '<p>')"
    body = f"'<p>' || {lines} || '</p><script>var x = \"<p>\";</script></body></html>'"
    fact = f"'<ix:header><ix:hidden>not shown</ix:hidden></ix:header><p><ix:nonNumeric name=\"dei:DocumentPeriodEndDate\">December&#160;31, ' || CAST({YEAR} AS VARCHAR(4)) || '</ix:nonNumeric></p>' || {NL}"
    head = "'<html><head><title>Annual report</title></head><body>'"
    return f"CASE {_SHAPE} WHEN 20 THEN {head} || {body} WHEN 21 THEN {head} || {fact} || {body} ELSE filing END"


def submission_expr() -> str:
    """Every fourth filing within submission blocks, the others as they are; shapes 19 and 22 in blocks that are no annual report's."""
    head = f"'CONFORMED PERIOD OF REPORT: ' || CAST({YEAR} AS VARCHAR(4)) || '1231' || {NL}"
    block = f"'<DOCUMENT>' || {NL} || '<TYPE>10-K' || {NL} || '<SEQUENCE>1' || {NL} || '<FILENAME>main.txt' || {NL} || '<TEXT>' || {NL}"
    other = f"'<DOCUMENT>' || {NL} || '<TYPE>EX-13' || {NL} || '<SEQUENCE>2' || {NL} || '<TEXT>' || {NL} || 'An exhibit.' || {NL} || '</TEXT>' || {NL} || '</DOCUMENT>'"
    end = f"{NL} || '</TEXT>' || {NL} || '</DOCUMENT>' || {NL} || {other}"
    wrapped = f"({head} || {block} || filing || {end})"
    kind = f"CASE WHEN {_SHAPE} = 22 THEN '<TYPE>EX-99' || {NL} ELSE '' END"
    lost = f"('<DOCUMENT>' || {NL} || {kind} || '<SEQUENCE>1' || {NL} || '<TEXT>' || {NL} || filing || {end})"
    return f"CASE WHEN {_SHAPE} IN (19, 22) THEN {lost} WHEN doc_id % 4 = 0 THEN {wrapped} ELSE filing END"


_made: dict[tuple[str, str], DataFrame] = {}


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, raw_text for every document, made once a session and table: they stand for files that are there before a query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
        docs = docs.repartition(spark.sparkContext.defaultParallelism)  # the test tables are single files
        _made[key] = stage(docs.selectExpr("doc_id", f"{filing_expr()} AS filing").selectExpr("doc_id", f"{markup_expr()} AS filing").selectExpr("doc_id", f"{submission_expr()} AS raw_text"), "filings")
    return _made[key]


def filings_sql() -> str:
    """The same rows as a DuckDB subquery."""
    inner = f"SELECT doc_id, {filing_expr()} AS filing FROM documents"
    marked = f"SELECT doc_id, {markup_expr()} AS filing FROM ({inner})"
    return f"SELECT doc_id, {submission_expr()} AS raw_text FROM ({marked})"
