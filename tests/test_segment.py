"""Operators on small filings, worked out by hand, and invariants over the made filings."""

import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from foliant.functions import python as P
from foliant.functions import taxonomy
from foliant.functions import text as T
from foliant.operators import anchors, furniture, measure, segment
from foliant.plans import segmentation
from foliant.plans.filings import filings
from foliant.sources import submissions

SF = "/root/testdata/sf0.001"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "s string").select(column(F.col("s")).alias("x")).first()["x"]


def test_lines_cover_the_text(spark):
    text = "a\n\n  bé\nlast"
    rows = segment.lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line_no").collect()
    assert [(r.start, r.end, r.stripped) for r in rows] == [(0, 2, "a"), (2, 3, ""), (3, 8, "bé"), (8, 12, "last")]
    assert "".join(text[r.start : r.end] for r in rows) == text


def test_expected_sets(spark):
    days = [("2025-09-27", 23), ("2021-12-31", 22), ("2016-12-31", 21), ("1997-12-31", 15), ("1993-12-31", 14), (None, 14)]
    df = spark.createDataFrame([(d,) for d, _ in days], "d string").select(F.size(taxonomy.expected_codes(F.to_date("d"))).alias("n"))
    assert [r.n for r in df.collect()] == [n for _, n in days]


def test_dates_and_forms(spark):
    assert str(one(spark, "Ended 31, 2016 then DECEMBER 31,2016", T.parse_date)) == "2016-12-31"
    assert str(one(spark, "February 30, 2010 and March 1 , 2010", T.parse_date)) == "2010-03-01"
    assert one(spark, "no date", T.parse_date) is None
    assert one(spark, "FORM 10-K\n(Amendment No. 1)", T.sniff_form) == "10-K/A"
    assert one(spark, "x Form 10-Q x", T.sniff_form) == "10-Q"
    assert one(spark, "none", T.sniff_form) is None


def test_sentences(spark):
    got = one(spark, "See Item 1. Election of Directors. Proposal No. 2 is here; so. End", T.sentences)
    assert got == ["See Item 1. Election of Directors.", "Proposal No. 2 is here; so.", "End"]


def test_tidy(spark):
    assert one(spark, "  a  b \n\n\n\n c ", T.tidy) == "a b\n\nc"


def test_html_reading():
    page = "<html><title>t</title><body><p>A &amp; b<br/>c</p><td>1</td><td>2</td><script>x</script><b>d</b>e"
    assert P.read_html(page) == "\n\nA & b\n\nc\n 1 2de"
    assert P.chunks_of("<head><p>no</p></head><body>a<i>b</i><style>s</style></body>") == ["a", "b"]
    assert P.read_html("<title>t</title>a<ix:header>x<ix:hidden>y</ix:hidden>z</ix:header>b<div/>c") == "ab\n\nc"


class Plain(HTMLParser):
    """What the two readers must give, from the standard library's events."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.text, self.chunks, self.depth, self.deep, self.skip = [], [], 0, None, 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in P.UNREAD:
            self.depth += 1
        elif not self.depth:
            self.text.append("\n" if tag in P.LINE_BREAKS else " " if tag in P.CELLS else "")
        self.skip += tag in ("script", "style")
        self.deep = 1 if tag == "body" else self.deep + 1 if self.deep else self.deep

    def handle_endtag(self, tag):
        if tag in P.UNREAD:
            self.depth = max(0, self.depth - 1)
        elif not self.depth:
            self.text.append("\n" if tag in P.LINE_BREAKS else "")
        self.skip -= tag in ("script", "style")
        self.deep = self.deep - 1 if self.deep else self.deep

    def handle_data(self, data):
        if not self.depth:
            self.text.append(re.sub(r"\s+", " ", data))
        if self.deep and not self.skip and data:
            self.chunks.append(data)


def test_html_reading_by_the_standard_library():
    r = random.Random(4)
    word = lambda: r.choice(["a", "b&amp;c", "d &lt; e", " ", "\n", "é&#233;&nbsp;", "x"])

    def element(depth):
        tag = r.choice(["p", "div", "span", "b", "td", "ix:hidden", "style", "script", "h1", "tr"])
        if tag in ("style", "script"):
            return f"<{tag}>var x = '<p>';</{tag}>"
        attrs = r.choice(["", ' class="x > y"', " id=z", " data-a='q'"])
        inner = "".join(element(depth + 1) if r.random() < 0.4 and depth < 4 else word() for _ in range(r.randint(0, 4)))
        return f"<{tag}{attrs}>{inner}</{tag}>" + r.choice(["", "<!-- <p> -->"])

    for _ in range(400):
        page = "<html><head><title>t</title></head><body>" + "".join(element(0) for _ in range(3)) + "</body>after</html>"
        want = Plain(page)
        assert P.read_html(page) == "".join(want.text), page
        assert not want.chunks or "".join(P.chunks_of(page)) == "".join(want.chunks), page
    assert P.chunks_of("plain text") == ["plain text"] and P.chunks_of("") == [] and P.chunks_of("<div><p>a</p> <p>b</p></div>") == ["a", " ", "b"]


ODD = [
    "<", ">", "/", "=", "'", '"', " ", "\n", "&", ";", "!", "-", "--", "?", "[", "]", "]]>", "]>", "a", "b", "é", "x1", ":", "\x00", "\x0b", "\u00a0", "&amp;", "&nbsp;", "&lt;", "&amp;lt;", "&#160;", "&#65;", "&#x41", "&lt", "&ampx",
    "<p", "<p>", "</p>", "</ p >", "</p x>", "</>", "</1>", "<br/>", "<br / >", "<td>", "<div title=don't>", '<p class="x"">', "<a b='", '<a b="', "<a b= ", "<a b==", "<script>", "<script x=\"", "</script>", "</SCRIPT >",
    "<script/>", "<style>", "</style>", "<!--", "-->", "-- >", "<!-->", "<!doctype html>", "<!", "<!x>", "<![CDATA[", "<![if x]>", "<?pi", "<?pi?>", "<body>", "</body>", "<body a=1>", "<title>", "</title>", "<ix:hidden>", "</ix:hidden>", "<a\x00b>", "<a/b/c='d'/>", "<a =b>", '<a"b c>',
]


class Chunks(HTMLParser):
    """Text below body, read to where the standard library waits for more of the page."""

    def __init__(self, page, inside):
        super().__init__(convert_charrefs=True)
        self.chunks, self.inside, self.deep, self.skip = [], inside, 0, 0
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.inside, self.deep = True, 1
            return
        self.deep += self.inside
        self.skip += tag in ("script", "style")

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if self.inside:
            self.deep -= 1
            self.inside = self.deep > 0

    def handle_data(self, data):
        if self.inside and not self.skip and data:
            self.chunks.append(data)


def test_odd_markup_as_the_standard_library_reads_it():
    r, read = random.Random(12), 0
    for i in range(14000):
        page = "".join(r.choices(ODD, k=r.randint(1, 14)))
        page = f"<body>{page}" if i % 3 == 0 else page
        try:
            want, chunks = Plain(page), Chunks(page, False).chunks or Chunks(page, True).chunks
        except AssertionError:  # a section of unknown name, which the standard library refuses
            P.read_html(page), P.chunks_of(page)
            continue
        read += 1
        assert P.read_html(page) == "".join(want.text), page
        assert P.chunks_of(page) == (chunks if re.search("<[a-zA-Z!/]", page) else [page]), page
    assert read > 10000


def test_stray_quotes_lose_no_text():
    assert P.read_html("<p title=don't>Hello world</p><p>It's fine</p><p>tail</p>") == "\nHello world\n\nIt's fine\n\ntail\n"
    assert P.read_html('<p class="x"">Hello</p>') == "\nHello\n"
    assert P.read_html("a<![odd[b]]>c") == "ac" and P.read_html("&#" + "9" * 5000 + ";&#" + "0" * 5000 + "65;x") == "\ufffdAx"


@pytest.mark.parametrize(
    "piece",
    ["<", "<a ", '<script x="', "<script ", '<p "', "<p '\"", '<a x="><b "y="><b ', "<a x='>\"<b", "<!--", "<!-- -", "<![CDATA[", "<![if", "</", "</a", "<?", "<!", "<a/x=<a", "<a\x00", "<a x==", "<a x= \"", "&", "&#", "--", "<a<", "<a<\x00", '<a ="', "a='<b \"<c =", "</ ", "<script>", "<style></ "],
)
@pytest.mark.parametrize("end", ["", ">", '"', "'>", '">', "\x00"])
def test_odd_markup_takes_linear_time(piece, end):
    page = "<body>" + piece * (1_000_000 // len(piece)) + end
    began = time.process_time()
    P.read_html(page)
    P.chunks_of(page)
    assert time.process_time() - began < 5, (piece, end)


def test_lines_and_places_of_odd_texts(spark):
    texts = ["", "\n", "a", "\n\nx\n", "é\nü\n", "a\nb"]
    rows = segment.lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.line_no, r.raw, r.start, r.end) for r in rows if r.doc_id == i)
        assert [x[1] for x in mine] == t.split("\n") and "".join(t[a:b] for _, _, a, b in mine) == t
    got = spark.createDataFrame([("aaa", "aa"), ("abc", "x"), ("abc", ""), (None, "a")], "t string, n string").select(P.places_of("t", "n").alias("p")).collect()
    assert [r.p for r in got] == [[0, 1], [], [], []]


def test_period_of_an_inline_fact(spark):
    fact = 'name="dei:DocumentPeriodEndDate" x="y">&#68;ecember&#160;31&#x2C;&ensp;20<b>19</b> </ix>'
    raw = spark.createDataFrame([(1, fact.replace("20<b>19</b>", "2019"))], "id int, raw string")
    got = raw.select(T.period_end(*T.raw_dates(F.col("raw")), F.lit("")).alias("d")).first().d
    assert str(got) == "2019-12-31"


def test_decode_falls_back(spark):
    rows = spark.createDataFrame([(1, bytearray("é".encode())), (2, bytearray(b"\x93q\x81"))], "doc_id int, content binary")
    got = {r.doc_id: r.raw_text for r in submissions.decode(rows).collect()}
    assert got == {1: "é", 2: "“q�"}


def test_blocks(spark):
    raw = "head\n<DOCUMENT>\n<TYPE>ex-1\n<TEXT>\none</TEXT></DOCUMENT>\n<DOCUMENT>\n<TYPE>10-K\n<SEQUENCE>2\nno end"
    got = submissions.with_blocks(spark.createDataFrame([(1, raw)], "doc_id int, raw_text string")).first()["blocks"]
    assert [(b.type, b.sequence, b.start) for b in got] == [("EX-1", "", 5), ("10-K", "2", raw.rindex("<DOCUMENT>"))]
    assert got[0].body == "\none" and got[1].body.endswith("no end")


def test_greedy_moves_the_cursor(spark):
    rows = [(1, "1", 10, 20), (1, "2", 5, 15), (1, "2", 40, 50), (1, "3", 30, 39), (1, "3", 60, 70)]
    surv = spark.createDataFrame([(d, i, s, e, "h", 1.0) for d, i, s, e in rows], "doc_id long, item string, start int, heading_end int, heading_text string, similarity double")
    periods = spark.createDataFrame([(1, None)], "doc_id long, period_end date")
    got = {r.item: r.start for r in segment.assign(surv, periods).collect()}
    assert got == {"1": 10, "2": 40, "3": 60}


def test_pointer_status(spark):
    pointer = "The information is in the proxy statement. It is incorporated by reference."
    bodies = [(1, pointer), (2, pointer + " " + "Own words follow. " * 30), (3, "Own words. " + pointer), (4, "Plain.")]
    rows = segment.pointer_status(spark.createDataFrame(bodies, "id int, body string"))
    got = {r.id: r.found for r in rows.collect()}
    assert got == {1: "incorporated_by_reference", 2: "extracted", 3: "extracted", 4: "extracted"}


def test_page_numbers_follow_heads(spark):
    body = "x" * 60
    text = "\n".join(f"{body} {i}\nHEAD\n{i}\n\n7" for i in range(1, 13))
    rows = segment.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    marked = furniture.mark(rows).join(rows.select("line_no", "stripped"), "line_no")
    kinds = {}
    for r in marked.collect():
        kinds.setdefault(r.kind, []).append(r.stripped)
    assert len(kinds["running_head"]) == 12 + 13  # "7" repeats as regularly as the head
    assert sorted(map(int, kinds["page_number"])) == [i for i in range(1, 13) if i != 7]


def test_strip(spark):
    rows = spark.createDataFrame([("0123456789", [(1, 3), (2, 4), (8, 12)])], "t string, s array<struct<start:int,end:int>>")
    got = rows.select(furniture.strip(F.col("t"), F.col("s"), F.lit(0), F.lit(10)).alias("x"), furniture.strip(F.col("t"), F.col("s"), F.lit(2), F.lit(9)).alias("y")).first()
    assert got.x == "04567" and got.y == "4567"


def test_anchor_by_agreement(spark):
    texts = spark.createDataFrame([(1, "item1.business2item1.businessweselltoolsandparts")], "doc_id long, core_text string")
    items = spark.createDataFrame([(1, "1", "Item 1. Business", "Item 1. Business\nWe sell tools and parts"), (1, "2", "Item 9", "x")], "doc_id long, item string, heading_text string, item_text string")
    got = {r.item: (r.hits, r.anchor) for r in anchors.find_anchors(items, texts).collect()}
    assert got == {"1": (2, 15), "2": (0, None)}


def test_statistics(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 3, 4, 10])], "k string, i int, v double")
    assert measure.floor_index(df, "k", "v", {"p50": 0.5, "p95": 0.95}).first()[1:] == (3.0, 10.0)
    assert measure.widest_cut(df, "k", "v").first()["cut"] == 7.0
    assert df.limit(2).agg(measure.r_squared("v", "i").alias("r")).first()["r"] is None
    assert measure.plateau(df, "k", "i", "v", 6.5).first()["from"] == 3
    black, white = (measure.luminance(*(F.lit(v),) * 3) for v in (0, 255))
    assert df.limit(1).select(F.round(measure.contrast(black, white), 3).alias("c")).first()["c"] == 21.0


def test_invariants(spark):
    raw = filings(spark, SF)
    s = segmentation.segment_documents(raw)
    status = {r.doc_id: r.doc_status for r in s.status.collect()}
    texts = {r.doc_id: r.text for r in s.docs.collect()}
    assert set(status) == set(texts) and {"success", "ambiguous", "failed", "unsupported"} <= set(status.values())
    by_doc = {}
    for r in s.scored.orderBy("doc_id", "ord").collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, items in by_doc.items():
        assert status[doc] not in ("failed", "unsupported")
        at = 0
        for r in items:
            if r.start is None:
                assert r.status in ("missing", "omitted")
                continue
            assert at <= r.start < r.end <= len(texts[doc])
            at = r.end
            assert texts[doc][r.start : r.end].lstrip().startswith(r.heading_text)
            assert r.confidence <= (0.75 if status[doc] == "ambiguous" else 0.95)
    assert not {d for d, st in status.items() if st in ("failed", "unsupported")} & set(by_doc)
