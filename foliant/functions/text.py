"""Scalar text functions as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide headings, forms, dates and pointers.
HEADING = (
    r"(?id)^[ \t ]*(?:part[ \t]+[ivx]+[ \t]*[-–—.:]?[ \t]*)?item[ \t ]*(\d{1,2})(?:[ \t]?([A-D]))?(?![A-Za-z])"
    r"(?:\([A-Za-z]{1,2}\))?[ \t]*[.:)\-–—]?[ \t]*(.*)$"
)
EXECUTIVE_OFFICERS = r"(?i)^[ \t]*executive officers of (the )?(registrant|company)\b(?!\.)"
TAIL = r"(?i)^[ \t]*(SIGNATURES?|Pursuant to the requirements of Section 13)\b"
BY_REFERENCE = r"(?i)incorporated\b[^.]{0,40}?\bby reference|reported on pages|refer to (page|the section)"
OTHER_DOCUMENT = r"(?i)(proxy statement|information statement|annual report to (its )?(share|stock|security)[ ]?(holders|owners))"
OTHER_ITEM = r"(?i)\bitem\s*\d{1,2}[A-D]?\b[^.]{0,200}?\bthis (form\s*10-?K|annual report|report)\b"
FURNITURE = r"(?i)^(?:</?(?:PAGE|TABLE|CAPTION|S|C|FN)>\s*)+$"
PAGE_NUMBER = r"(?i)^(?:page\s+)?[-–—\s]*\d{1,3}[-–—.\s]*$"
FORM = r"(?i)\bFORM\s{0,4}(10-[A-Z0-9]{1,4}(?:/A)?)\b"
DATE = r"(?i)([A-Za-z]{3,9})\.?\s+(\d{1,2})\s*,?\s*(\d{4})"
COVER_DATE = r"(?i)fiscal year ended[:\s]*([A-Z][a-z]{2,8}\.?\s+\d{1,2}\s*,?\s*\d{4})"
HEADER_DATE = r"CONFORMED PERIOD OF REPORT:\s*(\d{8})"
INLINE_DATE = r'(?s)name="dei:DocumentPeriodEndDate"(.{0,400})'
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
COVER_CHARS, AMENDMENT_REACH = 3000, 80


#: All that (?U)\s takes for white space.
WHITE = "\t\n\x0b\f\r \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end (any, not only blanks)."""
    return F.btrim(c, F.lit(WHITE))


def strip_long(c: Column) -> Column:
    """As ``strip``, which looks at every character, only where an end has white space. c is written out many times: a plain column."""
    ends = [test(c, F.lit(white)) for white in WHITE for test in (F.startswith, F.endswith)]
    return F.when(reduce(or_, ends), strip(c)).otherwise(c)


def tidy(c: Column) -> Column:
    """Runs of blanks to one, none around newlines, at most one empty line, none at the ends."""
    return strip(tidy_within(c))


def tidy_within(c: Column) -> Column:
    """As ``tidy``, with white space left at the ends."""
    c = F.regexp_replace(c, r"(?U)[^\S\n]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def line_ends(c: Column) -> Column:
    """Line ends to newlines."""
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, r"\r\n?", "\n")).otherwise(c)


def plain_text(c: Column) -> Column:
    """Line ends to newlines; layout stays."""
    return strip_long(line_ends(c))


def flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "))


def core(c: Column) -> Column:
    """Lower case, without any white space."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def numeric_density(c: Column) -> Column:
    kept = F.length(F.regexp_replace(c, r"[^\p{Nd}$%]+", ""))
    return kept.cast("double") / F.greatest(F.length(c), F.lit(1))


def format_era(body: Column) -> Column:
    html = body.rlike(r"(?i)<(?:html|body|div|font|span|p)[\s>/]")
    # most plain texts have no tag at all, and are not searched further
    tags = F.contains(body, F.lit("<"))
    return F.when(tags & body.rlike("(?i)<ix:"), "ixbrl").when(tags & html, "html").otherwise("txt")


def sniff_form(text: Column) -> Column:
    """The form that the cover names, with /A where an amendment is named nearby; null if none."""
    cover = F.substring(text, 1, COVER_CHARS)
    found = F.nullif(F.upper(F.regexp_extract(cover, FORM, 1)), F.lit(""))
    at = F.regexp_instr(cover, F.lit(FORM))
    reach = F.greatest(at - AMENDMENT_REACH, F.lit(1))
    near = F.substring(text, reach, at - reach + F.length(F.regexp_extract(cover, FORM, 0)) + AMENDMENT_REACH)
    amended = ~F.endswith(found, F.lit("/A")) & near.rlike(r"(?i)\bamendment\s+no\b")
    return F.when(amended, F.concat(found, F.lit("/A"))).otherwise(found)


def parse_date(s: Column) -> Column:
    """The first date written as a month's name, a day and a year that exists; null if none."""
    names, days, years = (F.regexp_extract_all(s, F.lit(DATE), F.lit(i)) for i in (1, 2, 3))
    month = lambda n: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(n, 1, 3)))
    joined = F.transform(F.arrays_zip(names.alias("n"), days.alias("d"), years.alias("y")), lambda x: F.try_to_date(F.concat_ws("-", x["y"], month(x["n"]).cast("string"), x["d"]), "yyyy-M-d"))
    return F.get(F.filter(joined, lambda d: d.isNotNull()), F.lit(0))


def raw_dates(raw: Column) -> tuple[Column, Column]:
    """What a raw submission says of its period: the header's digits and the text of the inline fact."""
    # a pattern is tried only where its first words stand
    found = lambda words, pattern: F.when(F.contains(raw, F.lit(words)), F.nullif(F.regexp_extract(raw, pattern, 1), F.lit("")))
    return found("CONFORMED PERIOD OF REPORT:", HEADER_DATE), found('"dei:DocumentPeriodEndDate"', INLINE_DATE)


def _decoded(c: Column) -> Column:
    """Character references decoded as far as a date can hold them; others are blanks."""

    def put(text, ref):
        hex_ = F.regexp_extract(ref, r"(?i)^&#x([0-9a-f]+);$", 1)
        number = F.coalesce(F.nullif(F.regexp_extract(ref, r"^&#(\d+);$", 1), F.lit("")), F.when(hex_ != "", F.conv(hex_, 16, 10))).cast("long")
        # chr knows one byte; what lies beyond it, and a blank that does not break, is no part of a date
        return F.replace(text, ref, F.when(number.between(33, 126), F.call_function("chr", number)).otherwise(F.lit(" ")))

    refs = F.regexp_extract_all(c, F.lit(r"&#?\w+;"), F.lit(0))
    return F.aggregate(F.array_distinct(refs), c, put)


def period_end(header: Column, fact: Column, text: Column) -> Column:
    """Fiscal period end: the header's date, else the inline fact's, else the cover's."""
    return F.coalesce(told_period(header, fact), parse_date(cover_date(text)))


def told_period(header: Column, fact: Column) -> Column:
    """The header's date, else the inline fact's."""
    return F.coalesce(F.try_to_date(header, "yyyyMMdd"), parse_date(_decoded(F.regexp_replace(fact, "<[^>]*>", " "))))


def cover_date(text: Column) -> Column:
    """The date that the cover names, as it is written; empty if none."""
    return F.regexp_extract(F.substring(text, 1, 2 * COVER_CHARS), COVER_DATE, 1)


def sentences(flattened: Column) -> Column:
    """Sentences of flattened text; a stop after "Item 7." or before the digit of "No. 2" ends none."""
    return F.split(flattened, r"(?i)(?<=[.])(?<!\bitem ?\d{1,2}[A-D]?\.)(?:(?<!\bno\.)|(?!\s\d))\s")


def is_pointer(s: Column) -> Column:
    return s.rlike(BY_REFERENCE) | s.rlike(OTHER_DOCUMENT) | s.rlike(OTHER_ITEM)


def same_words(c: Column) -> Column:
    """For comparing two tools' texts: runs of white space, hard blanks too, to one blank."""
    return flat(F.replace(c, F.lit("\u00a0"), F.lit(" ")))


def without_comments(c: Column, language: str) -> Column:
    """Source text without comments: "py" (lines of #), else markup and script (<!-- -->, /* */, lines of //)."""
    if language == "py":
        return F.regexp_replace(c, r"(?m)^[ \t]*#.*$", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(c, r"(?m)^[ \t]*//.*$", "")


def squashed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def plain_markdown(c: Column) -> Column:
    """Links, code, bold and italic of one line as plain text."""
    for pattern in (r"\[([^\]]+)\]\([^)]+\)", r"`([^`]+)`", r"\*\*([^*]+)\*\*", r"\*([^*]+)\*", r"(?<!\w)_([^_]+)_(?!\w)"):
        c = F.regexp_replace(c, pattern, "$1")
    return flat(c)
