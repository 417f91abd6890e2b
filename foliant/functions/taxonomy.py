"""The items of an annual report: codes, titles by era, dates. Fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Item codes in document order.
ORDER = ("1", "1A", "1B", "1C", "2", "3", "4", "5", "6", "7", "7A", "8", "9", "9A", "9B", "9C", "10", "11", "12", "13", "14", "15", "16")

# Code -> (part, titles; the first is the present one, the second the one before it).
TITLES = {
    "1": ("I", ("Business",)),
    "1A": ("I", ("Risk Factors",)),
    "1B": ("I", ("Unresolved Staff Comments",)),
    "1C": ("I", ("Cybersecurity",)),
    "2": ("I", ("Properties",)),
    "3": ("I", ("Legal Proceedings",)),
    "4": ("I", ("Mine Safety Disclosures", "Submission of Matters to a Vote of Security Holders", "Reserved")),
    "5": (
        "II",
        (
            "Market for Registrant's Common Equity, Related Stockholder Matters and Issuer Purchases of Equity Securities",
            "Market for the Registrant's Common Equity and Related Stockholder Matters",
        ),
    ),
    "6": ("II", ("[Reserved]", "Selected Financial Data")),
    "7": ("II", ("Management's Discussion and Analysis of Financial Condition and Results of Operations",)),
    "7A": ("II", ("Quantitative and Qualitative Disclosures About Market Risk",)),
    "8": ("II", ("Financial Statements and Supplementary Data",)),
    "9": ("II", ("Changes in and Disagreements with Accountants on Accounting and Financial Disclosure",)),
    "9A": ("II", ("Controls and Procedures",)),
    "9B": ("II", ("Other Information",)),
    "9C": ("II", ("Disclosure Regarding Foreign Jurisdictions that Prevent Inspections",)),
    "10": ("III", ("Directors, Executive Officers and Corporate Governance", "Directors and Executive Officers of the Registrant")),
    "11": ("III", ("Executive Compensation",)),
    "12": (
        "III",
        (
            "Security Ownership of Certain Beneficial Owners and Management and Related Stockholder Matters",
            "Security Ownership of Certain Beneficial Owners and Management",
        ),
    ),
    "13": ("III", ("Certain Relationships and Related Transactions, and Director Independence", "Certain Relationships and Related Transactions")),
    "14": (
        "III",
        ("Principal Accountant Fees and Services", "Exhibits, Financial Statement Schedules, and Reports on Form 8-K", "Controls and Procedures"),
    ),
    "15": ("IV", ("Exhibits, Financial Statement Schedules", "Exhibits, Financial Statement Schedules, and Reports on Form 8-K")),
    "16": ("IV", ("Form 10-K Summary",)),
}

# First fiscal period end for which a code is expected; others always are.
ADDED = {
    "1A": "2005-12-01",
    "1B": "2005-12-01",
    "1C": "2023-12-15",
    "7A": "1997-06-15",
    "9A": "2003-08-14",
    "9B": "2004-05-23",
    "9C": "2021-10-01",
    "15": "2002-06-01",
    "16": "2016-06-01",
}

# First period end of the present title; the second title holds before it.
RETITLED = {
    "4": "2011-12-15",
    "5": "2005-12-01",
    "6": "2021-02-10",
    "10": "2006-12-15",
    "12": "2002-03-15",
    "13": "2006-12-15",
    "14": "2003-08-14",
    "15": "2004-05-23",
}

# Titles that held between two dates only, and the part of 14 before it was retitled.
BETWEEN = {"4": ("2010-01-01", "2011-12-15", "I", "Reserved"), "14": ("2002-06-01", "2003-08-14", "III", "Controls and Procedures")}
EARLIER_PART = {"14": "IV"}

# Absent without being missing; forms that are segmented.
MAY_BE_ABSENT = ("16", "9C")
ACCEPTED_FORMS = ("10-K", "10-K405")


def label_eras() -> list[tuple]:
    """(code, ord, valid_from, valid_to, part, title) rows; a null bound is open. The null period has the earliest row."""
    rows = []
    for ord_, code in enumerate(ORDER):
        part, titles = TITLES[code]
        change = RETITLED.get(code)
        if change is None:
            rows.append((code, ord_, None, None, part, titles[0]))
            continue
        begin, end, *label = BETWEEN.get(code, (change, change, part, titles[0]))
        rows.append((code, ord_, None, begin, EARLIER_PART.get(code, part), titles[1]))
        if begin != end:
            rows.append((code, ord_, begin, end, *label))
        rows.append((code, ord_, change, None, part, titles[0]))
    return rows


def item_dim(spark: SparkSession) -> DataFrame:
    """code, ord, added_on (null: always expected)."""
    rows = [(c, i, ADDED.get(c)) for i, c in enumerate(ORDER)]
    return spark.createDataFrame(rows, "code string, ord int, added string").select("code", "ord", F.to_date("added").alias("added_on"))


def label_dim(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(label_eras(), "code string, ord int, f string, t string, part string, title string")
    return rows.select("code", "ord", F.to_date("f").alias("valid_from"), F.to_date("t").alias("valid_to"), "part", "title")


def expected_codes(period_end: Column) -> Column:
    """Codes that the period expects, in order; the undated ones for a null period."""
    dated = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(ADDED.get(c)).cast("date").alias("added_on")) for c in ORDER))
    kept = F.filter(dated, lambda x: x["added_on"].isNull() | F.coalesce(period_end >= x["added_on"], F.lit(False)))
    return F.transform(kept, lambda x: x["code"])


def expects(code: Column, period_end: Column) -> Column:
    """Whether a code is one of the ``expected_codes`` of the period."""
    # code is written once, for a filter may be evaluated where it is made
    first = F.lit("0001-01-01").cast("date")
    added = F.create_map(*(x for c in ORDER for x in (F.lit(c), F.coalesce(F.lit(ADDED.get(c)).cast("date"), first))))
    return F.coalesce(F.element_at(added, code) <= F.coalesce(period_end, first), F.lit(False))


def alias_lists() -> dict[str, list[str]]:
    """code -> normalized titles of all eras."""
    import re

    def norm(s: str) -> str:
        return re.sub(r"[^a-z0-9 ]+", " ", s.lower()).strip()

    return {code: [norm(t) for t in titles] for code, (_, titles) in TITLES.items()}


def aliases() -> Column:
    """Map of code -> normalized titles of all eras."""
    return F.create_map(*(x for code, names in alias_lists().items() for x in (F.lit(code), F.array(*map(F.lit, names)))))
