"""Filings as files: bytes, character sets, submission blocks, and the choice of the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.places import block_places
from foliant.functions.python import decode_cp1252, html_to_text
from foliant.functions.taxonomy import ACCEPTED_FORMS
from foliant.sources.staging import stage

MAX_UPLOAD_BYTES = 25 << 20
UPLOAD_SUFFIXES = ("htm", "html", "txt")
# Fixed value: where filings may be fetched from.
ARCHIVE_PREFIX = "https://www.sec.gov/Archives/"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """doc_id (path), content, length, sha256, raw_text of each file below ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return decode(files.select(F.col("path").alias("doc_id"), "content", "length", F.sha2("content", 256).alias("sha256")))


def decode(files: DataFrame) -> DataFrame:
    """Adds raw_text: UTF-8 where the bytes are valid, else Windows-1252 with replacement.

    The two kinds are split first, so only invalid rows reach the Python function.
    """
    good = F.is_valid_utf8("content")
    # guarded as well: a later filter on the text may be evaluated together with the split
    utf8 = files.where(good).withColumn("raw_text", F.when(good, F.decode("content", "UTF-8")))
    other = files.where(~good).withColumn("raw_text", decode_cp1252("content"))
    return utf8.unionByName(other)


def largest_per_directory(files: DataFrame) -> DataFrame:
    """The largest file of each directory, notes (.md) aside; ties to the smaller path."""
    named = files.where(~F.lower("path").endswith(".md")).withColumn("dir", F.regexp_extract("path", r"([^/]+)/[^/]*$", 1))
    best = F.max_by(F.struct("path", "length"), F.struct("length", F.reverse(F.col("path"))))
    return named.groupBy("dir").agg(best.alias("f")).select("dir", "f.path", "f.length")


def refuse_upload(name: Column, length: Column) -> Column:
    """Why an upload is refused; null if it is taken."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(~suffix.isin(*UPLOAD_SUFFIXES) | (length == 0), "bad_input").when(length > MAX_UPLOAD_BYTES, "too_large")


def refuse_url(url: Column) -> Column:
    """Why a url is refused as a source; null if it lies in the archive of filings."""
    return F.when(~F.startswith(F.coalesce(url, F.lit("")), F.lit(ARCHIVE_PREFIX)), "bad_input")


def single_file_per_directory(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dir, path, length of directories that hold exactly one file; dir, n_files of those that do not). files: path, length.

    Paths that step out of their folder (``..``) are no files of it.
    """
    inside = ~F.array_contains(F.split("path", "/"), "..")
    named = files.where(inside).withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    found = named.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"), F.min(F.struct("path", "length")).alias("f"))
    return found.where("n_files = 1").select("dir", "f.path", "f.length"), found.where("n_files <> 1").select("dir", "n_files")


def with_blocks(raw: DataFrame) -> DataFrame:
    """raw (doc_id, raw_text) with blocks: (type, sequence, filename, body, start) of its <DOCUMENT> blocks."""
    rows = raw.withColumn("blocks", F.coalesce(block_places("raw_text"), F.array()))
    # Python tells where the bodies lie; they are cut where the text stands
    body = lambda b: F.substring(F.col("raw_text"), b["first"] + 1, b["last"] - b["first"])
    block = lambda b: F.struct(*(b[c].alias(c) for c in ("type", "sequence", "filename", "start")), body(b).alias("body"))
    return rows.withColumn("blocks", F.transform("blocks", block))


def select_documents(raw: DataFrame) -> DataFrame:
    """doc_id, raw_text -> doc_id, text (normalized), and the document's facts.

    The accepted block is read, else the whole submission. Only HTML is read by Python. Text
    and facts are staged once; later steps read the columns they need.
    """
    raw = raw.select("doc_id", "raw_text", F.contains("raw_text", F.lit("<")).alias("tags"))
    # Python sees the texts that hold blocks
    held = F.col("tags") & (F.contains("raw_text", F.lit("<DOCUMENT>")) | F.col("raw_text").rlike("(?i)<document>"))
    rows = raw.select("doc_id", "raw_text", "tags", F.coalesce(block_places(F.when(held, F.col("raw_text"))), F.array()).alias("blocks"))
    chosen = F.get(F.filter("blocks", lambda b: b["type"].isin(*ACCEPTED_FORMS)), F.lit(0))
    own = F.substring(F.col("raw_text"), F.col("chosen.first") + 1, F.col("chosen.last") - F.col("chosen.first"))
    rows = rows.withColumn("chosen", chosen).withColumn("body", F.when(F.col("chosen").isNotNull(), own).otherwise(F.col("raw_text")))
    declared = F.when(F.col("chosen").isNotNull(), F.col("chosen.type")).otherwise(F.nullif(F.get("blocks", F.lit(0))["type"], F.lit("")))
    picked = F.when(F.col("chosen").isNotNull(), F.trim(F.concat_ws(" ", "chosen.type", F.concat(F.lit("seq="), "chosen.sequence"), "chosen.filename")))
    picked = picked.when(F.size("blocks") > 0, "whole file (no 10-K block to select)").otherwise("whole file (no <DOCUMENT> blocks)")
    header, fact = T.raw_dates(F.col("raw_text"))
    rows = rows.select(
        "doc_id", "body", F.when(~F.col("tags"), "txt").otherwise(T.format_era(F.col("body"))).alias("format_era"), declared.alias("form_type_declared"), picked.alias("document_selected"),
        F.size("blocks").alias("n_blocks"), F.array_sort(F.array_distinct(F.transform("blocks", lambda b: b["type"]))).alias("block_types"),
        ((F.size("blocks") > 0) & F.col("chosen").isNull()).alias("fallback"), F.length("raw_text").alias("raw_chars"), F.octet_length("raw_text").alias("raw_bytes"), F.col("chosen").isNull().alias("whole"),
        F.sha2("raw_text", 256).alias("input_sha256"), header.alias("header_date"), fact.alias("inline_date"),
    )
    # the Python function sees nulls in the place of plain texts
    plain = F.col("format_era") == "txt"
    rows = rows.withColumn("_read", html_to_text(F.when(~plain, F.col("body"))))
    rows = rows.withColumn("_within", F.when(plain, T.line_ends(F.col("body"))).otherwise(T.tidy_within(F.col("_read")))).drop("body", "_read")
    rows = rows.withColumn("text", T.strip_long(F.col("_within"))).drop("_within")
    rows = rows.withColumn("form_type_sniffed", T.sniff_form(F.col("text"))).withColumn("told", T.told_period(F.col("header_date"), F.col("inline_date")))
    # a cover is searched once, and only where nothing else tells the period
    rows = rows.withColumn("cover", F.when(F.col("told").isNull(), T.cover_date(F.col("text"))))
    # a plain text as long as its submission in bytes is as long in characters
    same = plain & F.col("whole") & (F.octet_length("text") == F.col("raw_bytes"))
    d, s = F.col("form_type_declared"), F.col("form_type_sniffed")
    family = d.isin(*ACCEPTED_FORMS) & s.isin(*ACCEPTED_FORMS)
    disagree = F.coalesce((F.replace(d, F.lit("-"), F.lit("")) != F.replace(s, F.lit("-"), F.lit(""))) & ~family, F.lit(False))
    types = F.array_join(F.transform("block_types", lambda t: F.when(t == "", F.lit("<none>")).otherwise(t)), ", ")
    whole = F.concat(F.lit("no block declares an annual report ("), types, F.lit("): the whole submission is read, exhibits too"))
    differ = F.concat(F.lit("the header says "), d, F.lit(", the cover "), s)
    warn = lambda when, code, message: F.when(when, F.struct(F.lit(code).alias("code"), message.alias("message")))
    warned = F.array(warn(F.col("fallback"), "whole_submission_fallback", whole), warn(disagree, "form_type_disagreement", differ))
    rows = rows.select(
        "doc_id", "text", "format_era", "form_type_declared", "form_type_sniffed", F.coalesce(d, s).alias("form_type"),
        F.coalesce("told", T.parse_date(F.col("cover"))).alias("period_end"),
        "n_blocks", "block_types", "document_selected", "raw_chars", F.when(same, F.col("raw_chars")).otherwise(F.length("text")).alias("norm_chars"), "input_sha256",
        F.filter(warned, lambda x: x.isNotNull()).alias("selection_warnings"),
    )
    return stage(rows, "docs", texts=True)


def read_cases(spark: SparkSession, path: str, suite: str | None = None) -> DataFrame:
    """Evaluation cases (one JSON object a file): id, suites, debt, and the raw case."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    case = F.from_json("value", "id string, task string, suites array<string>, input struct<path:string,exclude_boilerplate:boolean>, expect struct<checks:array<string>>")
    rows = raw.select(case.alias("c"), "value").select("c.*", "value")
    rows = rows.withColumn("suites", F.coalesce("suites", F.array(F.lit("fast")))).withColumn("debt", F.array_contains("suites", "debt"))
    return rows if suite is None else rows.where(runs_in(F.col("suites"), F.lit(suite)))


def runs_in(suites: Column, asked: Column) -> Column:
    """Whether a case of these suites runs when one is asked for; debt always does."""
    return (asked == "all") | F.array_contains(suites, asked) | F.array_contains(suites, "debt")


def missing_citations(texts: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """doc_id, cited: names that texts (doc_id, text) cite by a pattern's first group and files (name) has not."""
    cited = texts.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("cited"))
    return cited.join(files.select(F.col("name").alias("cited")), "cited", "left_anti").select("doc_id", "cited")


def append_history(runs: DataFrame, path: str) -> None:
    """One JSON line a run."""
    runs.write.mode("append").json(path)


def write_report(results: DataFrame, path: str, suite: str, red: bool, asked: bool | None = None, from_dir: bool = False) -> bool:
    """Writes the full report where the policy asks for it; tells whether it did."""
    wanted = from_dir or (asked is not False and (bool(asked) or suite == "all" or red))
    if wanted:
        results.write.mode("overwrite").json(path)
    return wanted


def write_artifact(rows: DataFrame, path: str, kind: str, sha: Column | None = None) -> None:
    """Records, screens or metrics as JSON lines below ``path``, each with what it is and the build it comes from."""
    stamped = rows.select(F.lit(kind).alias("kind"), build_identity(sha if sha is not None else F.lit(None).cast("string")).alias("git_sha"), "*")
    stamped.write.mode("overwrite").json(path)


def _section(lines: DataFrame, section: str) -> DataFrame:
    """The lines (file, line_no, raw) below the heading ``section`` of each file, up to the next heading."""
    order = Window.partitionBy("file").orderBy("line_no")
    heading = F.when(F.col("raw").rlike(r"^#+\s"), F.trim(F.regexp_replace("raw", r"^#+\s*", "")))
    rows = lines.withColumn("_section", F.last(heading, ignorenulls=True).over(order))
    return rows.where((F.col("_section") == section) & ~F.col("raw").rlike(r"^#+\s")).drop("_section")


def markdown_table(lines: DataFrame, section: str) -> DataFrame:
    """First table below a heading of each file: file, row_no, cells (map by header). lines: file, line_no, raw.

    The rows of one file meet in one task. Rows with another number of cells than the header are
    dropped; markup in cells is taken off.
    """
    order = Window.partitionBy("file").orderBy("line_no")
    rows = _section(lines, section).withColumn("bar", F.trim("raw").startswith("|"))
    rows = rows.where("bar").withColumn("no", F.row_number().over(order))
    cells = F.transform(F.split(F.regexp_replace(F.trim("raw"), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    rows = rows.withColumn("cells", cells).withColumn("head", F.first("cells").over(order))
    body = rows.where((F.col("no") > 2) & (F.size("cells") == F.size("head")))
    plain = F.transform("cells", T.plain_markdown)
    return body.select("file", (F.col("no") - 2).alias("row_no"), F.map_from_arrays("head", plain).alias("cells"))


def markdown_terms(lines: DataFrame, section: str) -> DataFrame:
    """Bullets below a heading, grouped under the bold line above them: file, group, line_no, term, detail. lines: file, line_no, raw.

    A bullet ``- **Term** detail`` goes on over the lines that follow it up to a blank one. A bold
    line that has its detail beside it is a group with one entry of its own, which has no term.
    """
    order = Window.partitionBy("file").orderBy("line_no")
    rows = _section(lines, section).withColumn("raw", F.trim("raw"))
    blank, bullet = F.col("raw") == "", F.startswith("raw", F.lit("- "))
    opens = F.coalesce(F.lag(blank).over(order), F.lit(True)) & ~blank
    bold = opens & F.col("raw").rlike(r"^\*\*.+?\*\*")
    rows = rows.withColumn("entry", F.sum(F.when(bullet | opens | blank, 1).otherwise(0)).over(order)).withColumn("bold", bold).withColumn("bullet", bullet)
    parts = rows.where("raw <> ''").groupBy("file", "entry").agg(
        F.min("line_no").alias("line_no"), F.min_by("bold", "line_no").alias("bold"), F.min_by("bullet", "line_no").alias("bullet"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), " ").alias("text"),
    )
    lead = r"(?s)^\*\*(.+?)\*\*\s*(.*)$"
    text = F.regexp_replace("text", r"^- ", "")
    parts = parts.withColumn("lead", F.trim(F.regexp_extract(text, lead, 1))).withColumn("rest", F.regexp_replace(F.trim(F.regexp_extract(text, lead, 2)), r"^[\u2014\-\u2013:]\s*", ""))
    group = F.last(F.when(F.col("bold") & ~F.col("bullet"), F.col("lead")), ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no"))
    parts = parts.withColumn("group", group).where("group is not null")
    own = F.col("bold") & ~F.col("bullet")
    kept = parts.where(F.col("bullet") | (own & (F.col("rest") != "")))
    term = F.when(F.col("bullet"), T.plain_markdown(F.when(F.col("lead") != "", F.col("lead")).otherwise(text)))
    detail = F.when(own, T.plain_markdown(F.col("text"))).when(F.col("lead") != "", T.plain_markdown(F.col("rest"))).otherwise(F.lit(""))
    return kept.select("file", "group", "line_no", term.alias("term"), detail.alias("detail"))


def build_identity(*candidates: Column) -> Column:
    """The first candidate that is a commit id, cut to 12 characters; ``unknown`` if none."""
    valid = [F.when(F.trim(c).rlike("^[0-9a-f]{7,40}$"), F.substring(F.trim(c), 1, 12)) for c in candidates]
    return F.coalesce(*valid, F.lit("unknown"))
