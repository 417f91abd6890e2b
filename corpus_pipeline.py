"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows
as Parquet in the shared folder and reads them back as the next stage's ``docs``. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, language_id, minhash, mixing, pii
from foliant.llm.storage import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay.

    A null text, an empty one, or one without letters has no language and goes. Rows that repeat
    are judged each; a null lang or source is no evidence. An empty table stays empty.
    """
    return language_id.identify(docs).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest doc_id.

    Rows that repeat a doc_id are documents of their own; of a group's rows with its smallest
    doc_id the first stays. Rows without a doc_id are in no group and stay.
    """
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    keyed = cut(named.select(F.monotonically_increasing_id().alias("_key"), *COLUMNS), "keyed")
    found = minhash.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id")
    first = cut(found.join(keyed.select("_key", "doc_id"), "_key"), "components")
    first = first.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("first")).select(F.col("first._key").alias("_key"))
    return keyed.join(first, "_key", "left_semi").select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null texts have no words and stay. Rows that repeat a doc_id go together if one of them is
    hit; rows without a doc_id go if one of those is hit that has the same text. An empty table,
    or an empty benchmark, changes nothing.
    """
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")
    named = docs.join(found, "doc_id", "left_anti").select(*COLUMNS)
    nameless = docs.where("doc_id is null")
    if found.where("doc_id is null").isEmpty():
        return named
    # their texts take the place of ids
    texts = nameless.where("text is not null").select(F.xxhash64("text").alias("doc_id"), "text").distinct()
    hit = decontaminate.contamination(texts, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("_hash"))
    left = nameless.withColumn("_hash", F.xxhash64("text")).join(hit, "_hash", "left_anti").select(*COLUMNS)
    return named.where("doc_id is not null").union(left)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text.

    All rows stay: null texts stay null (n_chars null), rows that repeat are redacted each. An
    empty table stays empty.
    """
    return pii.redact_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the mix takes of each and the first slot that it has.

    Columns of ``documents`` and size, source_size, target, taken, first_slot; the documents with
    taken > 0 in the order of first_slot are the mixed corpus (``mixing.mixed_blocks`` gives its
    stretches). A null or empty text has size 0 and is taken 0 times; a null source is one of its
    own; rows that repeat are mixed each. An empty table stays empty.
    """
    return mixing.mix_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: The language and random-field models cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
