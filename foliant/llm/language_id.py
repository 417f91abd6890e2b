"""Language identification by Bayesian evidence fusion.

For each text and language l the evidence adds up as log probabilities:

* text: a multinomial model of byte trigrams (letters folded, all else one space), trained from a
  bounded sample of each declared language's rows. Neighbouring trigrams overlap, so the sum is
  divided by three. A background model (trigrams spread evenly) is one more hypothesis: a text
  that it explains better is in none of the known languages.
* declared markup language: P(declared | l), from a table of counts over all rows, smoothed
  towards a fixed share of right declarations.
* address suffix and host: P(l | host), smoothed towards P(l | suffix), which is smoothed
  towards P(l); all three are grouped aggregations over all rows of the language that text and
  declaration give. The row's own share of a host is small by the smoothing mass.

Texts are read by scans and written nowhere. They are shuffled only where they are among the
columns to keep and the hosts are too many to broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from foliant.functions.python import read_html
from foliant.llm import words as W
from foliant.llm.storage import cut, small, table

BUCKETS = 1 << 15
#: Bound of the labelled rows of each language that the text model is trained from.
MAX_LABELLED = 20_000
#: Texts with a trigram: those with a letter.
LETTER = r"[A-Za-z]|[^\x00-\x7F]"
NONE = "und"

_FOLD = np.full(256, 32, dtype=np.int32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram, document of its middle); a space stands before and after each text.

    Trigrams without a letter are left out.
    """
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    at = np.arange(len(data)) + doc + 1
    b = np.full(len(data) + len(offs), 32, dtype=np.int32)
    b[at] = _FOLD[data]
    first, last = b[at - 1], b[at + 1]
    ok = (first != 32) | (b[at] != 32) | (last != 32)
    code = (first * 31 + b[at]) * 37 + last
    return (code * 7919 & (BUCKETS - 1))[ok], doc[ok]


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for batch, data, offs in W.chunks(batches, "_text"):
        grams, doc = _trigrams(data, offs)
        encoded = batch.column(batch.schema.get_field_index("_declared")).dictionary_encode()
        code = encoded.indices.to_numpy()[doc]
        for i, name in enumerate(encoded.dictionary.to_pylist()):
            add = np.bincount(grams[code == i], minlength=BUCKETS)
            total[name] = total[name] + add if name in total else add
    for name, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "gram", "n"])


class TextModel:
    """languages, and log P(trigram bucket | language) with the background as the last row.

    Languages are all that are declared by a row whose text has a letter, however few declare
    them. Each is trained from about ``max_labelled`` of its distinct texts at most (the share of
    the texts' hashes is max_labelled / rows, and copies of a text count once), at least the text
    with the smallest hash. The model takes 128 KB a language.
    """

    def __init__(self, rows: DataFrame, max_labelled: int = MAX_LABELLED):
        labelled = rows.select("_declared", "_text", F.shiftrightunsigned(F.xxhash64("_text"), 12).alias("_cell"))
        labelled = labelled.where(F.col("_declared").isNotNull() & F.col("_text").rlike(LETTER))
        found = labelled.groupBy("_declared").agg(F.count(F.lit(1)).alias("n"), F.min("_cell").alias("low")).collect()
        self.languages = sorted(r["_declared"] for r in found)
        upto = [(r["_declared"], max(int(min(1.0, max_labelled / r["n"]) * (1 << 52)), r["low"] + 1)) for r in found]
        bounds = rows.sparkSession.createDataFrame(upto, "_declared string, _upto long")
        sample = labelled.join(F.broadcast(bounds), "_declared").where("_cell < _upto").dropDuplicates(["_declared", "_cell"]).select("_declared", "_text")
        counts = sample.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        got = counts.toArrow()
        table_ = np.full((len(self.languages) + 1, BUCKETS), 0.0)
        at = {name: i for i, name in enumerate(self.languages)}
        lang = np.array([at[x] for x in got.column("lang").to_pylist()], dtype=int)
        table_[lang, got.column("gram").to_numpy().astype(int)] = got.column("n").to_numpy()
        table_[:-1] += 0.05
        table_[-1] = 1.0
        self.logp = np.log(table_ / table_.sum(axis=1, keepdims=True)).astype(np.float32)


def _score(model: TextModel):
    """Appends the text's log likelihoods (languages, then background) and its trigrams."""
    logp = model.logp

    def run(batches):
        for batch, data, offs in W.chunks(batches, "_text"):
            grams, doc = _trigrams(data, offs)
            n = batch.num_rows
            out = np.stack([np.bincount(doc, weights=row[grams], minlength=n) for row in logp], axis=1) / 3
            count = np.bincount(doc, minlength=n)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), logp.shape[0]).cast(pa.list_(pa.float64()))
            columns = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "_text"]
            names = [x for x in batch.schema.names if x != "_text"]
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(count)], [*names, "_loglik", "_grams"])

    return run


def host_suffix(host: Column) -> Column:
    """The last label of a host name; of a name without dots, nothing."""
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def identify(
    docs: DataFrame,
    text: str = "text",
    declared: str | None = "lang",
    host: str | None = "source",
    trust: float = 0.8,
    mass: float = 20.0,
    certainty: float = 0.5,
    max_labelled: int = MAX_LABELLED,
    keep: list[str] | None = None,
) -> DataFrame:
    """docs (of which the columns ``keep``, if given) with ``language``, ``confidence`` and ``kept`` in place of any columns of these names.

    declared and host name the columns with the markup's language and with the address's host
    (None: no such evidence). kept is false where the text has no letters, where the background
    explains it best, or where no language reaches ``certainty``; language is then ``und``.
    Null text is empty, so not kept; a null declaration is no evidence; rows with a null host
    have the corpus-wide prior. Rows that repeat count each. Ties go to the smaller language
    name. Where no row declares a language nothing is known and all rows are ``und``. An empty
    table gives an empty one.
    """
    held = [c for c in (docs.columns if keep is None else keep) if c not in ("language", "confidence", "kept")]
    # the caller's columns travel in a struct, so that no name of theirs can clash
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in held)).alias("_row"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        (F.lower(F.nullif(F.col(declared), F.lit(""))) if declared else F.lit(None).cast("string")).alias("_declared"),
        (F.lower(F.nullif(F.col(host), F.lit(""))) if host else F.lit(None).cast("string")).alias("_host"),
    )
    shown = [F.col(f"_row.`{c}`") for c in held]
    model = TextModel(rows.select("_text", "_declared"), max_labelled)
    names = model.languages
    if not names:
        return rows.select(*shown, F.lit(NONE).alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    known = F.array(*map(F.lit, names))
    # columns that were asked for go along with the scores; a whole row would make the table as large as the corpus
    narrow = rows.select("_text", "_declared", "_host") if keep is None else rows
    kind = lambda df: StructType([f for f in df.schema if f.name != "_text"]).add("_loglik", ArrayType(DoubleType())).add("_grams", LongType())
    scored = cut(narrow.mapInArrow(_score(model), kind(narrow)), "language-scores")

    def best(values: Column) -> Column:
        """Name of the greatest value, ties to the smaller name (names are sorted)."""
        return F.element_at(known, F.array_position(values, F.array_max(values)).cast("int"))

    by_text = best(F.slice("_loglik", 1, len(names)))
    seen = scored.where("_grams > 0").withColumn("_by_text", by_text)

    # P(declared | language): how rows of a text-given language declare themselves
    pairs = seen.where("_declared is not null").groupBy("_by_text", "_declared").count().where(F.col("_declared").isin(names)).collect()
    said = np.full((len(names), len(names)), (1 - trust) / max(1, len(names) - 1)) + np.eye(len(names)) * (trust - (1 - trust) / max(1, len(names) - 1))
    said *= mass
    for r in pairs:
        said[names.index(r["_by_text"]), names.index(r["_declared"])] += r["count"]
    said = np.log(np.maximum(said / said.sum(axis=1, keepdims=True), 1e-9))
    rows_of = F.broadcast(docs.sparkSession.createDataFrame([(name, said[:, d].tolist()) for d, name in enumerate(names)], "_declared string, _said array<double>"))
    declared_log = F.coalesce("_said", F.array_repeat(F.lit(0.0), len(names)))

    # hierarchically smoothed priors by grouped aggregation
    added = F.zip_with(F.slice("_loglik", 1, len(names)), declared_log, lambda a, b: a + b)
    votes = seen.join(rows_of, "_declared", "left").select("_host", host_suffix(F.col("_host")).alias("_suffix"), best(added).alias("_vote"))
    per_host = cut(votes.groupBy("_host", "_suffix").agg(*(F.count_if(F.col("_vote") == name).alias(f"n{i}") for i, name in enumerate(names))), "host-votes")
    n = [f"n{i}" for i in range(len(names))]
    every = per_host.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in n)).first()
    total = sum(every[c] for c in n)
    overall = [(every[c] + 1.0) / (total + len(names)) for c in n]

    def smoothed(counts: list[Column], prior: list[Column]) -> list[Column]:
        whole = sum(counts[1:], counts[0])
        return [(c + mass * p) / (whole + mass) for c, p in zip(counts, prior)]

    per_suffix = per_host.where("_suffix is not null").groupBy("_suffix").agg(*(F.sum(c).alias(f"s{c}") for c in n))
    suffix_prior = smoothed([F.coalesce(F.col(f"s{c}"), F.lit(0)) for c in n], [F.lit(float(p)) for p in overall])
    priors = per_host.where("_host is not null").join(per_suffix, "_suffix", "left")
    priors = priors.select("_host", F.array(*(F.log(p) for p in smoothed([F.col(c) for c in n], suffix_prior))).alias("_prior"))
    general = F.array(*(F.lit(float(np.log(p))) for p in overall))

    decided = rows.mapInArrow(_score(model), kind(rows)) if keep is None else scored
    joined = decided.join(rows_of, "_declared", "left").join(small(cut(priors, "host-priors")), "_host", "left")
    posterior = F.zip_with(F.zip_with(F.slice("_loglik", 1, len(names)), declared_log, lambda a, b: a + b), F.coalesce("_prior", general), lambda a, b: a + b)
    joined = joined.withColumn("_post", posterior).withColumn("_top", F.array_max("_post"))
    share = 1 / F.aggregate("_post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    outside = F.element_at("_loglik", -1) > F.array_max(F.slice("_loglik", 1, len(names)))
    kept = (F.col("_grams") > 0) & ~outside & (share >= certainty)
    return joined.select(
        *shown,
        F.when(kept, best(F.col("_post"))).otherwise(F.lit(NONE)).alias("language"),
        F.when(F.col("_grams") > 0, share).otherwise(F.lit(0.0)).alias("confidence"),
        kept.alias("kept"),
    )


def _read(batches):
    for batch in batches:
        texts = pa.array(map(read_html, batch.column(1).to_pylist()), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts, *batch.columns[2:]], batch.schema.names)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, host: pages without markup, their ``<html lang>`` and the host of their address.

    Null html and url count as empty. The contents of title, script and style are left out; tags
    are read as a browser reads odd ones, in linear time. The declared language is that of the
    page's first html tag.
    """
    html = F.coalesce("html", F.lit(""))
    begins = F.locate("<html", F.lower(html))
    tag = F.substring_index(F.substr(html, begins), ">", 1)
    rows = pages.select(
        "page_id",
        html.alias("text"),
        F.when(begins > 0, F.nullif(F.regexp_extract(tag, r"""(?i)\blang\s*+=\s*+["']?([a-zA-Z]+)""", 1), F.lit(""))).alias("declared"),
        F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^/?#]*?://([^/?#:]*)", 1).alias("host"),
    )
    return rows.mapInArrow(_read, rows.schema)


def pages_language(pages: DataFrame) -> DataFrame:
    """page_id, language, confidence, kept: pages by text, ``<html lang>``, address suffix and host (see ``identify``)."""
    return identify(page_texts(pages), declared="declared", host="host", keep=["page_id"])


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Pages: the table that has all the evidence, text, markup language, address suffix and host."""
    out = pages_language(table(spark, sf_dir, "pages"))
    return out.select("page_id", "language", F.round("confidence", 6).alias("confidence"), "kept")


def language_id_documents(spark, sf_dir: str) -> DataFrame:
    """Documents, with ``lang`` as the declared language and ``source`` in the place of the host."""
    out = identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("lang").alias("declared"), "language", F.round("confidence", 6).alias("confidence"), "kept")


QUERIES = {"op1_language_id": op1_language_id, "language_id_documents": language_id_documents}
SQL: dict[str, str] = {}
