"""Repeated passages by relative Lempel-Ziv parsing of documents against an indexed corpus.

The reference is the corpus itself, cut into blocks: every document is one block, in doc_id
order. Parsing goes in four steps, each a join or an aggregation.

1. Block index. Of the 13 word 8-grams in any run of 20 words the one with the smallest hash is
   an anchor. Equal runs of 20 words have equal anchors, so a run that occurs twice has an
   anchor that occurs twice. The index holds (anchor hash, doc, position) of all blocks, about
   one entry in seven words; entries whose hash occurs once cannot start a factor and go.
2. Seeds. Where an anchor occurs elsewhere, the 20-word seeds around it are looked up in the
   table of each seed's first occurrence in the corpus. Seeds are compared by 128 bits.
3. Factors. A document is parsed greedily from left to right: from a seed that occurs earlier,
   the factor is followed in the block of the seed's first occurrence as far as it goes. At a
   factor's boundary the next seed is looked up anew among all blocks, so a run that crosses a
   boundary is not missed.
4. Spans. The words of all factors (20 at least) are duplicates. What is left is joined.

The spans do not depend on which block a factor is followed in: each 20 words of the longest
factor in any block are a seed that occurs earlier, so following first occurrences covers the
same words as the longest factors do, in at most as many more factors as first occurrences jump.

A document that equals an earlier one, word for word, is one factor from its start to its end;
such copies are found by a fingerprint of the whole sequence and are not parsed.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import words as W
from foliant.llm.storage import cut, drop, table

ANCHOR_WORDS = 8
_OTHER = W.constants(1, 33)[0]


def _anchor_positions(w: W.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, starts of all windows, anchor of each window), as indices of words."""
    g = W.grams(w.hash, ANCHOR_WORDS)
    n = len(w.hash) - window + 1
    if n <= 0:
        return g, np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
    views = np.lib.stride_tricks.sliding_window_view(g, window - ANCHOR_WORDS + 1)
    return g, starts, views.argmin(axis=1)[starts] + starts


def _whole(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each text's word sequence."""
    out = []
    for salt in (31, 32):
        c = W.mix(w.hash ^ W.constants(1, salt)[0])
        h = np.zeros(len(w.first) - 1, dtype=np.uint64)
        for d, (i, j) in enumerate(zip(w.first[:-1], w.first[1:])):
            if j > i:
                p, _ = W._powers(j - i)
                h[d] = (c[i:j] * p[: j - i]).sum(dtype=np.uint64)
        out.append(h)
    return out[0], out[1]


def _scan(batches):
    for batch, data, offs in W.chunks(batches, "text"):
        w = W.Words(data, offs, W.EXACT)
        f1, f2 = _whole(w)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(w.first)), W.longs(f1), W.longs(f2)], ["id", "n", "f1", "f2"])


def _anchors(window: int):
    def run(batches):
        for batch, data, offs in W.chunks(batches, "text"):
            w = W.Words(data, offs, W.EXACT)
            g, _, at = _anchor_positions(w, window)
            at = np.unique(at)
            d = w.doc[at]
            yield pa.RecordBatch.from_arrays([W.longs(g[at]), batch.column(0).take(pa.array(d)), pa.array((at - w.first[d]).astype(np.int32))], ["h", "id", "pos"])

    return run


def _seeds(window: int):
    def run(batches):
        for batch, data, offs in W.chunks(batches, "text"):
            w = W.Words(data, offs, W.EXACT)
            _, starts, at = _anchor_positions(w, window)
            marks = batch.column(batch.schema.get_field_index("marks"))
            rows = np.repeat(np.arange(batch.num_rows), marks.value_lengths().to_numpy())
            marked = np.zeros(len(w.hash) + 1, dtype=bool)
            marked[w.first[rows] + marks.flatten().to_numpy()] = True
            starts = starts[marked[at]]
            d = w.doc[starts]
            h, g = (W.longs(W.grams(x, window, seed)[starts]) for x, seed in ((w.hash, 1), (W.mix(w.hash ^ _OTHER), 2)))
            yield pa.RecordBatch.from_arrays([h, g, batch.column(0).take(pa.array(d)), pa.array((starts - w.first[d]).astype(np.int32))], ["h", "g", "id", "pos"])

    return run


def parse(pos: np.ndarray, ref: np.ndarray, ref_pos: np.ndarray, window: int) -> list[dict]:
    """Greedy factors of one document from its seeds (by position) and their first occurrences."""
    if not len(pos):
        return []
    new = np.r_[True, (pos[1:] != pos[:-1] + 1) | (ref[1:] != ref[:-1]) | (ref_pos[1:] != ref_pos[:-1] + 1)]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(pos)] - 1
    return [
        {"start": int(pos[a]), "words": int(pos[b] - pos[a]) + window, "ref_id": int(ref[a]), "ref_start": int(ref_pos[a])}
        for a, b in zip(at, last)
    ]


_FACTORS = "array<struct<start:int,words:int,ref_id:long,ref_start:int>>"
_FACTORS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())]))


def _parse(window: int):
    """Rows (id, hits) -> (id, factors)."""

    def run(batches):
        for batch in batches:
            ids, factors = batch.column(0), []
            hits = batch.column(batch.schema.get_field_index("hits"))
            for r in range(batch.num_rows):
                h = hits[r].values
                pos, ref, ref_pos = (h.field(c).to_numpy() for c in ("pos", "ref_id", "ref_start"))
                order = np.argsort(pos)
                factors.append(parse(pos[order], ref[order], ref_pos[order], window))
            yield pa.RecordBatch.from_arrays([ids, pa.array(factors, _FACTORS_ARROW)], ["id", "factors"])

    return run


def _with_kept(batches):
    """Rows (id, text, factors) -> (id, n_words, n_removed, kept_text, factors)."""
    for batch in batches:
        total, gone, kept = [], [], []
        texts = batch.column(batch.schema.get_field_index("text"))
        factors = batch.column(batch.schema.get_field_index("factors"))
        for r in range(batch.num_rows):
            words = texts[r].as_py().encode().split()
            left = words
            if factors[r].is_valid:
                f = factors[r].values
                keep = np.ones(len(words), dtype=bool)
                for start, n in zip(f.field("start").to_pylist(), f.field("words").to_pylist()):
                    keep[start : start + n] = False
                left = list(compress(words, keep))
            total.append(len(words))
            gone.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), factors], ["id", "n_words", "n_removed", "kept_text", "factors"])


def repeated_spans(docs: DataFrame, window: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, facts, factors): id, text; id, n, rep; id, factors of the documents that hold repeats.

    ``rep`` is the earlier document that one equals word for word (else null). factors are spans
    in words with the place of the reference that they repeat; a whole copy has one. No id comes twice.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    scan_schema = "id long, n long, f1 long, f2 long"
    base = cut(texts.mapInArrow(_scan, scan_schema), "scan")
    first = base.where(F.col("id").isNotNull() & (F.col("n") >= window)).groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # written first: a join with a table, not with an aggregation, lets Spark split a hot key
    first = cut(first.drop("copies"), "first-copies")
    copies = cut(base.join(first, ["f1", "f2", "n"]).where("id <> rep").select("id", "rep", "n"), "copies")

    placed = texts.where("id is not null")
    anchors = placed.mapInArrow(_anchors(window), "h long, id long, pos int")
    shared = cut(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "shared-anchors")
    marks = anchors.join(shared, "h").groupBy("id").agg(F.collect_list("pos").alias("marks"))
    marks = marks.join(copies, "id", "left_anti")
    suspects = cut(placed.join(marks, "id"), "suspects")

    seeds = suspects.select("id", "text", "marks").mapInArrow(_seeds(window), "h long, g long, id long, pos int")
    earliest = cut(seeds.groupBy("h", "g").agg(F.min(F.struct("id", "pos")).alias("at"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "g", "at"), "first-seeds")
    later = seeds.join(earliest, ["h", "g"]).where((F.col("at.id") < F.col("id")) | ((F.col("at.id") == F.col("id")) & (F.col("at.pos") < F.col("pos"))))
    hits = later.groupBy("id").agg(F.collect_list(F.struct("pos", F.col("at.id").alias("ref_id"), F.col("at.pos").alias("ref_start"))).alias("hits"))
    parsed = hits.mapInArrow(_parse(window), f"id long, factors {_FACTORS}")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("words"), F.col("rep").alias("ref_id"), F.lit(0).alias("ref_start")))
    factors = cut(parsed.union(copies.select("id", whole.cast(_FACTORS))), "factors")
    for done in (suspects, earliest, shared, first):
        drop(done)
    return texts, base.select("id", "n").join(copies.select("id", "rep"), "id", "left"), factors


def _by_row(docs: DataFrame, window: int) -> DataFrame:
    """``remove_repeats`` of rows of which some repeat a doc_id, under keys in the order of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    named = rows.where("id is not null").orderBy("id", "text")
    keyed = cut(named.select(F.monotonically_increasing_id().alias("key"), "id", "text"), "keyed")
    ids = keyed.select("key", "id")
    one = cut(remove_repeats(keyed.select(F.col("key").alias("doc_id"), "text"), window), "by-key")
    # the keys of what is repeated become doc_ids
    refs = one.select("doc_id", F.posexplode("factors").alias("at", "f")).join(ids.withColumnRenamed("key", "_ref"), F.col("f.ref_id") == F.col("_ref"))
    factor = F.struct("at", F.struct(F.col("f.start"), F.col("f.words"), F.col("id").alias("ref_id"), F.col("f.ref_start")).alias("f"))
    refs = refs.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(factor)), lambda x: x["f"]).cast(_FACTORS).alias("factors"))
    copies = one.where("copy_of is not null").select("doc_id", F.col("copy_of").alias("_ref")).join(ids.withColumnRenamed("key", "_ref"), "_ref").select("doc_id", F.col("id").alias("copy_of"))
    out = one.drop("factors", "copy_of").join(refs, "doc_id", "left").join(copies, "doc_id", "left").withColumnRenamed("doc_id", "key").join(ids, "key")
    nameless = remove_repeats(rows.where("id is null").select(F.col("id").alias("doc_id"), "text"), window)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_text", "copy_of", "factors").union(nameless)


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_removed, kept_text, copy_of, factors.

    kept_text: the words that are left, joined by one space. copy_of: the earlier document that
    this one equals word for word, else null. factors: the duplicate spans in words and what they
    repeat, null if there are none. docs has ``doc_id`` (long) and ``text``; other columns are not
    read. Null text is empty text. Rows with a null doc_id have no place in the order: they lose
    nothing, and nothing goes because of them. Rows that repeat a doc_id are documents of
    their own, which follow each other in the order of their texts. A text of fewer than ``window`` words loses nothing. An
    empty table gives an empty one. ``window`` is at least 9 (the anchors' words and one).
    """
    if not docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long")).count().where("count > 1").isEmpty():
        return _by_row(docs, window)
    texts, facts, factors = repeated_spans(docs, window)
    found = texts.where("id is not null").join(factors, "id", "left").unionByName(texts.where("id is null"), allowMissingColumns=True)
    left = found.mapInArrow(_with_kept, f"id long, n_words long, n_removed long, kept_text string, factors {_FACTORS}")
    copies = facts.where("id is not null and rep is not null").select("id", F.col("rep").alias("copy_of"))
    return left.join(copies, "id", "left").select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_text", "copy_of", "factors")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Digests of what ``remove_repeats`` leaves of each document."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = {
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS seq FROM s),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY seq ORDER BY doc_id, p) AS nth FROM k),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + 20)))) AS g FROM r WHERE nth > 1 GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: g IS NULL OR NOT list_contains(g, i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
""",
}
QUERIES = {"op3_substring_dedup": op3_substring_dedup}
