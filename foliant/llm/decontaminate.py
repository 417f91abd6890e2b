"""Benchmark decontamination with a positional inverted index.

1. Windows: every ``window`` consecutive words of a benchmark item (all of a shorter item).
2. Term counts of the corpus, for the benchmark's terms; a window with a term that the corpus
   lacks cannot occur. Of each other window the ``rarest`` terms with the fewest postings are probes.
3. Index: the postings (term, document, positions) of the probed terms, with a row (null term)
   for each document's length, stored as a table.
4. Intersection: a posting at p of a probe with offset o stands for a window that starts at p - o.
   From the rarest probe on, a start that all lists of a window share is a candidate; proximity
   matches let the starts of the probes differ by a slack instead.
5. Candidates are compared with the document's words over the window's whole length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import words as W
from foliant.llm.storage import cut, table

#: Up to so many benchmark terms are sent to the tasks as a filter; beyond it, terms are joined.
FILTER_TERMS = 1_000_000


def window_hash(hashes: np.ndarray, length: int) -> np.ndarray:
    return W.grams(hashes, length, seed=400 + length)


def window_check(hashes: np.ndarray, length: int) -> np.ndarray:
    """64 bits more of each window, so that windows are compared by 128."""
    return W.grams(W.mix(hashes ^ _OTHER), length, seed=800 + length)


_OTHER = W.constants(1, 34)[0]


def _windows(window: int):
    def run(batches):
        for batch, data, offs in W.chunks(batches, "text"):
            w = W.Words(data, offs, W.ALNUM)
            item, wid, check, terms = [], [], [], []
            ids = batch.column(0).to_pylist()
            for d, (i, j) in enumerate(zip(w.first[:-1], w.first[1:])):
                length = min(window, int(j - i))
                if length:
                    for s, (h, g) in enumerate(zip(window_hash(w.hash[i:j], length), window_check(w.hash[i:j], length))):
                        item.append(ids[d])
                        wid.append(h)
                        check.append(g)
                        terms.append(w.hash[i + s : i + s + length].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), W.longs(np.array(wid, np.uint64)), W.longs(np.array(check, np.uint64)), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "wid", "check", "terms"]
            )

    return run


def _in(sorted_terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_terms, hashes)
    at[at == len(sorted_terms)] = 0
    return sorted_terms[at] == hashes if len(sorted_terms) else np.zeros(len(hashes), bool)


def _counts(terms):
    def run(batches):
        total: dict = {}
        for batch, data, offs in W.chunks(batches, "text"):
            h = W.Words(data, offs, W.ALNUM).hash.view(np.int64)
            if terms is not None:
                h = h[_in(terms.value, h)]
            u, c = np.unique(h, return_counts=True)
            if terms is None:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], ["term", "n"])
                continue
            for t, n in zip(u.tolist(), c.tolist()):
                total[t] = total.get(t, 0) + n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    return run


def _postings(terms):
    """(term, id, positions) of each document, and (null, id, [number of words])."""

    def run(batches):
        for batch, data, offs in W.chunks(batches, "text"):
            w = W.Words(data, offs, W.ALNUM)
            h = w.hash.view(np.int64)
            at = np.flatnonzero(_in(terms.value, h)) if terms is not None else np.arange(len(h))
            doc, pos = w.doc[at], at - w.first[w.doc[at]]
            order = np.lexsort((pos, h[at], doc))
            doc, pos, term = doc[order], pos[order], h[at][order]
            begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]) if len(doc) else np.empty(0, np.int64)
            ends = np.r_[begin, len(doc)].astype(np.int32)
            ids = batch.column(0)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(pos.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(term[begin]), ids.take(pa.array(doc[begin])), lists], ["term", "id", "positions"])
            n = np.diff(w.first).astype(np.int32)
            lengths = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32)), pa.array(n))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), ids, lengths], ["term", "id", "positions"])

    return run


def _verify(batches):
    for batch, data, offs in W.chunks(batches, "text"):
        w = W.Words(data, offs, W.ALNUM)
        found = batch.column(batch.schema.get_field_index("found"))
        hit, wids, rows = [], [], []
        for r in range(batch.num_rows):
            f = found[r].values
            start, wid, check, length = (f.field(c).to_numpy() for c in ("start", "wid", "check", "length"))
            i, j = int(w.first[r]), int(w.first[r + 1])
            mark = np.zeros(j - i, dtype=bool)
            real = []
            for n in np.unique(length):
                own = np.flatnonzero((length == n) & (start >= 0) & (start + n <= j - i))
                if len(own):
                    for hashes, want in ((window_hash, wid), (window_check, check)):
                        there = hashes(w.hash[i:j], int(n)).view(np.int64)
                        own = own[there[start[own]] == want[own]]
                    for s in start[own]:
                        mark[s : s + n] = True
                    real.append(wid[own])
            real = np.unique(np.concatenate(real)) if real else np.empty(0, np.int64)
            if len(real):
                rows.append(r)
                hit.append(int(mark.sum()))
                wids.append(real)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hit, pa.int64()), pa.array(wids, pa.list_(pa.int64()))], ["id", "n_hit", "wids"]
        )


class Index:
    """Windows and probes of a benchmark, and the postings of the probed terms in a corpus."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = 10, rarest: int = 3):
        spark = docs.sparkSession
        self.texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).where("id is not null")
        items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
        rows = items.mapInArrow(_windows(window), "item_id long, wid long, check long, terms array<long>").withColumn("length", F.size("terms"))
        self.windows = cut(rows, "windows")
        places = self.windows.dropDuplicates(["wid"]).select("wid", "check", "length", F.posexplode("terms").alias("offset", "term"))
        places = cut(places.groupBy("wid", "check", "length", "term").agg(F.min("offset").alias("offset")), "places")
        counts = self.texts.mapInArrow(_counts(self._filter(spark, places)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        known = places.join(counts, "term", "left")
        by_rarity = Window.partitionBy("wid").orderBy(F.col("n").asc_nulls_first(), "term")
        ranked = known.withColumn("rank", F.row_number().over(by_rarity)).withColumn("rarest", F.first("n").over(by_rarity))
        probes = ranked.where("rarest is not null").where(F.col("rank") <= rarest)
        self.rarest = rarest
        self.probes = cut(probes.select("wid", "check", "length", "term", "offset", "rank"), "probes")
        postings = self.texts.mapInArrow(_postings(self._filter(spark, self.probes)), "term long, id long, positions array<int>")
        self.postings = cut(postings, "postings")

    @staticmethod
    def _filter(spark, places: DataFrame):
        terms = places.select("term").distinct().limit(FILTER_TERMS + 1).toArrow().column("term").to_numpy()
        return spark.sparkContext.broadcast(np.sort(terms)) if len(terms) <= FILTER_TERMS else None

    def starts(self, slack: int = 0) -> DataFrame:
        """(wid, check, length, id, start): places where the offset-adjusted lists of all probes meet.

        The lists are intersected from the rarest term on: its postings give the starts, and each
        further list is looked up only in the documents that are left. With ``slack`` the starts
        of the other lists may differ from the rarest term's by so many words.
        """
        lists = self.postings.where("term is not null").select("term", "id", "positions")
        lead = self.probes.where("rank = 1").select("term", "wid", "check", "length", "offset")
        met = lists.join(lead, "term").select("wid", "check", "length", "id", "offset", F.explode("positions").alias("position"))
        met = met.select("wid", "check", "length", "id", (F.col("position") - F.col("offset")).alias("start"))
        if not slack:
            met = met.where("start >= 0")
        for rank in range(2, self.rarest + 1):
            probe = self.probes.where(F.col("rank") == rank).select("wid", "term", "offset")
            both = met.join(probe, "wid", "left").join(lists, ["term", "id"], "left")
            here = F.exists("positions", lambda p: F.abs(p - F.col("offset") - F.col("start")) <= slack)
            met = both.where(F.col("term").isNull() | F.coalesce(here, F.lit(False))).select("wid", "check", "length", "id", "start")
        return met

    def phrases(self) -> DataFrame:
        """(id, n_hit, wids): documents with exact occurrences, hit words and their windows."""
        found = self.starts().groupBy("id").agg(F.collect_list(F.struct("start", "wid", "check", "length")).alias("found"))
        return self.texts.join(found, "id").mapInArrow(_verify, "id long, n_hit long, wids array<long>")

    def proximity(self, slack: int) -> DataFrame:
        """(doc_id, item_id): all probes of a window of the item occur within ``slack`` words of their places."""
        near = self.starts(slack).select("wid", "id").distinct()
        return near.join(self.windows.select("wid", "item_id"), "wid").select(F.col("id").alias("doc_id"), "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, rarest: int = 3) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    docs has ``doc_id`` (long) and ``text``, benchmark ``item_id`` (long) and ``text``; other
    columns are not read. Null and empty texts have no words and no windows. Rows with a null
    doc_id and rows that repeat one are judged each. An item without an item_id cannot be named
    and is left out; items that repeat an item_id add up. Empty tables give no hits.
    """
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        # rows get keys of their own, in a table that is written before they are read again
        keyed = cut(docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").alias("own"), "text"), "keyed")
        judged = contamination(keyed.select(F.col("key").alias("doc_id"), "text"), benchmark, window, rarest).withColumnRenamed("doc_id", "key")
        return keyed.select("key", F.col("own").alias("doc_id")).join(judged, "key").drop("key")
    index = Index(docs, benchmark, window, rarest)
    hits = cut(index.phrases(), "hits")
    named = hits.select("id", F.explode("wids").alias("wid")).join(index.windows.select("wid", "item_id").distinct(), "wid")
    items = named.groupBy("id").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    lengths = index.postings.where("term is null").select("id", F.element_at("positions", 1).cast("long").alias("n_words"))
    out = lengths.join(hits.select("id", "n_hit").join(items, "id"), "id", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        items.alias("items"),
    )


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


QUERIES = {"op6_decontamination": op6_decontamination}
SQL = {
    "op6_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, l, array_to_string(w[p:p + l - 1], ' ') AS seq FROM
  (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM b),
dwin AS (SELECT doc_id, p, l, array_to_string(w[p:p + l - 1], ' ') AS seq FROM
  (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM dw, lens WHERE len(w) >= l)),
m AS (SELECT doc_id, p, dwin.l, item_id FROM dwin JOIN b ON dwin.l = b.l AND dwin.seq = b.seq),
h AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON dw.doc_id = h.doc_id LEFT JOIN i ON dw.doc_id = i.doc_id
""",
}
