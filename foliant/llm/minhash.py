"""Near-duplicate documents by a multi-index Hamming join of b-bit minhash signatures.

1. A document's set holds the hashes of its distinct word shingles. Documents with equal sets
   (same size and 128-bit fingerprint) form a class; from here on a class is its smallest id.
2. A signature has K = 64 positions of b = 16 bits. Two signatures differ in D positions.
   They are cut into 16 chunks of 4 positions. If D <= 31, some chunk differs in at most
   31 // 16 = 1 position (pigeonhole), so it is enough to enumerate the allowed chunk error:
   each chunk yields 4 keys, one with each position left out. All pairs with D <= 31 share a key.
   For similarity 0.75, D is binomial(64, 1/4); the chance of D > 31 is below 1 in 50,000.
3. First each key names its smallest member and the others are compared with it, a star, which
   is linear in the members. What these links leave apart below one key is compared by
   signature in blocks of bounded size dealt over tasks; a block yields a spanning forest of the
   components that lie within the signature distance, never its pairs.
4. The forests join components to clusters. Inside a cluster, all documents but those of its
   largest component are compared with all, again in dealt blocks, on the full shingle sets;
   a block yields a spanning forest of the links it confirmed.

All links are confirmed on full sets, and no link between different components is lost. No key,
class, cluster or component is gathered in one task or on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import words as W
from foliant.llm.components import components
from foliant.llm.groups import sorted_groups
from foliant.llm.storage import cut, table

POSITIONS, BITS, CHUNKS = 64, 16, 16
WIDTH = POSITIONS // CHUNKS
#: Largest signature distance that the index guarantees to find: 2 errors in every chunk, less one.
RADIUS = 2 * CHUNKS - 1
#: Rows of one side of a block of pairs.
BLOCK = 256

_A, _B = W.constants(POSITIONS, 21), W.constants(POSITIONS, 22)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles (all words, if fewer)."""
    w = W.Words(data, offs, W.FOLDED)
    g = W.grams(w.hash, k)
    for i, j in zip(w.first[:-1], w.first[1:]):
        if j - i >= k:
            yield np.unique(g[i : j - k + 1])
        elif j > i:
            yield W.grams(w.hash[i:j], int(j - i), seed=100 + int(j - i))
        else:
            yield np.empty(0, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, ((shingles[i : i + 4096, None] ^ _B) * _A).min(axis=0))
    return (W.mix(low) >> np.uint64(64 - BITS)).astype("<u2")


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, CHUNKS * WIDTH) keys: chunk number, the position left out, and the other symbols."""
    s = signatures.astype(np.int64).reshape(len(signatures), CHUNKS, WIDTH)
    out = np.empty((len(signatures), CHUNKS, WIDTH), dtype=np.int64)
    for left_out in range(WIDTH):
        key = np.arange(CHUNKS, dtype=np.int64)[None, :] * WIDTH + left_out
        for p in range(WIDTH):
            if p != left_out:
                key = (key << BITS) | s[:, :, p]
        out[:, :, left_out] = key
    return out.reshape(len(signatures), CHUNKS * WIDTH)


def _sign(k: int):
    def run(batches):
        for batch, data, offs in W.chunks(batches, "text"):
            size, f1, f2, sig = [], [], [], []
            for s in shingle_sets(data, offs, k):
                size.append(len(s))
                f1.append(int(s.sum(dtype=np.uint64)) if len(s) else 0)
                f2.append(int(W.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) if len(s) else 0)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), W.longs(np.array(f1, np.uint64)), W.longs(np.array(f2, np.uint64)), pa.array(sig, pa.binary())],
                ["id", "n", "f1", "f2", "sig"],
            )

    return run


def _keys(batches):
    for batch in batches:
        if batch.num_rows:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(batch.num_rows, POSITIONS)
            keys = chunk_keys(sigs)
            flat = pa.array(keys.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1])), flat], ["id", "key"])


def _near_signatures(batches):
    """Keeps the rows (a, b, sig_a, sig_b) within RADIUS."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, POSITIONS) for c in (2, 3))
            keep = np.flatnonzero((x != y).sum(axis=1) <= RADIUS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], ["a", "b"])


class _Forest:
    """Union-find over the few labels of a group; ``join`` tells whether two were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _candidate_forest(batches):
    """Rows of (key, i, j): comp, block, sig. Yields pairs of components that signatures within
    RADIUS connect, a spanning forest of them for each group."""
    for g in sorted_groups(batches, ("key", "i", "j")):
        comp, block, i, j = (g.column(g.schema.get_field_index(c)).to_numpy() for c in ("comp", "block", "i", "j"))
        if comp.min() == comp.max():
            continue
        sigs = np.frombuffer(b"".join(g.column(g.schema.get_field_index("sig")).to_pylist()), "<u2").reshape(-1, POSITIONS)
        right = np.flatnonzero(block == j[0])
        forest, got = _Forest(), []
        for x in np.flatnonzero(block == i[0]):
            y = right[comp[right] != comp[x]]
            y = y[(sigs[y] != sigs[x]).sum(axis=1) <= RADIUS]
            for c in np.unique(comp[y]).tolist():
                if forest.join(int(comp[x]), c):
                    got.append((int(comp[x]), c))
        if got:
            a, b = zip(*got)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets xs with the sets ys."""
    if len(xs) * len(ys) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in ys] for x in xs])
    flat = np.concatenate([*xs, *ys])
    row = np.repeat(np.arange(len(xs) + len(ys)), [len(s) for s in (*xs, *ys)])
    values, code = np.unique(flat, return_inverse=True)
    counts = np.bincount(code, minlength=len(values))
    code = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[code]
    row, code = row[code >= 0], code[code >= 0]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((len(xs), len(ys)), dtype=np.float32)
    total = int(code[-1]) + 1 if len(code) else 0
    for lo in range(0, total, 4096):
        a, b = np.searchsorted(code, [lo, lo + 4096])
        dense = np.zeros((len(xs) + len(ys), min(4096, total - lo)), dtype=np.float32)
        dense[row[a:b], code[a:b] - lo] = 1
        out += dense[: len(xs)] @ dense[len(xs) :].T
    return out.astype(np.int64)


def _exact_links(k: int, percent: int):
    """Rows of (cluster, i, j): id, comp, side, text. Yields links of different components that
    hold on the full sets, a spanning forest of them for each group."""

    def run(batches):
        for g in sorted_groups(batches, ("cluster", "i", "j")):
            ids, comp, side = (g.column(g.schema.get_field_index(c)).to_numpy() for c in ("id", "comp", "side"))
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            sets = list(shingle_sets(*W.utf8(g.column(g.schema.get_field_index("text"))), k))
            size = np.array([len(s) for s in sets])
            both = overlaps([sets[r] for r in left], [sets[r] for r in right])
            near = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
            near &= comp[left][:, None] != comp[right][None, :]
            forest, got = _Forest(), []
            for x, y in zip(*np.nonzero(near)):
                x, y = left[x], right[y]
                if forest.join(int(comp[x]), int(comp[y])):
                    got.append((int(ids[x]), int(ids[y])))
            if got:
                a, b = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _confirm(k: int, percent: int):
    def run(batches):
        for batch in batches:
            step = max(1, int(batch.num_rows * W.CHUNK_BYTES / max(1, batch.nbytes)))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                xs, ys = (shingle_sets(*W.utf8(part.column(c)), k) for c in (2, 3))
                keep = []
                for r, (x, y) in enumerate(zip(xs, ys)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both) > 0:
                        keep.append(r)
                take = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take)], ["a", "b"])

    return run


def _blocks(rows) -> Column:
    """Blocks of at most about BLOCK rows each."""
    return F.ceil((F.col(rows) if isinstance(rows, str) else rows) / BLOCK).cast("int")


def _repeated_ids(rows: DataFrame) -> bool:
    return not rows.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()


def _by_row(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """``near_duplicates`` of rows (id, text) of which some repeat an id: each under a key of its own, then named by ids."""
    keyed = cut(rows.where("id is not null").select(F.monotonically_increasing_id().alias("key"), "id", "text"), "keyed")
    one = near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), words, percent).withColumnRenamed("doc_id", "key")
    named = cut(one.join(keyed.select("key", "id"), "key").select("id", "n_shingles", "component_id"), "named")
    least = cut(named.groupBy("component_id").agg(F.min("id").alias("least")), "least-ids")
    out = named.join(least, "component_id").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), (F.col("id") == F.col("least")).alias("kept"))
    nameless = near_duplicates(rows.where("id is null").select(F.col("id").alias("doc_id"), "text"), words, percent)
    return out.union(nameless)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept (see the module).

    docs has ``doc_id`` (long) and ``text``; other columns, whatever their names, are not read.
    Null text is empty text: n_shingles 0, linked with nothing. Rows with a null doc_id have no
    identity to link by: each is kept, with a null component_id. Rows that repeat a doc_id are
    documents of their own, each linked by its own text; kept then holds for each of them whose
    component has no smaller doc_id. Equal similarity counts as linked (>=). An empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    if _repeated_ids(rows):
        return _by_row(rows, words, percent)
    every = cut(rows.mapInArrow(_sign(words), "id long, n long, f1 long, f2 long, sig binary"), "signatures")
    texts, signed, nameless = rows.where("id is not null"), every.where("id is not null"), every.where("id is null")

    classes = cut(signed.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "classes")
    keyed = classes.select("rep", "sig").mapInArrow(_keys, "id long, key long")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    held = cut(keyed.join(shared, "key"), "keys")
    busy = cut(held.select("id").distinct(), "busy")
    sigs = cut(classes.select(F.col("rep").alias("id"), "sig").join(busy, "id"), "busy-signatures")
    text = cut(texts.join(busy, "id"), "busy-texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(text.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        with_b = with_a.join(text.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        return with_b.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(words, percent), "a long, b long")

    def signature_near(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
        with_b = with_a.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
        return with_b.select("a", "b", "sig_a", "sig_b").mapInArrow(_near_signatures, "a long, b long")

    # a star for each key: its members against its smallest
    leaders = held.groupBy("key").agg(F.min("id").alias("b"))
    stars = held.join(leaders, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    links = cut(confirmed(signature_near(stars)), "confirmed")
    label = components(links)

    # what is still apart below one key: candidate pairs of components, then clusters of those
    marked = held.select("key", "id").join(label, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = marked.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("members")).where("low <> high")
    dealt = marked.join(mixed.select("key", _blocks("members").alias("blocks")), "key").join(sigs, "id")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "comp", "block", "sig")
    near = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_candidate_forest, "a long, b long").distinct()
    cluster = components(near).select(F.col("id").alias("comp"), F.col("comp").alias("cluster"))

    # within a cluster: all documents outside its largest component against all documents
    inside = busy.join(label, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")).join(cluster, "comp")
    inside = cut(inside, "clustered")
    sizes = inside.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.sum("n").alias("n"), F.max("n").alias("largest"))
    placed = inside.join(sizes, "cluster").join(text, "id")
    placed = placed.withColumn("lefts", _blocks(F.col("n") - F.col("largest"))).withColumn("rights", _blocks("n"))
    mine = lambda blocks: F.pmod(F.xxhash64("id"), blocks).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    as_left = placed.where("comp <> major").select("cluster", mine("lefts").alias("i"), each("rights").alias("j"), "id", "comp", F.lit(0).alias("side"), "text")
    as_right = placed.select("cluster", each("lefts").alias("i"), mine("rights").alias("j"), "id", "comp", F.lit(1).alias("side"), "text")
    dealt = as_left.union(as_right).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    links = links.union(dealt.mapInArrow(_exact_links(words, percent), "a long, b long"))
    label = components(links)

    # written before the join, which lets Spark split a class of very many copies
    member = classes.select("n", "f1", "f2", "rep").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    member = cut(member.select("n", "f1", "f2", F.coalesce("comp", "rep").alias("component")), "class-components")
    out = signed.join(member, ["n", "f1", "f2"], "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    out = out.union(nameless.select("id", "n", F.lit(None).cast("long")))
    kept = F.coalesce(F.col("component") == F.col("id"), F.lit(True))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_minhash_near_dedup": op2_minhash_near_dedup}
#: Exact similarities of all pairs that share a shingle, and their transitive closure: for small tables.
SQL = {
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[p:p + 4], ' ') FOR p IN range(1, len(w) - 3)]) END AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) + any_value(b.n) AS n FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT g.doc_id, len(g)::BIGINT AS n_shingles, least(g.doc_id, coalesce(low, g.doc_id)) AS component_id, g.doc_id <= coalesce(low, g.doc_id) AS kept
FROM g LEFT JOIN m ON g.doc_id = m.a
""",
}
