"""Near-duplicates by simhash: Burkhard-Keller trees over 64-bit fingerprints.

1. A fingerprint takes a majority over the bits of its text's shingle hashes. Documents with
   equal fingerprints form a class, and only distinct fingerprints go on.
2. Shards: if two fingerprints differ in at most ``radius`` bits, they agree in one of radius + 1
   blocks of bits, so each goes to one shard a block, named by the block's first bits. The number
   of bits grows with the counted fingerprints (a shard holds about SHARD of them, up to the whole
   block's width), so work grows with the input and not with its square.
3. A shard is planted as a BK-tree: a child hangs below its parent by its integer Hamming distance
   from it. A shard of more than TREE fingerprints becomes several trees of bounded size. Trees
   are rows of a table. A search follows only the edges within the radius of the distance to the
   node (triangle inequality), for all queries of a block at once.
4. Each tree is searched for its own fingerprints, and trees of one shard for each other's: they
   are broadcast where they were counted to be few, else dealt to pairs. A search yields a star
   for each component that it joins, never its pairs.

Links over the distinct fingerprints give the components. No group is gathered on the driver or
in one task; what grows with the square of a shard beyond TREE (many different fingerprints that
agree in a block) is comparisons, dealt over tasks, not rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import starmap
from math import ceil, log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import words as W
from foliant.llm.components import components
from foliant.llm.groups import sorted_groups
from foliant.llm.storage import cut, small, table

BITS = 64
#: Fingerprints that a shard holds on average, the most of a tree (some 21 bytes each), queries that walk a tree at once.
SHARD, TREE, WALKS = 1024, 4096, 256
#: Trees of split shards that are broadcast: at most some 44 MB.
BROADCAST_TREES = 512


def shingle_hashes(text: bytes, k: int, seed: int) -> np.ndarray:
    """XXH64 of each k words (A-Z lower-cased, joined by a space; all words, if fewer), repeats included."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    m = max(1, len(found) - k + 1)
    spans = starmap(slice, zip(starts[:m].tolist(), ends[-m:].tolist()))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s], seed) for s in spans), np.uint64, m)


def majority(hashes: np.ndarray) -> int:
    """The bits that are 1 in over half of the hashes; 0 of none."""
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[i : i + (1 << 15)], "<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(k: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in W.chunks(batches, "text"):
            raw = data.tobytes()
            got = [majority(shingle_hashes(raw[a:b], k, seed)) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), W.longs(np.array(got, np.uint64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) a row of docs (doc_id, text); null text, or one without words, has fingerprint zero."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(_fingerprints(words, seed), "doc_id long, fp long")


class Tree(NamedTuple):
    """A BK-tree level by level: the children of node i are the nodes first[i] to first[i] + kids[i], and edge is a node's distance from its parent."""

    fp: np.ndarray
    edge: np.ndarray
    first: np.ndarray
    kids: np.ndarray

    def to_bytes(self) -> bytes:
        return b"".join([self.fp.astype("<u8").tobytes(), self.first.astype("<i4").tobytes(), self.kids.astype("<i4").tobytes(), self.edge.astype("u1").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> Tree:
        n = len(raw) // 17
        at = lambda kind, size, lo: np.frombuffer(raw, kind, n, lo * n)
        return cls(at("<u8", 8, 0), at("u1", 1, 16), at("<i4", 4, 8), at("<i4", 4, 12))


def plant(fps: np.ndarray) -> Tree:
    """The tree that inserting distinct fingerprints one by one would give, built a level at a time.

    Of the fingerprints that come to a node over the same distance, the first becomes its child
    and the others go on below that.
    """
    order, edges = [0], [0]
    first, kids = np.zeros(len(fps), np.int32), np.zeros(len(fps), np.int32)
    item = np.arange(1, len(fps))
    node = np.zeros(len(item), np.int64)  # place in ``order`` of the node each item has come to
    while len(item):
        dist = np.bitwise_count(fps[item] ^ fps[np.array(order)[node]]).astype(np.int64)
        by = np.lexsort((item, dist, node))
        item, node, dist = item[by], node[by], dist[by]
        new = np.r_[True, (node[1:] != node[:-1]) | (dist[1:] != dist[:-1])]
        base = len(order)
        place = base + np.cumsum(new) - 1
        order += item[new].tolist()
        edges += dist[new].tolist()
        parents, at, n = np.unique(node[new], return_index=True, return_counts=True)
        first[parents], kids[parents] = base + at, n
        item, node = item[~new], place[~new]
    return Tree(fps[np.array(order)], np.array(edges, np.uint8), first, kids)


def search(tree: Tree, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) places of all nodes within the radius, for some queries at a time."""
    for lo in range(0, len(queries), WALKS):
        q = np.arange(lo, min(lo + WALKS, len(queries)))
        node = np.zeros(len(q), np.int64)
        found = []
        while len(q):
            dist = np.bitwise_count(queries[q] ^ tree.fp[node]).astype(np.int16)
            hit = dist <= radius
            found.append((q[hit], node[hit]))
            n = tree.kids[node].astype(np.int64)
            up = np.repeat(np.arange(len(q)), n)
            child = np.arange(len(up)) - np.repeat(np.cumsum(n) - n, n) + tree.first[node][up]
            near = np.abs(tree.edge[child].astype(np.int16) - dist[up]) <= radius
            q, node = q[up[near]], child[near]
        yield np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b): all of a component have its smallest place."""
    apart = label[a] != label[b]
    a, b = a[apart], b[apart]
    while len(a):
        low = np.minimum(label[a], label[b])
        for x in (label[a], label[b]):
            np.minimum.at(label, x, low)
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _stars(radius: int) -> Callable:
    """Rows (tree, other): links of fingerprints that connect each component joined by a search of one for the other's nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got_a, got_b = [], []
            for raw, other in zip(batch.column(0), batch.column(1)):
                tree = Tree.from_bytes(raw.as_py())
                own = not other.is_valid
                queries = tree.fp if own else Tree.from_bytes(other.as_py()).fp
                every = tree.fp if own else np.r_[tree.fp, queries]
                label = np.arange(len(every))
                for q, node in search(tree, queries, radius):
                    label = _joined(label, node, q if own else q + len(tree.fp))
                moved = np.flatnonzero(label != np.arange(len(every)))
                got_a.append(every[moved])
                got_b.append(every[label[moved]])
            if got_a:
                yield pa.RecordBatch.from_arrays([W.longs(np.concatenate(got_a).astype(np.uint64)), W.longs(np.concatenate(got_b).astype(np.uint64))], ["a", "b"])

    return run


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, part): one tree each."""
    for g in sorted_groups(batches, ("shard", "part")):
        column = lambda c: g.column(g.schema.get_field_index(c))  # noqa: E731, B023
        tree = plant(column("fp").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([column("shard")[:1], column("part")[:1], column("parts")[:1], pa.array([tree.to_bytes()], pa.binary())], ["shard", "part", "parts", "tree"])


def shards(fps: DataFrame, radius: int, count: int) -> DataFrame:
    """(shard, fp): each fingerprint in radius + 1 shards, one a block of its bits."""
    blocks = radius + 1
    edges = [BITS * b // blocks for b in range(blocks + 1)]
    used = max(0, ceil(log2(max(count, 1) / SHARD)))
    names = []
    for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
        width = min(used, hi - lo)
        value = F.shiftrightunsigned("fp", hi - width).bitwiseAND(F.lit((1 << width) - 1)) if width else F.lit(0).cast("long")
        names.append(value * blocks + b)
    return fps.select(F.explode(F.array(*names)).alias("shard"), "fp")


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose components are those of all pairs within the radius."""
    keyed = shards(fps, radius, fps.count())
    sizes = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = keyed.join(small(cut(sizes, "shards")), "shard").withColumn("parts", F.ceil(F.col("n") / TREE).cast("long"))
    dealt = dealt.select("shard", F.pmod(F.xxhash64("fp"), "parts").alias("part"), "parts", "fp")
    groups = dealt.repartition("shard", "part").sortWithinPartitions("shard", "part", "fp")
    trees = cut(groups.mapInArrow(_planted, "shard long, part long, parts long, tree binary"), "trees")
    alone = trees.select("tree", F.lit(None).cast("binary").alias("other"))

    many = trees.where("parts > 1")
    if many.limit(BROADCAST_TREES + 1).count() <= BROADCAST_TREES:
        meets = many.repartition("shard", "part").select("shard", F.col("part").alias("i"), "tree")
        meets = meets.join(F.broadcast(many.select("shard", F.col("part").alias("j"), F.col("tree").alias("other"))), "shard").where("i < j")
    else:
        each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")
        pairs = many.select("shard", "part", each, "tree").where("part <> with")
        left = pairs.where("part < with").select("shard", F.col("part").alias("i"), F.col("with").alias("j"), "tree")
        right = pairs.where("part > with").select("shard", F.col("with").alias("i"), F.col("part").alias("j"), F.col("tree").alias("other"))
        meets = left.join(right, ["shard", "i", "j"])
    return alone.union(meets.select("tree", "other")).mapInArrow(_stars(radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row a row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    A-Z is lower-cased and words are split at ASCII white space. Null text is empty text. Texts
    without words have fingerprint zero and are linked like any other. Rows that repeat a doc_id
    are documents of their own, each linked by its own text. A row without a doc_id has its
    fingerprint and no component. Columns beyond those two, whatever their names, are not read.
    An empty table gives an empty one.
    """
    prints = cut(fingerprints(docs, words), "fingerprints")
    classes = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    label = components(cut(links(classes.select("fp"), radius), "links")).select(F.col("id").alias("fp"), "comp")
    linked = classes.join(label, "fp")
    lows = linked.groupBy("comp").agg(F.min("low").alias("least"))
    moved = linked.select("fp", "comp").join(lows, "comp").select("fp", "least")
    # written before the join, which lets Spark split a class of very many copies
    member = cut(classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id")), "class-components")
    out = prints.join(member, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash_bk_trees(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op12_simhash_bk_trees": op12_simhash_bk_trees}
#: XXH64 has no function in DuckDB; tests hold the query against brute force over all pairs.
SQL: dict[str, str] = {}
