"""Exact top-k inner products over norm-sorted blocks with rotated partial sums.

1. Vectors become integer vectors and are range-partitioned by descending length into blocks.
2. A rotation to the corpus's singular directions comes from its d x d Gram matrix, summed in
   Spark; only that matrix reaches the driver. In rotated order the first coordinates carry most
   of an inner product. It covers the first MAX_DIM components; later ones of longer vectors
   count to the rest.
3. Blocks are taken in rounds, from the longest vectors on, each round four times as many as
   before. After a round a query's bound is its k-th best score so far. A block whose greatest
   length times the query's is below that bound cannot matter, nor can any later block: when no
   query block needs the next one, the search ends.
4. A round is dealt as (query block, piece of a vector block) pairs of bounded size. In a pair, the partial
   sum over the first coordinates plus the product of the residual lengths (Cauchy-Schwarz)
   bounds each score; only vectors that reach the query's bound are scored in full, in integers:
   by floats where the lengths show that these are exact, else, of the vectors whose float score
   may be among the k best, in Python's integers.

Where lengths are equal and directions random no bound prunes; a query then meets every vector,
as it must for an exact answer, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.storage import cut, table

#: Rows of a vector block and of a query block.
VECTORS, QUERIES_PER_BLOCK = 1024, 2048
#: Most vector blocks, which the driver lists (beyond that many a block is met in pieces), and growth of a round.
MAX_BLOCKS, GROWTH = 8192, 4
#: Components that the rotation and the dense blocks cover.
MAX_DIM = 2048
SCALE = 256
#: From this size on, a double times SCALE is an integer.
WHOLE = float(1 << 44)
#: Float sums of integers are exact where the product of the lengths is below this.
EXACT = float(1 << 52)
LARGEST = float(np.finfo(float).max)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Rows of a list column as float64, short ones filled with zeros, and what long ones have beyond ``dim``."""
    out = np.zeros((len(column), dim))
    n = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    begin = np.cumsum(n) - n
    rows = np.repeat(np.arange(len(column)), n)
    at = np.arange(len(rows)) - np.repeat(begin, n)
    inside = at < dim
    out[rows[inside], at[inside]] = flat[inside]
    return out, {int(r): flat[begin[r] + dim : begin[r] + n[r]] for r in np.flatnonzero(n > dim)}


def _gram(dim: int):
    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x, _ = _matrix(batch.column(0), dim)
            x = x[np.abs(x).max(axis=1, initial=0.0) < 1e60]  # the rotation only speeds up, and must be finite
            total += x.T @ x
        i, j = np.divmod(np.arange(dim * dim), dim)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.reshape(-1))], ["i", "j", "v"])

    return run


def _integers(row: np.ndarray) -> list[int]:
    """The integer vector of a row of multiples of 1 / SCALE."""
    return [int(v) * SCALE if abs(v) >= WHOLE else int(v * SCALE) for v in row.tolist()]


def _order_key(score: int) -> str | None:
    """None for a score of 64 bits; for others text that sorts as the scores do, below (-) or above (.) all of these."""
    if -(1 << 63) <= score < 1 << 63:
        return None
    digits = f"{abs(score):x}"
    if score > 0:
        return f".{len(digits):06}{digits}"
    return f"-{999999 - len(digits):06}" + digits.translate(_FLIP)


_FLIP = str.maketrans("0123456789abcdef", "fedcba9876543210")


def _search(k: int, dim: int, rotation: np.ndarray, head: int):
    """Rows of each (query, vector): score (null beyond 64 bits), key (its place then), low (a float not above it)."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in _RESULT]
        if queries.num_rows and vectors.num_rows:
            (q, q_more), (x, x_more) = (_matrix(t.column("v").combine_chunks(), dim) for t in (queries, vectors))
            qid, vid = (t.column("vec_id").to_numpy() for t in (queries, vectors))
            q_row, x_row = (t.column("rid").to_numpy() for t in (queries, vectors))
            bound = queries.column("bound").to_numpy(zero_copy_only=False).astype(float)
            unit = float(SCALE) ** 2
            with np.errstate(over="ignore", invalid="ignore"):
                qr, xr = q @ rotation, x @ rotation
                rest_q, rest_x = (_length(m[:, head:], more) for m, more in ((qr, q_more), (xr, x_more)))
                size = (_length(q, q_more)[:, None] * _length(x, x_more)[None, :]) * unit
                upper = (qr[:, :head] @ xr[:, :head].T + rest_q[:, None] * rest_x[None, :]) * unit
                # where floats overflow, nothing is left out
                may = ~(upper + (1e-9 * size + 1e-6) < bound[:, None]) & (x_row[None, :] != q_row[:, None])
            for r in np.flatnonzero(may.any(axis=1)):
                c = np.flatnonzero(may[r])
                with np.errstate(over="ignore", invalid="ignore"):
                    s = x[c] @ q[r]
                    if r in q_more:
                        s = s + [_dot(q_more[r], x_more.get(i)) for i in c.tolist()]
                    s = s * unit
                    off = np.where(size[r, c] < EXACT, 0.0, 1e-9 * size[r, c])
                    low = np.nan_to_num(s - off, nan=-np.inf, posinf=-np.inf, neginf=-np.inf)
                    if len(c) > k:
                        keep = np.flatnonzero(~(s + off < np.partition(low, len(low) - k)[len(low) - k]))
                        c, s, off = c[keep], s[keep], off[keep]
                order = np.lexsort((x_row[c], vid[c]))
                c, s, off = c[order], s[order], off[order]
                if (off == 0.0).all():
                    best = np.argsort(-s, kind="stable")[:k]
                    found = [int(v) for v in s[best]]
                else:
                    whole = lambda m, more, i: _integers(np.r_[m[i], more[i]] if i in more else m[i])
                    mine = whole(q, q_more, r)
                    exact = [sum(a * b for a, b in zip(mine, whole(x, x_more, i))) for i in c.tolist()]
                    best = np.array(sorted(range(len(c)), key=lambda i: (-exact[i], i))[:k], dtype=int)
                    found = [exact[i] for i in best]
                keys = [_order_key(v) for v in found]
                values = ([int(q_row[r])] * len(best), [int(qid[r])] * len(best), vid[c[best]].tolist(), x_row[c[best]].tolist(), [v if key is None else None for v, key in zip(found, keys)], keys, [_below(v) for v in found])
                for column, more in zip(out, values):
                    column += more
        return pa.table({n: pa.array(v, t) for (n, t), v in zip(_RESULT, out)})

    return run


_RESULT = (("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("rid", pa.int64()), ("score", pa.int64()), ("key", pa.string()), ("low", pa.float64()))


def _length(m: np.ndarray, more: dict[int, np.ndarray]) -> np.ndarray:
    squares = (m**2).sum(axis=1)
    for r, v in more.items():
        squares[r] += (v**2).sum()
    return np.sqrt(squares)


def _dot(a: np.ndarray, b: np.ndarray | None) -> float:
    return 0.0 if b is None else float(a[: len(b)] @ b[: len(a)])


def _below(score: int) -> float:
    """A float not above the score."""
    if abs(score) < EXACT:
        return float(score)
    if score < -LARGEST:
        return -np.inf
    near = float(min(score, int(LARGEST)))
    return float(np.nextafter(near, -np.inf))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, head: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query.

    vectors has ``vec_id`` (long) and ``embedding`` (array of numbers); other columns are not
    read. Queries are the rows whose vec_id is divisible by ``every``; candidates are all other
    rows. Rows with a null vec_id, a null vector, a null or non-finite component take no part;
    all others do, however large. A score beyond 64 bits has its exact place in the ranks, but is
    given as null. Shorter vectors count as filled up with zeros; an empty one scores 0. Rows
    that repeat a vec_id are queries and candidates of their own, also for each other. Equal
    scores go to the smaller vec_id. Fewer than k candidates give all. An empty table gives an
    empty one.
    """
    spark = vectors.sparkSession
    # components as multiples of 1 / SCALE: exact in doubles, and finite whenever the input is
    d = lambda x: x.cast("double")
    whole = F.transform("embedding", lambda x: F.when(F.abs(d(x)) < WHOLE, F.floor(F.lit(SCALE) * d(x)).cast("double") / SCALE).otherwise(d(x)))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(d(x)) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null").where(fine)
    rows = rows.select("vec_id", whole.alias("v"), F.monotonically_increasing_id().alias("rid"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = cut(rows.withColumn("norm", length), "vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    dim = min(facts["dim"] or 1, MAX_DIM)
    cells = rows.select("v").mapInArrow(_gram(dim), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    gram = np.zeros((dim, dim))
    gram[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("v").to_numpy()
    rotation = np.linalg.eigh(gram)[1][:, ::-1]

    blocks = min(max(1, -(-facts["n"] // VECTORS)), MAX_BLOCKS)
    dealt = rows.repartitionByRange(blocks, F.col("norm").desc(), F.col("rid")).withColumn("part", F.spark_partition_id())
    dealt = cut(dealt, "norm-sorted")
    # at most as many rows as blocks; their numbers follow the lengths downwards
    found = dealt.groupBy("part").agg(F.max("norm").alias("reach"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    reach = [(r["part"], r["reach"]) for r in found]
    # where blocks are as many as they may be, a block is met in pieces of bounded size
    pieces = max([-(-r["n"] // (2 * VECTORS)) for r in found], default=1)
    piece = F.pmod(F.xxhash64("rid"), F.lit(pieces)).cast("int").alias("piece")
    query_blocks = max(1, -(-facts["queries"] // QUERIES_PER_BLOCK))
    # queries of like lengths stand together, so that one with a weak bound holds up few others
    asked = dealt.where(F.col("vec_id") % every == 0).select("rid", "vec_id", "v", "norm")
    if query_blocks > 1:
        asked = asked.repartitionByRange(query_blocks, F.col("norm").desc(), F.col("rid"))
    # one partition is not an exchange, so its number would be that of the files read
    asked = cut(asked.withColumn("block", F.spark_partition_id() if query_blocks > 1 else F.lit(0)), "queries")
    search = _search(k, dim, rotation, min(head, dim))
    order = Window.partitionBy("query").orderBy(F.coalesce(F.substring("key", 1, 1), F.lit(".")).desc(), F.col("key").desc_nulls_last(), F.col("score").desc(), "vec_id", "rid")
    result = "query long, query_id long, vec_id long, rid long, score long, key string, low double"

    best = spark.createDataFrame([], f"{result}, rank int")
    known = asked.withColumn("bound", F.lit(float("-inf")))
    lo, width = 0, 1
    while lo < len(reach):
        parts = reach[lo : lo + width]
        # a query block needs the vector blocks whose greatest length reaches its least demand
        demand = F.when(F.col("bound") > 0, F.try_divide(F.col("bound") / SCALE**2, F.col("norm"))).otherwise(F.lit(0.0))
        met = F.filter(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(r * (1 + 1e-9) + 1e-6 / SCALE).alias("reach")) for p, r in parts)), lambda x: x["reach"] >= F.col("need"))
        plan = cut(known.groupBy("block").agg(F.min(demand).alias("need")).select("block", F.explode(met).alias("p")).select("block", "p.part"), "block-pairs")
        if plan.isEmpty():
            break
        left = known.join(plan, "block").withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).select("block", "part", "piece", "rid", "vec_id", "v", "bound")
        right = dealt.join(plan, "part").select("block", "part", piece, "rid", "vec_id", "v")
        found = left.groupBy("block", "part", "piece").cogroup(right.groupBy("block", "part", "piece")).applyInArrow(search, result)
        best = cut(best.drop("rank").union(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        bounds = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("bound")).where(F.col("n") >= k)
        known = asked.join(bounds.select(F.col("query").alias("rid"), "bound"), "rid", "left").fillna(float("-inf"), ["bound"])
        lo, width = lo + width, width * GROWTH
    return best.select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_exact_top_k": op7_exact_top_k}
SQL = {
    "op7_exact_top_k": """
WITH v AS (SELECT vec_id, row_number() OVER () AS rid, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid AS query, q.vec_id AS query_id, c.vec_id, c.rid, list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.rid <> q.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, rid)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
