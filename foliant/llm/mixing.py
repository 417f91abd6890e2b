"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only.

1. Targets: sources by code point (null last) weigh 5, 2, 1, 5, 2, 1, ...; a target stops at
   three times its source's size and the excess goes to the others by weight (water filling:
   sources sorted by the level at which they stop, with running sums).
2. Slots: slot i of ``block`` tokens has the point u = frac(i / golden ratio), as an integer
   fraction of 2^32. u is mapped through the cumulative target shares to a source.
   Any stretch of n slots gives a source its share of n up to a few slots.
3. Ranks: the k-th slot of a source takes the k-th block of its shuffled token stream.
4. Blocks: a source's documents in the order of an md5 of their id form a stream, read up to
   three times over and cut into blocks of equal tokens. Slots join blocks on (source, rank).
5. Remainder: a source's last slot is cut at its target, and ranks that the schedule did not
   reach are added after its end, so small sources are neither lost nor rounded to whole slots.

Ranks and stream offsets are running sums. They are taken in two levels, within buckets and
over the buckets of a source, with about the square root of the rows on each level, so no task
holds a source however large it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.storage import cut, table

WEIGHTS = (5, 2, 1)
EPOCHS = 3
WORDS = r"[^\x20\x09-\x0D]+"
#: 2^32 / golden ratio, odd; the multiples of it modulo 2^32 are the low-discrepancy points.
GOLDEN, UNIT = 2654435769, 1 << 32
#: Cells of [0, 1) over which slots are matched with shares.
CELLS = 4096


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with sid (1, 2, ... in source order) and target. One row a source; null is one."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    w = sizes.withColumn("sid", F.row_number().over(order))
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") - 1) % len(WEIGHTS) + 1).cast("double"))
    w = w.withColumn("cap", EPOCHS * F.col("source_size"))
    rising = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), "sid")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("turn", F.row_number().over(rising)).withColumn("level", level)
    free = F.col("level") * F.col("weight") <= F.col("cap")
    stop = F.min(F.when(free, F.struct("turn", "level"))).over(every)["level"]
    cap = F.col("cap").cast("double")
    return w.withColumn("target", F.least(cap, F.coalesce(stop * F.col("weight"), cap))).select("source", "sid", "source_size", "target")


def _running(df: DataFrame, key: str, bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the key, in (bucket, order), in two levels."""
    sums = df.groupBy(key, bucket).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
    within = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(offsets, [key, bucket]).withColumn(out, F.col("_before") + F.col("_within")).drop("_before", "_within")


def slot_schedule(sources: DataFrame, total: int, slots: int) -> DataFrame:
    """(sid, slot, rank): slot i goes to the source that holds its point, as that source's rank-th slot from 0."""
    spark = sources.sparkSession
    span = Window.partitionBy(F.lit(1)).orderBy("sid")
    upto = F.sum("target").over(span.rowsBetween(Window.unboundedPreceding, 0))
    high = F.least(F.ceil(upto / max(total, 1) * UNIT).cast("long"), F.lit(UNIT))
    shares = sources.select("sid", high.alias("hi")).select("sid", F.coalesce(F.lag("hi").over(span), F.lit(0)).alias("lo"), "hi")
    # both sides are cut into cells of [0, 1) and compared inside a cell
    width = UNIT // CELLS
    cells = shares.where("lo < hi").withColumn("cell", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"id % {UNIT} * {GOLDEN} % {UNIT}").alias("u"))
    drawn = points.withColumn("cell", F.expr(f"u div {width}")).join(cells, "cell").where("u >= lo and u < hi")
    step = max(1, int(slots**0.5))
    drawn = drawn.select("sid", "slot", F.expr(f"slot div {step}").alias("_bucket"), F.lit(1).alias("_one"))
    return _running(drawn, "sid", "_bucket", ["slot"], "_one", "rank").select("sid", "slot", "rank")


def _plan(rows: DataFrame, block: int | None, seed: str) -> tuple[DataFrame, DataFrame]:
    """(stream, pieces) of rows (key, doc_id, source, size).

    stream has a row a document, with sid, source_size, target and its place in the source's
    stream; pieces has a row for each stretch of a document that a slot takes: sid, place, slot,
    rank, start (word of the document), words.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = cut(rows.select("key", "doc_id", "source", "size", order.alias("_order")), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sources).withColumn("goal", F.round("target").cast("long"))
    sources = cut(sources, "sources")
    count, total = sized.count(), sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    block = block or max(1, total // max(1 << 15, count // 8))
    slots = -(-total // block)
    schedule = exact_slots(slot_schedule(sources, total, slots), sources, slots, block)

    # documents -> their stretch of the source's shuffled stream -> pieces of equal-token blocks
    named = sources.withColumnRenamed("source", "_source")
    stream = sized.join(named, sized["source"].eqNullSafe(named["_source"])).drop("_source")
    bucket = F.expr(f"cast(conv(substring(_order, 1, 7), 16, 10) as bigint) * {max(1, int(count**0.5))} div {1 << 28}")
    stream = cut(_running(stream.withColumn("_bucket", bucket), "sid", "_bucket", ["_order", "doc_id", "size", "key"], "size", "place"), "stream")
    pieces = stream.where("size > 0").select("sid", "place", "size", "source_size", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))).alias("epoch"))
    pieces = pieces.select("sid", "place", "size", (F.col("epoch") * F.col("source_size") + F.col("place")).alias("at"))
    pieces = pieces.withColumn("rank", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})"))).join(schedule, ["sid", "rank"])
    first = F.greatest(F.col("at"), F.col("rank") * block)
    last = F.least(F.col("at") + F.col("size"), F.col("rank") * block + F.col("length"))
    pieces = pieces.select("sid", "place", "slot", "rank", (first - F.col("at")).alias("start"), (last - first).alias("words")).where("words > 0")
    return stream, pieces


def exact_slots(schedule: DataFrame, sources: DataFrame, slots: int, block: int) -> DataFrame:
    """(sid, rank, slot, length): the schedule with each source brought to its target in words.

    A source needs goal / block slots, the last of them in part. What the schedule drew beyond
    that goes; ranks that it did not reach (of a source below one slot, say) follow after its end.
    """
    need = sources.where("goal > 0").select("sid", "goal", F.expr(f"(goal + {block} - 1) div {block}").alias("need"))
    drawn = schedule.groupBy("sid").agg(F.count(F.lit(1)).alias("drawn"))
    late = need.join(drawn, "sid", "left").fillna(0, ["drawn"]).where("drawn < need")
    late = late.select("sid", F.explode(F.expr("sequence(drawn, need - 1)")).alias("rank"), "drawn").select("sid", (F.lit(slots) + F.col("rank") - F.col("drawn")).alias("slot"), "rank")
    rows = schedule.select("sid", "slot", "rank").union(late).join(need, "sid").where("rank < need")
    return rows.select("sid", "rank", "slot", F.least(F.lit(block), F.col("goal") - F.col("rank") * block).alias("length"))


def _sized(docs: DataFrame, key) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(key.alias("key"), "doc_id", "source", size.alias("size"))


def _totals(stream: DataFrame, pieces: DataFrame) -> DataFrame:
    taken = pieces.groupBy("sid", "place").agg(F.sum("words").alias("_taken"), F.min("slot").alias("_slot"))
    # documents of size 0 share their place with the next one
    amount = F.when(F.col("size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return stream.join(taken, ["sid", "place"], "left").withColumn("taken", amount).withColumn("first_slot", F.when(F.col("taken") > 0, F.col("_slot")))


def mix(docs: DataFrame, block: int | None = None, seed: str = "mix") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken (words, repeats counted), first_slot.

    docs has ``doc_id``, ``text`` and ``source``; other columns, whatever their names, are not
    read. block: words of a slot; by default the corpus has about 32,768 slots or one for every
    eight documents, whichever is more. Null text has size 0, a null source is a source of its
    own, a null doc_id takes part. Rows that repeat a doc_id are documents of their own. A
    document of size 0 takes 0, none takes more than 3 times its size; each source takes its
    target, rounded to a word. Ties in the shuffle are broken by doc_id, then size. first_slot is
    the document's place in the mix, null if nothing is taken. An empty table gives an empty one.
    """
    stream, pieces = _plan(_sized(docs, F.lit(0)), block, seed)
    return _totals(stream, pieces).select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


def mix_documents(docs: DataFrame, block: int | None = None, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target, taken and first_slot in place of any columns of these names (see ``mix``).

    The rows are written once with a key of their own, so that rows without a doc_id and rows
    that repeat one are each joined with what the mix takes of them.
    """
    new = ["size", "source_size", "target", "taken", "first_slot"]
    held = [c for c in docs.columns if c not in new]
    keyed = cut(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*(F.col(f"`{c}`") for c in held)).alias("row")), "keyed")
    stream, pieces = _plan(_sized(keyed.select("key", "row.doc_id", "row.text", "row.source"), F.col("key")), block, seed)
    return keyed.join(_totals(stream, pieces).select("key", *new), "key").select("row.*", *new)


def mixed_blocks(docs: DataFrame, block: int | None = None, seed: str = "mix") -> DataFrame:
    """The mix itself: slot, source, rank, doc_id, start, words, text, a row for each stretch of a document that a slot takes.

    Ordered by (slot, source, rank, start of the stream) the rows read as the mixed corpus; a
    slot that crosses documents has several rows. text holds the stretch's words joined by one
    space. Nulls, ties and repeated rows as in ``mix``.
    """
    keyed = cut(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", "source"), "keyed")
    stream, pieces = _plan(_sized(keyed, F.col("key")), block, seed)
    placed = pieces.join(stream.where("size > 0").select("sid", "place", "key"), ["sid", "place"]).join(keyed, "key")
    stretch = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), (F.col("start") + 1).cast("int"), F.col("words").cast("int")), " ")
    return placed.select("slot", "source", "rank", "doc_id", "start", "words", stretch.alias("text"))


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and the slot of the schedule with which it begins to."""
    return mix(table(spark, sf_dir, "documents")).drop("source")


QUERIES = {"op4_source_mixing": op4_source_mixing}
#: The schedule decides when a document comes (first_slot), its place in the source's stream how much of it does.
SQL = {
    "op4_source_mixing": r"""
WITH d AS (SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS o,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
s AS (SELECT source, s, row_number() OVER (ORDER BY source NULLS LAST) AS sid,
    ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s0),
t AS (SELECT *, row_number() OVER (ORDER BY (3 * s) / w, sid) AS turn,
    (sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY (3 * s) / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY (3 * s) / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s),
lv AS (SELECT arg_min(level, turn) AS level FROM t WHERE level * w <= 3 * s),
g AS (SELECT source, sid, s, least((3 * s)::DOUBLE, coalesce((SELECT level FROM lv) * w, (3 * s)::DOUBLE)) AS target FROM t),
c AS (SELECT n, greatest(1, total // greatest(32768, n // 8)) AS block, ceil(total / greatest(1, total // greatest(32768, n // 8)))::BIGINT AS slots, total FROM (SELECT count(*) AS n, coalesce(sum(size), 0)::BIGINT AS total FROM d)),
h AS (SELECT sid, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo, hi FROM (SELECT sid, least(ceil(sum(target) OVER (ORDER BY sid) / greatest(total, 1) * 4294967296), 4294967296)::BIGINT AS hi FROM g, c)),
u AS (SELECT i AS slot, (i::HUGEINT * 2654435769 % 4294967296)::BIGINT AS u FROM (SELECT unnest(range(slots)) AS i FROM c)),
k AS (SELECT sid, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank, count(*) OVER (PARTITION BY sid) AS drawn FROM u JOIN h ON u >= lo AND u < hi),
r AS (SELECT doc_id, size, g.sid, g.s AS source_size, target, round(target)::BIGINT AS upto,
    coalesce(sum(size) OVER (PARTITION BY g.sid ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
t3 AS (SELECT *, (greatest(0, least(f + size, upto) - f) + greatest(0, least(source_size + f + size, upto) - source_size - f)
   + greatest(0, least(2 * source_size + f + size, upto) - 2 * source_size - f))::BIGINT AS taken, f // block AS rank FROM r, c)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN coalesce(k.slot, slots + t3.rank - coalesce(x.drawn, 0)) END AS first_slot
FROM t3 LEFT JOIN k ON k.sid = t3.sid AND k.rank = t3.rank LEFT JOIN (SELECT sid, max(drawn) AS drawn FROM k GROUP BY sid) x ON x.sid = t3.sid
""",
}
