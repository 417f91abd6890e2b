"""Files dealt to the tasks of a scan by their lengths."""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A file longer than this share of a task's even load is placed by itself, others as a stream.
SHARE = 8


def longest_first(lengths: list[int], tasks: int) -> tuple[list[int], list[int]]:
    """(task of each file, load of each task): lengths, longest first, each to the task with the least load, the first of several."""
    heap = [(0, t) for t in range(tasks)]
    placed = []
    for length in lengths:
        load, t = heap[0]
        heapq.heapreplace(heap, (load + length, t))
        placed.append(t)
    return placed, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def level(loads: list[int], more: int) -> float:
    """Up to where the least loaded tasks are filled if ``more`` is poured over them."""
    low = sorted(loads)
    return min((more + s) / m for m, s in enumerate(accumulate(low), 1))


def pack(files: DataFrame, tasks: int) -> DataFrame:
    """(path, length, task): files (path, length) dealt to tasks 0 to ``tasks`` - 1, near even in bytes.

    Files longer than an eighth of the even load are fewer than 8 x tasks: those come to the
    driver, and go, longest first (ties by path), to the least loaded task. The others are a
    stream in the order of their paths' hashes; running sums in two levels (the hash's first digits, then
    within) give each a place, and places are cut where the tasks' room to the common level ends.
    So no task has over that level by more than half a small file, unless its large files alone
    have. Null and negative lengths count as 0. Paths are to be unique. An empty listing gives an empty one.
    """
    rows = files.select("path", F.greatest(F.coalesce("length", F.lit(0)), F.lit(0)).cast("long").alias("length"))
    about = rows.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
    large = (F.col("length") * tasks * SHARE > about["total"]) if about["total"] else F.lit(False)
    held = [(r["path"], r["length"]) for r in rows.where(large).orderBy(F.col("length").desc(), "path").collect()]
    placed, loads = longest_first([n for _, n in held], tasks)
    top = level(loads, about["total"] - sum(n for _, n in held))
    ends = list(accumulate(max(0.0, top - x) for x in loads))
    first = rows.sparkSession.createDataFrame([(p, n, t) for (p, n), t in zip(held, placed)], "path string, length long, task int")

    small = rows.where(~large).withColumn("_hash", F.md5("path")).withColumn("_head", F.substring("_hash", 1, 3))
    sums = small.groupBy("_head").agg(F.sum("length").alias("_sum"))
    before = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 rows
    sums = F.broadcast(sums.select("_head", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")))
    within = Window.partitionBy("_head").orderBy("_hash", "path").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_before") + F.coalesce(F.sum("length").over(within), F.lit(0)) + F.col("length") / 2
    task = F.size(F.filter(F.array(*map(F.lit, ends[:-1])), lambda e: e <= F.col("_place"))) if tasks > 1 else F.lit(0)
    streamed = small.join(sums, "_head").withColumn("_place", place).select("path", "length", task.cast("int").alias("task"))
    return first.union(streamed)
