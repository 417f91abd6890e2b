"""Connected components of a link table by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.storage import cut, drop


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in ``links`` (a long, b long); comp is the smallest id reachable.

    Each round takes the smallest label among a vertex and its neighbours, then follows labels
    once (pointer jumping), so chains shrink by a factor each round. Vertices and links stay in
    tables; only the number of changed labels comes to the driver. An empty table gives an empty one.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        lower = label.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = label.select(F.col("id").alias("comp"), F.col("comp").alias("over"))
        jumped = cut(lower.join(up, "comp", "left").select("id", "old", F.least("comp", F.coalesce("over", "comp")).alias("comp")), "labels")
        drop(label)
        label = jumped.select("id", "comp")
        if jumped.where("comp <> old").isEmpty():
            drop(both)
            return label
