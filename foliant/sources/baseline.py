"""Baselines of suites, published by atomic commits, and the runs that they judge.

A baseline is a folder of numbered commits, each a folder with the scores of all suites. A commit
is written under a name of its own and then renamed to the next number, which a folder with
something in it does not give up: readers see whole commits only, and of two runs that race one
goes first. The other finds the first one's name in the commit and goes on from there. All is done
by Hadoop's file contexts, so the folder may lie where Spark's tables lie.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Baseline:
    """Scores by suite below ``path``; ``read`` gives the last commit, ``publish`` makes the next."""

    def __init__(self, spark: SparkSession, path: str):
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._path = lambda *parts: self._fs.Path("/".join([path.rstrip("/"), *parts]))
        root = self._fs.Path(path)
        self._files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = self._fs.FileContext.getFileContext(root.toUri() if ":" in path else self._files.getUri(), spark._jsc.hadoopConfiguration())
        self._no_options = spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)

    def _last(self) -> int:
        """Number of the last commit; 0 if there is none."""
        folder = self._path("commits")
        names = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _commit(self, number: int) -> dict:
        stream = self._files.open(self._path("commits", f"{number:020}", "scores.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> tuple[int, dict[str, float]]:
        """(number of the last commit, score by suite)."""
        number = self._last()
        return number, self._commit(number)["scores"] if number else {}

    def commit(self, base: int, scores: dict[str, float]) -> bool:
        """Publishes ``scores`` as the commit after ``base``; false if another run made that commit."""
        name = uuid.uuid4().hex
        made = self._path("made", name)
        stream = self._files.create(self._path("made", name, "scores.json"), True)
        stream.write(bytearray(json.dumps({"name": name, "scores": scores}, sort_keys=True).encode()))
        stream.close()
        self._files.mkdirs(self._path("commits"))
        try:
            self._context.rename(made, self._path("commits", f"{base + 1:020}"), self._no_options)
        except Exception as refused:
            if not self._files.exists(self._path("commits", f"{base + 1:020}", "scores.json")):
                raise refused
            self._files.delete(made, True)
        return self._commit(base + 1)["name"] == name

    def publish(self, scores: dict[str, float]) -> int:
        """Puts these suites' scores into the baseline, other suites as they are; the number of the commit."""
        while True:
            base, known = self.read()
            if self.commit(base, known | scores):
                return base + 1


def publish_scores(run: DataFrame, baseline: Baseline) -> int:
    """Publishes a run's scores (suite, score; a row a suite) as the baseline. An empty run changes nothing."""
    scores = {r["suite"]: r["score"] for r in run.select("suite", "score").collect() if r["score"] is not None}
    return baseline.publish(scores) if scores else baseline.read()[0]


def gate(history: DataFrame, stretch: str = "day") -> DataFrame:
    """history with ``baseline`` and ``verdict``: each run against the last baseline that was accepted before it.

    history: run_id, ts, suite, score, update (whether the run became the baseline). A run is a
    regression where it scores below that baseline; one that updates is recorded, whatever its
    score; without a baseline it is accepted. Runs of one time go by run_id. Null scores are no
    baseline and no regression. The as-of join takes two levels, so that no suite's runs meet in
    one task: the last baseline within each stretch of time of a suite, and what each stretch
    hands to the next, which is a row a stretch.
    """
    rows = history.withColumn("_stretch", F.date_trunc(stretch, "ts")).withColumn("_new", F.when(F.col("update"), F.col("score")))
    within = Window.partitionBy("suite", "_stretch").orderBy("ts", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where("_new is not null").groupBy("suite", "_stretch").agg(F.max_by("_new", F.struct("ts", "run_id")).alias("_end"))
    spans = rows.select("suite", "_stretch").distinct().join(ends, ["suite", "_stretch"], "left")
    before = Window.partitionBy("suite").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("suite", "_stretch", F.last("_end", ignorenulls=True).over(before).alias("_handed"))
    rows = rows.withColumn("_own", F.last("_new", ignorenulls=True).over(within)).join(spans, ["suite", "_stretch"], "left")
    rows = rows.withColumn("baseline", F.coalesce("_own", "_handed"))
    below = F.coalesce(F.col("score") < F.col("baseline"), F.lit(False))
    verdict = F.when(F.col("update"), "recorded").when(below, "regression").otherwise("accepted")
    return rows.withColumn("verdict", verdict).drop("_stretch", "_new", "_own", "_handed")
