"""Baselines that runs race for, packing of scans, plateaus."""

import random
import threading

from pyspark.sql import functions as F

from foliant.operators import measure
from foliant.sources import baseline, packing


def test_of_two_racing_runs_one_goes_first(spark, tmp_path):
    path = f"file://{tmp_path}/base"
    a, b = baseline.Baseline(spark, path), baseline.Baseline(spark, path)
    assert a.read() == (0, {})
    at, known = a.read()
    assert b.commit(at, known | {"fast": 0.5}) and not a.commit(at, known | {"golden": 0.9})
    assert a.publish({"golden": 0.9}) == 2 and b.read() == (2, {"fast": 0.5, "golden": 0.9})
    threads = [threading.Thread(target=lambda i=i: baseline.Baseline(spark, path).publish({f"s{i}": i / 10})) for i in range(6)]
    [t.start() for t in threads], [t.join() for t in threads]
    number, scores = a.read()
    assert number == 8 and {f"s{i}": i / 10 for i in range(6)}.items() <= scores.items()
    run = spark.createDataFrame([("fast", 0.75), ("void", None)], "suite string, score double")
    assert baseline.publish_scores(run, a) == 9 and a.read()[1]["fast"] == 0.75 and "void" not in a.read()[1]
    assert baseline.publish_scores(run.limit(0), a) == 9


def test_gate_of_odd_runs(spark):
    rows = [(1, "2024-01-01 00:00:00", "a", 0.9, False), (2, "2024-01-01 00:00:00", "a", 0.8, True), (3, "2024-01-01 00:00:00", "a", 0.7, False), (4, "2024-01-05 00:00:00", "a", None, True), (5, "2024-01-09 00:00:00", "a", 0.79, False), (6, "2024-01-09 01:00:00", "b", 0.1, False), (7, "2024-01-09 02:00:00", None, 0.1, True)]
    df = spark.createDataFrame(rows, "run_id int, t string, suite string, score double, update boolean").withColumn("ts", F.to_timestamp("t"))
    got = {r.run_id: (r.baseline, r.verdict) for r in baseline.gate(df).collect()}
    assert got == {1: (None, "accepted"), 2: (None, "recorded"), 3: (0.8, "regression"), 4: (0.8, "recorded"), 5: (0.8, "regression"), 6: (None, "accepted"), 7: (None, "recorded")}
    assert baseline.gate(df.limit(0)).count() == 0


def test_packing_of_skewed_listings(spark):
    r = random.Random(1)
    zipf = [("z%05d" % i, 40_000_000 // (i + 20)) for i in range(5000)]
    for rows, tasks in ((zipf, 8), ([("a", 100)] + [(f"b{i}", 1) for i in range(50)], 4), ([(f"c{i}", r.choice([0, 1, 7])) for i in range(500)], 7), ([("x", None), ("y", 0)], 3), ([], 5), ([("one", 5)], 1)):
        got = packing.pack(spark.createDataFrame(rows, "path string, length long"), tasks).collect()
        assert sorted(x.path for x in got) == sorted(p for p, _ in rows) and all(0 <= x.task < tasks for x in got)
        load = [0] * tasks
        for x in got:
            load[x.task] += x.length
        mean = sum(load) / tasks
        largest = max((n or 0 for _, n in rows), default=0)
        assert max(load) <= max(1.2 * mean, largest), (load, mean)
    placed, loads = packing.longest_first([9, 7, 6, 5, 5], 2)
    assert placed == [0, 1, 1, 0, 1] and loads == [14, 18] and packing.level([5, 1, 9], 6) == 6.0


def plateau_by_loop(rows, within):
    out = {}
    for key in {k for k, _, _ in rows}:
        mine = [(o, v) for k, o, v in rows if k == key]
        peak = max((v for _, v in mine if v is not None), default=None)
        good = [o for o, _ in mine if all(v is None or peak - v <= within for p, v in mine if p >= o)]
        if good:
            out[key] = min(good)
    return out


def test_plateau_of_one_large_key(spark):
    r = random.Random(3)
    rows = [("hot", i, float(min(i, 900)) + r.random()) for i in range(3000)] + [("last off", 1, 9.0), ("last off", 2, 0.0), (None, 1, 1.0), ("n", 1, None), ("n", 2, 5.0), ("t", 1, 0.0), ("t", 1, 5.0), ("t", 2, 5.0)]
    df = spark.createDataFrame(rows, "k string, o int, v double").repartition(9)
    got = {x.k: x["from"] for x in measure.plateau(df, "k", "o", "v", 0.5).collect()}
    assert got == plateau_by_loop(rows[3000:], 0.5) | plateau_by_loop(rows[:3000], 0.5)
    plan = measure.plateau(df, "k", "o", "v", 0.5)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_report_lines(spark):
    metrics = spark.createDataFrame([(1, "presence_recall", 0.9875, 40), (6, "silent_failure", None, 0), (11, "deterministic_share", 1.0, 7)], "n int, metric string, value double, sample long")
    bands = spark.createDataFrame([(0.95, 12, 1), (0.6, 3, 2)], "confidence double, targeted int, failed int")
    lines = [r.line for r in measure.render(metrics, bands).orderBy("n", "seq").collect()]
    assert lines == [
        f" 1. {'presence_recall':<32} 0.9875   (n=40)", f" 6. {'silent_failure':<32} None   (n=0)", " 8. calibration", "       conf=0.6   targeted=3    failed=2",
        "       conf=0.95  targeted=12   failed=1", f"11. {'deterministic_share':<32} 1.0   (n=7)",
    ]
