"""Differences of nested rows against plain loops, and what they are made from."""

import random

from foliant import harness
from foliant.operators import diff

SF = "/root/testdata/sf0.001"


def _leaves(items: list[tuple]) -> dict[str, str | None]:
    out, seen = {}, {}
    for item, v in items:
        seen[item] = seen.get(item, 0) + 1
        at = f"items[item={item or ''}{f'#{seen[item]}' if seen[item] > 1 else ''}]"
        out |= {f"{at}.item": item, f"{at}.v": None if v is None else str(v)}
    return out or {"items": "[]"}


def test_leaves_that_shift_or_repeat_are_met_by_path(spark):
    r = random.Random(8)
    rows = lambda: [(r.choice(("1", "1A", "7", None)), r.choice((1, 2, None))) for _ in range(r.randrange(6))]
    made = [(k, a, a[1:] + a[:1] if k % 3 == 0 else a if k % 3 == 1 else rows()) for k, a in ((k, rows()) for k in range(400))]
    # two keys would give one path: null and empty text are not both in use
    kind = "k int, items array<struct<item:string,v:int>>"
    got = diff.differences(spark.createDataFrame([(k, a) for k, a, _ in made], kind), spark.createDataFrame([(k, b) for k, _, b in made], kind), "k", {"items": "item"})
    want = []
    for k, a, b in made:
        x, y = _leaves(a), _leaves(b)
        want += [(k, p, x.get(p), y.get(p), "both" if p in x and p in y else "left" if p in x else "right") for p in {**x, **y} if p not in x or p not in y or x[p] != y[p]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 400


def test_both_runs_are_taken_from_one_stage(spark):
    got = harness.run_differences(spark, SF)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert got.count() > 0
