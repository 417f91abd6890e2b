"""Similarity, diffs and automata against the standard library and plain loops."""

import random
import time
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.functions import python as P
from foliant.functions import similarity


@settings(max_examples=600, deadline=None)
@given(st.text("abc ", max_size=40), st.text("abc ", max_size=40))
def test_ratio_of_short_texts(a, b):
    assert similarity.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def edited(r, text, n):
    for _ in range(n):
        at = r.randrange(len(text) + 1)
        text = text[:at] + r.choice(["", "x", "and ", "QZ", "Ω"]) + text[at + r.randint(0, 9) :]
    return text


@pytest.mark.parametrize("seed", range(12))
def test_ratio_of_long_texts(seed):
    """Popular characters begin no block in texts of 200 characters and more."""
    r = random.Random(seed)
    words = ["the", "Company", "of", "revenue", "Quebec", "x", "Item", "7.", "zinc", "(1)", "ü", "and"]
    a = " ".join(r.choices(words, k=r.choice([30, 60, 400])))
    for b in (edited(r, a, 5), edited(r, a, 40), " ".join(r.choices(words, k=300)), a[::-1], a + a, a[50:] + a[:50], "".join(r.choices([chr(c) for c in range(0x4E00, 0x4F00)], k=800))):
        assert similarity.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
        assert similarity.ratio(b, a) == SequenceMatcher(None, b, a).ratio()


def test_ratio_of_a_megabyte():
    r = random.Random(1)
    vocab = ["".join(r.choices("etaoinshrdlucmfwypvbgkqjxzETAOINS", weights=range(33, 0, -1), k=r.randint(2, 9))) for _ in range(5000)]
    a = " ".join(r.choices(vocab, k=160_000))[:1_000_000]
    began = time.process_time()
    assert similarity.ratio(a, edited(r, a, 20)) > 0.9
    assert similarity.ratio(a, a) == 1.0
    assert time.process_time() - began < 30


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=30), st.lists(st.text("ab", max_size=4), max_size=6))
def test_places_by_automaton(text, needles):
    want = [[i for i in range(len(text)) if n and text.startswith(n, i)] for n in needles]
    assert P.all_places(text, needles) == want
    for n, places in zip(needles, want):
        for target in ("", "a", "ab", "abba", "b" * 9):
            scores = [next((k for k, (x, y) in enumerate(zip(text[p + len(n) : p + len(n) + 6], target)) if x != y), min(len(target), len(text[p + len(n) : p + len(n) + 6]))) for p in places]
            got, score = P.agreeing_place(text, places, len(n), target, 6)
            assert (got, score) == ((places[scores.index(max(scores))], max(scores)) if places else (None, -1))


def test_differences_of_nested_rows(spark):
    from foliant.operators import diff

    kind = "k int, a struct<x:int,y:string>, items array<struct<item:string,v:double>>, tags array<string>, m map<string,int>, only int"
    left = [(1, (1, "p"), [("1", 0.5), ("7", 0.9), ("7", 0.8)], ["a", "b"], {"q": 1}, 1), (2, (1, None), [], None, None, 2), (3, None, None, [], {}, 3), (5, (0, "s"), [("x", None)], ["t"], {}, 9)]
    right = [(1, (2, "p"), [("7", 0.9), ("1", 0.6), ("7", 0.7), ("9", None)], ["a"], {"q": 2, "r": 0}), (2, (1, None), [], None, None), (3, (None, None), [("1", 1.0)], [], None), (4, None, [], [], {})]
    got = diff.differences(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind.rsplit(",", 1)[0]), "k", {"items": "item"})
    assert sorted(tuple(r) for r in got.where("k in (1, 4, 5)").collect()) == sorted(
        [
            (1, "a.x", "1", "2", "both"), (1, "items[item=1].v", "0.5", "0.6", "both"), (1, "items[item=7#2].v", "0.8", "0.7", "both"), (1, "items[item=9].item", None, "9", "right"),
            (1, "items[item=9].v", None, None, "right"), (1, "tags[1]", "b", None, "left"), (1, "m{q}", '{"v":1}', '{"v":2}', "both"), (1, "m{r}", None, '{"v":0}', "right"),
            (4, "", None, None, "right"), (5, "", None, None, "left"),
        ]
    )
    assert {r.path for r in got.where("k = 3").collect()} == {"a", "a.x", "a.y", "items", "items[item=1].item", "items[item=1].v", "m"} and got.where("k = 2").count() == 0
    assert diff.differences(got.limit(0), got.limit(0), "k").count() == 0


def test_quoted_figures(spark):
    import re

    from foliant.operators import diff

    r = random.Random(2)
    names = {"jpm": [1.25, 40.0], "jpm-2024": [0.5781, 21.2], "xom": [2.675]}
    lines = []
    for i in range(300):
        lines.append((f"f{i % 3}", i, "".join(r.choices(["`jpm`", "`jpm-2024`", "`xom`", "`other`", " 1.25", " 1.3", " 0.58 s", " 0.578", "$2.68", " 2.67", " 2.68", "40.0%", " 21.2x ", " 21.2×", " v1.25.3 ", "x" * 30, " about "], k=r.randint(1, 9)))))
    lines.append(("f0", 999, None))
    want = []
    for file, no, raw in lines:
        hits = list(re.finditer("`(jpm-2024|jpm|xom)`", raw or ""))
        for i, m in enumerate(hits):
            stop = min(m.end() + 60, hits[i + 1].start() if i + 1 < len(hits) else len(raw))
            for f in re.finditer(r"(?<![\w.])(\d+\.\d+)(?!\d)", raw):
                if not (m.end() <= f.start() and f.end() <= stop) or raw[f.start() - 1] == "$" or re.match("%|×|x ", raw[f.end() :]):
                    continue
                places = len(f[1].split(".")[1])
                want.append((file, no, m[1], f[1], any(abs(v - float(f[1])) <= 0.5 * 10**-places * (1 + 1e-9) for v in names[m[1]])))
    records = spark.createDataFrame([(n, [v]) for n, vs in names.items() for v in vs], "name string, values array<double>")
    got = diff.quoted_figures(spark.createDataFrame(lines, "file string, line_no int, raw string"), records)
    assert sorted((x.file, x.line_no, x.name, x.figure, x.stated) for x in got.collect()) == sorted(want)
