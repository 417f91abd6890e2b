"""Near-duplicates, repeated passages and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from foliant.llm import decontaminate, minhash, substring

DOCS = "doc_id long, text string, id string, comp long, key int, found string"


def frame(spark, rows):
    """Rows (doc_id, text) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", 7, 1, None) for i, t in rows], DOCS)


def made(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(n):
        kind = r.random()
        if docs and kind < 0.25:
            words = r.choice(docs).split()
            for _ in range(r.randint(0, 3)):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocab)
            docs.append(" ".join(words))
        elif docs and kind < 0.4:
            words = r.choice(docs).split()
            a = r.randrange(max(1, len(words)))
            docs.append(" ".join([*r.choices(vocab, k=15), *words[a : a + 40], *r.choices(vocab, k=10)]))
        else:
            docs.append(" ".join(r.choices(vocab, k=r.choice([1, 3, 4, 5, 19, 20, 21, 60, 120]))))
    docs += [docs[3].upper(), docs[3].replace(" ", "\t\n "), "", "   ", "one two", "ONE  two", "é " * 30]
    return docs


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates(spark):
    rows = list(enumerate(made(1))) + [(900, None)]
    extra = [(None, "lost"), (5, rows[5][1])]
    got = minhash.near_duplicates(frame(spark, rows + extra)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == brute_components(rows) and len(got) == len(rows) + 2
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None] == [(1, None, True)]


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_near_copies_in_one_large_group(spark):
    """More near copies than a block holds, linked in chains through the group."""
    r = random.Random(5)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(600):
        words = list(base)
        for k in r.sample(range(60), r.choice([0, 1, 2, 3, 4])):
            words[k] = f"s{r.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_pigeonhole():
    """Signatures within the radius share a key."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, minhash.POSITIONS).astype("<u2")
        b = a.copy()
        at = rng.choice(minhash.POSITIONS, minhash.RADIUS, replace=False)
        b[at] ^= 1
        x, y = minhash.chunk_keys(np.stack([a, b]))
        assert set(x.tolist()) & set(y.tolist())


def brute_removed(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda x: x[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for s in range(len(words) - 19):
            k = tuple(words[s : s + 20])
            if k in seen:
                gone |= set(range(s, s + 20))
            seen.add(k)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_remove_repeats(spark):
    rows = list(enumerate(made(2))) + [(500, "a b c d " * 40), (501, None), (502, "long " * 5000), (-4, "a b c d " * 9)]
    got = substring.remove_repeats(frame(spark, rows + [(None, rows[0][1])])).collect()
    sha = lambda r: hashlib.sha256(r.kept_text.encode()).hexdigest()
    assert {r.doc_id: (r.n_words, r.n_removed, sha(r)) for r in got if r.doc_id is not None} == brute_removed(rows) and len(got) == len(rows) + 1
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0 and r.kept_text == " ".join(words[0])
        elif r.n_removed:
            assert all(f.words >= 20 and (f.ref_id, f.ref_start) < (r.doc_id, f.start) for f in r.factors)
            assert all(words[r.doc_id][f.start : f.start + f.words] == words[f.ref_id][f.ref_start : f.ref_start + f.words] for f in r.factors)
            assert r.copy_of is None or (words[r.copy_of] == words[r.doc_id] and len(r.factors) == 1)


def test_rows_that_repeat_an_id_keep_their_texts(spark):
    """Each is a document of its own, in the order of (doc_id, text)."""
    r = random.Random(7)
    a, b = (" ".join(r.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(2))
    rows = [(2, a + " tail of two"), (1, "other text"), (1, a), (3, b), (1, b), (1, b), (4, a[3:]), (None, a)]
    keys = {k: i for i, k in enumerate(sorted(range(7), key=lambda k: rows[k]))}
    want = brute_removed([(keys[k], rows[k][1]) for k in range(7)])
    got = substring.remove_repeats(frame(spark, rows)).collect()
    sha = lambda x: hashlib.sha256(x.kept_text.encode()).hexdigest()
    assert sorted((x.doc_id, x.n_words, x.n_removed, sha(x)) for x in got if x.doc_id) == sorted((rows[k][0], *want[keys[k]]) for k in range(7))
    assert [x.kept_text for x in got if x.doc_id is None] == [a] and {x.kept_text for x in got if x.doc_id == 1} == {a, b, "other text", ""}
    assert all(f.ref_id == 1 for x in got for f in x.factors or ()) and {x.copy_of for x in got if x.doc_id in (1, 3)} == {None, 1}
    near = minhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted(map(str, ((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in near))) == sorted(
        map(str, [(1, 1, 1, True), (1, 56, 1, True), (1, 56, 1, True), (1, 56, 1, True), (2, 59, 1, False), (3, 56, 1, False), (4, 56 if len(shingles(a[3:])) == 56 else 55, 1, False), (None, 56, None, True)])
    )


def test_remove_repeats_of_nothing(spark):
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(rows, items):
    out = {}
    for i, text in rows:
        w, hit, who = words_of(text), set(), set()
        for item, t in items:
            b = words_of(t)
            n = min(10, len(b))
            windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
            for s in range(len(w) - n + 1 if n else 0):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    who.add(str(item))
        out[i] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit))
    return out


def test_contamination(spark):
    docs = made(3)
    items = [(1, docs[0]), (2, " ".join(docs[1].split()[:4])), (10, docs[2] + " z"), (3, None), (4, "--- !"), (5, "absent words only here"), (2, "é é é"), (11, "a a a a a a a a a a")]
    docs += [docs[0].upper().replace(" ", "-- "), "x " + docs[2] + " tail", None, "a " * 25, "é!é?é"]
    rows = list(enumerate(docs))
    bench = spark.createDataFrame([(i, t, 1) for i, t in [*items, (None, "a")]], "item_id long, text string, wid int")
    shown = lambda r: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
    got = decontaminate.contamination(frame(spark, rows), bench)
    assert {r.doc_id: shown(r) for r in got.collect()} == brute_hits(rows, items)
    odd = rows[:5] + [(None, docs[0]), (None, docs[3]), (2, docs[0])]
    got = decontaminate.contamination(frame(spark, odd), bench).collect()
    want = brute_hits(list(enumerate(t for _, t in odd)), items)
    assert sorted((str(r.doc_id), shown(r)) for r in got) == sorted((str(odd[i][0]), v) for i, v in want.items())


def test_contamination_without_items(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(frame(spark, [(1, "a b")]), bench).collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got] == [(1, 2, 0, False)]


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, "x " + item), (2, item.replace("delta", "delta so")), (3, " ".join(item.split()[::-1])), (4, "kappa")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    index = decontaminate.Index(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {r.doc_id for r in index.proximity(0).collect()} <= {r.doc_id for r in index.proximity(2).collect()}
    assert {1, 2} <= {r.doc_id for r in index.proximity(2).collect()} and 4 not in {r.doc_id for r in index.proximity(2).collect()}
