"""Fill-in-middle, conversation repair and simhash against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import conversations, fim, simhash

SF = "/root/testdata/sf0.001"


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    out = con.sql(sql)
    return sorted(map(repr, out.select(", ".join(sorted(out.columns))).fetchall()))


def spark_rows(df):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


# ---- fill-in-middle


def by_regex(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if doc_id is None or not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["", None, " ", "\t\n", "a", " a ", "é ü ß", "a <P> b", "x<S>", "<M>", "<", "a <", "<P a", "P>", "\U0001f600 b\x0b c\x0c", "w " * 50000, "<<P<S<M " * 9]


def test_fill_in_middle(spark):
    r = random.Random(8)
    rows = [(i, ODD[i % len(ODD)]) for i in range(120)] + [(i, "".join(r.choices("aé \n<PSM>", k=r.randint(0, 60)))) for i in range(300)] + [(None, "a b c"), (7, "x y z"), (7, "x y z")]
    docs = spark.createDataFrame([(i, t, 5, "q", 1) for i, t in rows], "doc_id long, text string, n int, output string, form int")
    moved = fim.fill_in_middle(docs)
    got = sorted(map(repr, ((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in moved.collect())))
    assert got == sorted(map(repr, ((i, *by_regex(i, t)) for i, t in rows)))
    back = fim.restore(moved.withColumnRenamed("output_sha256", "text of")).collect()
    assert sorted((repr(x.doc_id), x.text) for x in back) == sorted((repr(i), t or "") for i, t in rows)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_equals_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sql_rows(fim.SQL["op13_fill_in_middle"], documents=docs.toPandas())
    assert spark_rows(fim.op13_fill_in_middle(spark, SF)) == want


def test_rates_and_sentinels_are_parameters(spark):
    plan = fim.Plan(seed=1, fim=100, spm=0, sentinels=("[a]", "[bb]", "[ccc]"))
    docs = spark.createDataFrame([(i, f"w{i} x y z <P>") for i in range(50)], "doc_id long, text string")
    moved = fim.fill_in_middle(docs, plan)
    assert {r.form for r in moved.collect()} == {"psm"} and all(re.fullmatch(r"(?s)\[a\].*\[bb\].*\[ccc\].*", r.output) for r in moved.collect())
    assert {r.text for r in fim.restore(moved, plan).collect()} == {f"w{i} x y z <P>" for i in range(50)}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40), st.sampled_from(["psm", "spm", "plain"]), st.data())
def test_inverse_permutation_restores(text, form, data):
    raw = text.encode("utf-8", "ignore")
    marks = [b"<P>", b"<S>", b"<M>"]
    if any(m in raw for m in marks):
        form = "plain"
    a = data.draw(st.integers(0, len(raw)))
    b = data.draw(st.integers(a, len(raw)))
    moved = fim.arranged(memoryview(raw), form, a, b, marks)
    assert fim.restored(moved.text(), form, marks).text() == raw
    assert moved.sha256() == hashlib.sha256(moved.text()).hexdigest()


# ---- simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    """Smallest doc_id reachable for each row (doc_id, fingerprint)."""
    least = [i for i, _ in prints]
    near = [[y for y, (j, q) in enumerate(prints) if j is not None and (p ^ q).bit_count() <= radius] for _, p in prints]
    seen = {}
    for start in range(len(prints)):
        if start in seen or least[start] is None:
            continue
        group, todo = {start}, [start]
        while todo:
            todo += [y for y in near[todo.pop()] if y not in group and not group.add(y)]
        for x in group:
            seen[x] = min(least[y] for y in group)
    return [seen.get(x) for x in range(len(prints))]


def edited(r, text):
    words = text.split()
    for _ in range(r.randint(0, 2)):
        words[r.randrange(len(words))] = r.choice("abcdef")
    return " ".join(words)


def test_simhash(spark):
    r = random.Random(5)
    bases = [" ".join(r.choices([f"w{i}" for i in range(200)], k=r.choice([1, 2, 3, 40, 200, 400]))) for _ in range(20)]
    texts = [edited(r, r.choice(bases)) for _ in range(300)] + ["", None, " \t\n", "A b", "a\x0bB", "é É", "x " * 30000, "a b c d " * 200]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "another text here"), (3, texts[3]), (None, texts[5]), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "q", 2) for i, t in rows], "doc_id long, text string, fp int, component_id string, shard int")
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints))]
    got = [(x.doc_id, x.fingerprint, x.component_id) for x in simhash.near_duplicates(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("trees", [0, 512])
def test_split_shards_give_the_same_components(spark, monkeypatch, trees):
    """Dense and sparse fingerprints, with trees of few nodes, broadcast or dealt to pairs."""
    monkeypatch.setattr(simhash, "TREE", 16)
    monkeypatch.setattr(simhash, "SHARD", 24)
    monkeypatch.setattr(simhash, "BROADCAST_TREES", trees)
    r = random.Random(6)
    fps = {0, (1 << 64) - 1}
    for base in [r.getrandbits(64) for _ in range(12)]:
        for _ in range(40):
            fps.add(base ^ sum(1 << b for b in {r.randrange(64) for _ in range(r.randint(0, 3))}))
    fps = sorted(fps)
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    label = {x["id"]: x["comp"] for x in simhash.components(simhash.links(signed)).collect()}
    want = brute_components([(f - (1 << 64) if f >> 63 else f, f) for f in fps])
    assert [label.get(i, i) for i in (f - (1 << 64) if f >> 63 else f for f in fps)] == want


def test_tree_is_that_of_insertions_and_finds_all():
    r = np.random.default_rng(3)
    fps = np.unique(np.r_[r.integers(0, 1 << 63, 300, np.uint64), r.integers(0, 1 << 12, 300, np.uint64)])
    r.shuffle(fps)
    kids = {}  # one by one: parent -> distance -> child

    for f in fps.tolist():
        at = int(fps[0])
        while f != at:
            d = (f ^ at).bit_count()
            nxt = kids.setdefault(at, {}).setdefault(d, f)
            at = nxt
    tree = simhash.Tree.from_bytes(simhash.plant(fps).to_bytes())
    for i, f in enumerate(tree.fp.tolist()):
        mine = range(tree.first[i], tree.first[i] + tree.kids[i])
        assert {int(tree.edge[c]): int(tree.fp[c]) for c in mine} == kids.get(f, {})
    queries = np.r_[fps[:50], fps[:50] ^ np.uint64(5), r.integers(0, 1 << 63, 20, np.uint64)]
    for radius in (0, 2, 9):
        got = {(int(q), int(n)) for qs, ns in simhash.search(tree, queries, radius) for q, n in zip(qs, ns)}
        assert got == {(i, j) for i, q in enumerate(queries.tolist()) for j, f in enumerate(tree.fp.tolist()) if (q ^ f).bit_count() <= radius}


# ---- conversations


def cheapest(kinds, fold=min):
    """(cost, letters) by trying the edits of each row after each state, cheapest prefixes first."""
    inf = (10**9, "")
    best = [(0, ""), inf, inf, inf]
    nxt = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(best):
        for _ in range(3):
            best = [fold([best[j], *((best[p][0] + 3, best[p][1] + "I") for p in range(4) if nxt[p] == j)]) for j in range(4)]
        return best

    for k in kinds:
        fault, r = divmod(k, 4)
        best, late = inserted(best), 3 if fault == 2 else 0
        new = [[(c + 4, a + "D")] for c, a in best]
        if fault != 1:
            for p, (c, a) in enumerate(best):
                if (to := {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}.get((p, r))) is not None:
                    new[to].append((c + late, a + "K"))
                new[nxt[p]].append((c + late + 3, a + "R"))
        best = [fold(x) for x in new]
    best = inserted(best)
    return min(best[0], best[3])


@pytest.mark.parametrize("block", [1, 2, 5, 32])
def test_auction_finds_the_least_of_the_cheapest(monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    r = random.Random(block)
    for _ in range(400):
        kinds = bytes(r.choices(range(12), weights=[3, 9, 9, 1, 1, 1, 1, 1, 2, 2, 2, 1], k=r.choice([0, 1, 2, 3, 6, 12, 40])))
        assert conversations.cheapest_edits(kinds) == cheapest(kinds)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 11), max_size=5))
def test_auction_against_all_edits(kinds):
    """Every string of letters of at most n + 4 is tried."""
    import itertools

    def cost(letters):
        rows, state, total = iter(kinds), "", 0
        for x in letters:
            if x == "I":
                state += "a" if state[-1:] == "u" else "u"
                total += 3
                continue
            fault, r = divmod(next(rows, 99), 4)
            if fault > 2 or (x != "D" and fault == 1) or (x == "K" and r == 3):
                return None
            total += {"D": 4, "K": 0, "R": 3}[x] + (3 if fault == 2 and x != "D" else 0)
            if x != "D":
                state += "sua"[r] if x == "K" else "a" if state[-1:] == "u" else "u"
        return total if next(rows, None) is None and re.fullmatch("(s?(ua)+)?", state) else None

    n = len(kinds)
    inserts = 3 if n > 3 else 2 + n
    tries = {"".join(t) for m in range(min(inserts, 3) + 1) for t in _letters(n, m, itertools)}
    found = [(c, t) for t in tries if (c := cost(t)) is not None]
    least, letters = conversations.cheapest_edits(bytes(kinds))
    if letters.count("I") <= min(inserts, 3):
        assert (least, letters) == min(found)
    else:
        assert all(c > least or (c == least and t > letters) for c, t in found)


def _letters(n, m, itertools):
    for places in itertools.combinations(range(n + m), m):
        for edits in itertools.product("DKR", repeat=n):
            it = iter(edits)
            yield ["I" if i in places else next(it) for i in range(n + m)]


def by_hand(rows):
    """The result of op11 by its definition, for rows (conv_id, turn, role, text)."""
    groups = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        mine = groups.setdefault(c, [])
        mine += [(t, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    out = []
    for c, mine in groups.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))
        kinds, seen, n = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for t, role, text in mine:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            kinds.append(("sua".find(role[0]) if role and role[0] in "sua" else 3) + {None: 0, "blank": 4, "duplicate": 4, "truncated": 8}[fault])
        cost, audit = cheapest(kinds)
        state, left, done = "", iter(mine), []
        for x in audit:
            _, role, text = (0, "", "") if x == "I" else next(left)
            if x == "D":
                continue
            role = role if x == "K" else "assistant" if state[-1:] == "u" else "user"
            state += role[0]
            done.append(f"{role}:{text}")
        turns = {t for t, _, _ in mine if t is not None}
        initials = [role[:1] for _, role, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((c, gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return out


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def talk(r, n):
    texts = ["Hello there.", "What?", "no end", " ", "", None, "Ünd so. \n", "Yes!\x0b", "a:b\nc."]
    rows = []
    for c in [*range(n), None]:
        for t in range(r.choice([1, 2, 3, 6, 12])):
            rows += [(c, r.choice([t, t, t, t + 3, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(texts))]
    return rows + rows[:20]


def test_conversations(spark):
    rows = talk(random.Random(9), 150) + [(900, t, ("user", "assistant")[t % 2], f"Row {t % 700}.") for t in range(3000)]
    df = spark.createDataFrame([(*x, 1, "q", 0) for x in rows], "conv_id long, turn long, role string, text string, kind int, digest string, gone int").repartition(7)
    damaged = conversations.damage(conversations.turns(df))
    found = conversations.diagnose(damaged)
    got = conversations.with_hash(damaged, found).select(*NAMES).collect()
    want = by_hand(rows)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    # the repaired rows themselves
    fixed = {}
    for x in sorted(conversations.repair(damaged, found).collect(), key=lambda x: x.place):
        fixed.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    assert all(hashlib.sha256("\n".join(fixed.get(x[0], [])).encode()).hexdigest() == x[-1] for x in want)
    assert sql_rows(conversations.SQL["op11_conversation_repair"], conversations=spark.createDataFrame(rows[:700], df.select("conv_id", "turn", "role", "text").schema).toPandas().astype({"conv_id": "Int64", "turn": "Int64"})) == sorted(
        repr(tuple(v for _, v in sorted(zip(NAMES, x)))) for x in by_hand(rows[:700])
    )
    assert conversations.with_hash(damaged.limit(0), found.limit(0)).count() == 0 and conversations.diagnose(damaged.limit(0)).count() == 0


def test_conversations_equal_sql(spark):
    want = sql_rows(conversations.SQL["op11_conversation_repair"], conversations=spark.read.parquet(f"{SF}/conversations.parquet").toPandas())
    assert spark_rows(conversations.op11_conversation_repair(spark, SF)) == want


def test_long_conversations_take_linear_time():
    import time

    for kinds in (bytes([0]) * 20000, bytes([1, 1, 2, 2, 3, 8, 9, 10, 4, 0] * 2000)):
        began = time.time()
        conversations._walk.cache_clear(), conversations._entries.cache_clear()
        conversations.cheapest_edits(kinds)
        assert time.time() - began < 20
