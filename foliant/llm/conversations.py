"""Repair of the structure of conversations by an auction for shortest paths.

A conversation should read as (system)? then user and assistant by turns, or be empty. Each row is
kept, given another role, or deleted, and empty rows are inserted, at integer costs. The rows and
the four states of that pattern (nothing yet, after system, after user, after assistant) span a
lattice; a repair is a path from its first corner to an accepting state at its end.

1. Auction: nodes have prices, at first the costs that no path can avoid, and a path grows from
   its origin. At its last node, if the price is below the cheapest arc's cost and its end's price,
   the price rises to that and the path contracts by a node; else it extends along that arc. It
   ends at the sink, and prices of nodes on shortest paths are then their exact distances.
2. Tight arcs (price = cost + price at the end) are followed from the origin, the least letter
   first: D, I, K, R. An arc that leaves a shortest path is never tight at a node of one: the
   auction takes tight arcs in the same order and raises the price of each that leads astray.
3. Long conversations are cut into blocks of BLOCK rows. Blocks are auctioned from the last to the
   first, each with the prices that the next one has at its entry as costs of its exits, then
   traced from the first to the last. So time is linear in the rows.

Spark computes the faults of rows, except which of equal rows comes first: that is an aggregation
over (conversation, digest), so frequent rows meet in no one task. A conversation's rows pass in
order through one task, as its hash needs, but are never gathered there: a task holds two
characters a row, which its audit has in any case, and no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.storage import cut, table

#: Rows of a block of the lattice.
BLOCK = 32
#: States: nothing yet, after system, after user, after assistant; the state after an inserted or renamed row, and after a kept one by its initial.
START, ACCEPTING, STATES = 0, (0, 3), 4
NEXT = (2, 2, 3, 2)
KEEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
ROLE = {2: "user", 3: "assistant"}
RENAME, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
#: A row's kind is its initial (0 to 3: s, u, a, another) and 4 times its fault.
FINE, GOES, TRUNCATED = 0, 1, 2

Arc = tuple[int, int, str]  # cost, how much further in the numbering of nodes, letter


def _arcs(kind: int, state: int) -> list[Arc]:
    """Arcs from a row in a state, in the order of their letters."""
    fault, initial = divmod(kind, 4)
    late = UNFINISHED if fault == TRUNCATED else 0
    out = [(DELETE, STATES, "D"), (INSERT, NEXT[state] - state, "I")]
    if fault != GOES:
        if (state, initial) in KEEP:
            out.append((late, STATES + KEEP[state, initial] - state, "K"))
        out.append((RENAME + late, STATES + NEXT[state] - state, "R"))
    return out


_ARCS = [[_arcs(kind, s) for s in range(STATES)] for kind in range(12)]


def _forced(kind: int) -> int:
    """The least that any edit of a row costs."""
    fault, initial = divmod(kind, 4)
    if fault == GOES:
        return DELETE
    late = UNFINISHED if fault == TRUNCATED else 0
    return late if initial < 3 else min(DELETE, RENAME + late)


class Lattice:
    """A block's rows; ``exits`` are costs from its end by state, None at a conversation's end."""

    def __init__(self, kinds: bytes, exits: tuple[int, ...] | None):
        self.sink = STATES * (len(kinds) + 1)
        self.arcs = [arcs for kind in kinds for arcs in _ARCS[kind]]
        end = len(kinds) * STATES
        for s in range(STATES):
            out = (self.sink - end - s, "")
            if exits is not None:
                self.arcs.append([(exits[s], *out)])
            else:
                self.arcs.append([(INSERT, NEXT[s] - s, "I"), *([(0, *out)] if s in ACCEPTING else [])])
        self.price = [0] * (self.sink + 1)
        for i in range(len(kinds) - 1, -1, -1):
            self.price[i * STATES : (i + 1) * STATES] = [self.price[(i + 1) * STATES] + _forced(kinds[i])] * STATES

    def auction(self, origin: int) -> None:
        """Raises prices until the path from the origin reaches the sink."""
        price, arcs, path = self.price, self.arcs, [origin]
        while path[-1] != self.sink:
            node = path[-1]
            best, to = min(((cost + price[node + far], rank, node + far) for rank, (cost, far, _) in enumerate(arcs[node])))[::2]
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)

    def trace(self, origin: int) -> tuple[str, int]:
        """(letters of the tight arcs from the origin, the least letter first; state at the block's end)."""
        node, letters = origin, []
        while True:
            to, letter = next((node + far, letter) for cost, far, letter in self.arcs[node] if self.price[node] == cost + self.price[node + far])
            if to == self.sink:
                return "".join(letters), node % STATES
            node = to
            letters.append(letter)


@lru_cache(1 << 14)
def _entries(kinds: bytes, exits: tuple[int, ...] | None) -> tuple[int, ...]:
    """Least costs from a block's entry by state."""
    lattice = Lattice(kinds, exits)
    for s in range(STATES):
        lattice.auction(s)
    return tuple(lattice.price[:STATES])


@lru_cache(1 << 14)
def _walk(kinds: bytes, exits: tuple[int, ...] | None, state: int) -> tuple[str, int, int]:
    """(letters, state at the end, cost) of the cheapest walk from a state, exits included."""
    lattice = Lattice(kinds, exits)
    lattice.auction(state)
    return *lattice.trace(state), lattice.price[state]


def cheapest_edits(kinds: bytes) -> tuple[int, str]:
    """(cost, letters) of the cheapest repair of rows of these kinds; of several the ASCII-least."""
    blocks = [kinds[i : i + BLOCK] for i in range(0, len(kinds), BLOCK)] or [b""]
    exits: list[tuple[int, ...] | None] = [None]
    for block in blocks[:0:-1]:
        costs = _entries(block, exits[-1])
        exits.append(tuple(c - min(costs) for c in costs))
    state, letters, total = START, [], 0
    for block, out in zip(blocks, reversed(exits)):
        walked, state, cost = _walk(block, out, state)
        letters.append(walked)
        total += cost - (out[state] if out is not None else 0)
    return total, "".join(letters)


def applied(letters: Iterator[str], rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of the rows of a repaired conversation; the rest of ``letters`` may be inserts."""
    state = START
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = KEEP[state, "sua".index(role[0])]
        else:
            state = NEXT[state]
            role = ROLE[state]
        yield letter, role, text


# ---- rows


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone of each row; a null role or text is one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.lit(False).alias("gone"))


def damage(rows: DataFrame) -> DataFrame:
    """``turns`` with faults by the checksum of ``conv_id:turn`` (nulls as a space): dropped, emptied, without ends of
    sentences, repeated, or of role user."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn"))) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.select("conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (fault == 0).alias("gone"), F.explode(copies).alias("_copy"))
    return out.drop("_copy")


#: What rows of one turn are ordered by, after their role; equal rows have equal digests.
def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))).alias("digest")


def _initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _narrow(rows: DataFrame) -> DataFrame:
    """Rows without texts: kind (blank or truncated), and whether an equal row has an earlier turn."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(blank, GOES).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(FINE)
    narrow = rows.select("conv_id", "turn", F.substring("role", 1, 64).alias("role"), _digest(), (fault * 4 + _initial()).cast("int").alias("kind"), "gone")
    equal = narrow.where("not gone").groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"))
    equal = equal.agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("turn")).alias("_first")).where("_n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    later = F.col("_first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    return narrow.join(equal, same, "left").select("conv_id", "turn", "role", "digest", "kind", later.alias("later"), "gone")


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.kinds = bytearray()
        self.low = self.high = self.digest = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last = -1

    def add(self, turn, digest, kind, later) -> None:
        fault, initial = divmod(kind, 4)
        if fault == GOES:
            self.blank += 1
        elif later or digest == self.digest:
            self.duplicate += 1
            fault = GOES
        elif fault == TRUNCATED:
            self.truncated += 1
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1
        if self.kinds and (self.last, initial) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.digest, self.last = digest, initial
        self.kinds.append(fault * 4 + initial)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest_edits(bytes(self.kinds))


FOUND = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string")]
#: Conversations that are put into a batch of results at once.
_ROWS = 256


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _results(key: pa.DataType, *more: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([("conv_id", key), *((c, kinds[t]) for c, t in FOUND), *((c, pa.string()) for c in more)])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and order: (conv_id, turn, role, digest, kind, later, gone)."""
    kind: list[pa.DataType] = []

    def conversations() -> Iterator[tuple]:
        held = None
        for batch in batches:
            kind[:] = [batch.schema.field(0).type]
            for conv_id, turn, digest, what, later, gone in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6))):
                if held is None or conv_id != held.conv_id:
                    if held is not None:
                        yield held.row()
                    held = _Conversation(conv_id)
                if not gone:
                    held.add(turn, digest, what, later)
        if held is not None:
            yield held.row()

    rows = conversations()
    first = next(rows, None)
    if first is not None:
        yield from _batches((r for part in ([first], rows) for r in part), _results(kind[0]))


def diagnose(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``turns`` (or ``damage``): gaps, blank, duplicate, truncated, illegal, cost and audit.

    Rows are taken by turn, nulls first; rows of one turn by role, then by the digest of role and
    text. Rows without a conv_id are one conversation, without an id. A conversation all of whose
    rows are gone has zeros and an empty audit. An empty table gives an empty one.
    """
    key = dict(rows.dtypes)["conv_id"]
    schema = ", ".join([f"conv_id {key}", *(f"{c} {t}" for c, t in FOUND)])
    return _narrow(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest").mapInArrow(_judged, schema)


def _meeting(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's row of ``found``, then its rows in order, in one partition."""
    columns = [c for c, _ in FOUND]
    null = lambda kind: F.lit(None).cast(kind)
    heads = found.select("conv_id", F.lit(0).alias("which"), null("long").alias("turn"), null("string").alias("role"), null("string").alias("text"), null("binary").alias("digest"), *columns)
    tails = rows.where("not gone").select("conv_id", F.lit(1).alias("which"), "turn", "role", "text", _digest(), *(null(t).alias(c) for c, t in FOUND))
    order = (F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), "digest")
    return heads.union(tails).repartition("conv_id").sortWithinPartitions("conv_id", "which", *order)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """(row of ``found``, iterator over its conversation's rows); rows that were not asked for are passed over."""
    flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    ahead = next(flat, None)

    def mine() -> Iterator[tuple[str, str]]:
        nonlocal ahead
        while (ahead := next(flat, None)) is not None and ahead[1] == 1:
            yield ahead[3], ahead[4]

    while ahead is not None:
        head, rows = ahead, mine()
        yield (head[0], *head[6:]), rows
        for _ in rows:
            pass


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = ((head[0], place, *row) for head, own in _met(batches) for place, row in enumerate(applied(iter(head[-1]), own)))
    return _batches(rows, schema)


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def results() -> Iterator[tuple]:
        for head, own in _met(batches):
            h = hashlib.sha256()
            for place, (_, role, text) in enumerate(applied(iter(head[-1]), own)):
                h.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield *head, h.hexdigest()

    return _batches(results(), schema)


def _key_type(rows: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return dict(rows.dtypes)["conv_id"], to_arrow_type(rows.schema["conv_id"].dataType)


def repair(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (I, K or R), role, text, by the audits of ``diagnose``."""
    name, kind = _key_type(rows)
    schema = pa.schema([("conv_id", kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return _meeting(rows, found).mapInArrow(lambda b: _repaired(b, schema), f"conv_id {name}, place long, edit string, role string, text string")


def with_hash(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with repaired_sha256: of the repaired conversation's ``role:text``, joined by newlines."""
    name, kind = _key_type(rows)
    schema = _results(kind, "repaired_sha256")
    columns: Callable = lambda b: _hashed(b, schema)
    return _meeting(rows, found).mapInArrow(columns, ", ".join([f"conv_id {name}", *(f"{c} {t}" for c, t in FOUND), "repaired_sha256 string"]))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = damage(turns(table(spark, sf_dir, "conversations")))
    return with_hash(rows, cut(diagnose(rows), "audits"))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}


def _sql() -> str:
    """The same by the cheapest (cost, letters) of each state after each row, for small tables."""
    least = lambda *of: "list_min([" + ", ".join(of) + "])"
    step = lambda state, cost, letter: f"{{'c': s[{state + 1}].c + {cost}, 'a': s[{state + 1}].a || '{letter}'}}"
    into = lambda state: [p for p in range(STATES) if NEXT[p] == state]
    never = 1 << 40
    keeps = lambda p, j: " OR ".join(f"k % 4 = {r}" for (q, r), to in KEEP.items() if (q, to) == (p, j)) or "false"
    late = f"CASE WHEN k // 4 = {TRUNCATED} THEN {UNFINISHED} ELSE 0 END"
    inserts = ", ".join(least(f"s[{j + 1}]", *(step(p, INSERT, "I") for p in into(j))) for j in range(STATES))
    edits = ", ".join(
        least(
            step(j, DELETE, "D"),
            *(step(p, f"CASE WHEN k // 4 <> {GOES} AND ({keeps(p, j)}) THEN {late} ELSE {never} END", "K") for p in range(STATES) if keeps(p, j) != "false"),
            *(step(p, f"CASE WHEN k // 4 <> {GOES} THEN {RENAME} + {late} ELSE {never} END", "R") for p in into(j)),
        )
        for j in range(STATES)
    )
    start = ", ".join(f"{{'c': {0 if j == START else never}::BIGINT, 'a': ''}}" for j in range(STATES))
    return rf"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i) AS v FROM range(256) r(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce([ascii(c)::BIGINT FOR c IN string_split(key, '')], lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS f FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy, f = 0 AS gone FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS pos FROM d WHERE NOT gone),
j AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, strpos('sua', left(role, 1)) AS place, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
n AS (SELECT *, CASE WHEN place = 0 OR initial = '' THEN 3 ELSE place - 1 END + CASE WHEN blank OR again THEN 4 * {GOES} WHEN cut THEN 4 * {TRUNCATED} ELSE 0 END AS kind FROM j),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
  count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
  list(kind ORDER BY pos) AS kinds, list(role ORDER BY pos) AS roles, list(text ORDER BY pos) AS texts FROM n GROUP BY conv_id),
p AS (SELECT *, list_reduce(flatten([[12, 12, x] FOR x IN kinds]) || [12, 12], lambda s, k: CASE WHEN k = 12 THEN [{inserts}] ELSE [{edits}] END, [{start}]) AS s FROM g),
b AS (SELECT *, list_min([s[{ACCEPTING[0] + 1}], s[{ACCEPTING[1] + 1}]]) AS best FROM p),
e AS (SELECT *, list_reduce(string_split(best.a, ''), lambda w, l: {{
  'i': w.i + CASE WHEN l = 'I' THEN 0 ELSE 1 END,
  'st': CASE WHEN l = 'D' THEN w.st WHEN l = 'K' THEN strpos('sua', left(roles[w.i], 1)) ELSE CASE WHEN w.st = 2 THEN 3 ELSE 2 END END,
  'out': CASE WHEN l = 'D' THEN w.out ELSE w.out || [CASE WHEN l = 'K' THEN roles[w.i] WHEN w.st = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN l = 'I' THEN '' ELSE texts[w.i] END] END
  }}, {{'i': 1::BIGINT, 'st': 0::BIGINT, 'out': []::VARCHAR[]}}) AS walk FROM b)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(CASE WHEN coalesce(best.a, '') = '' THEN '' ELSE array_to_string(walk.out, chr(10)) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


SQL = {"op11_conversation_repair": _sql()}
