"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns (e-mail, IPv4, card, phone) give the base spans. The random field adds what is
written differently: national phone numbers, cards with other separators, spelled-out e-mail
addresses. It is trained by maximum likelihood (forward-backward, gradient steps) from a small
labelled table of made-up sentences, on the driver. Tasks decode whole texts by Viterbi in numpy:
lines are the sequences, and sequences of like length are decoded together. A long line is cut
at words that have one and the same tag in the best paths between all tags some words before and
all tags some words after, and so in the best path of the line; the parts are then decoded side
by side. The tags are those of the best path over the whole line, however long.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import words as W
from foliant.llm.storage import table

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
FEATURES, TEMPLATES = 1 << 12, 7
#: Words between places where a long line may be cut, words on either side that decide it, and parts that are decoded together.
PART, AROUND, TOGETHER = 96, 8, 1024

# Fixed patterns of the base spans.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by kind, then start; time is linear in the text."""
    out: list[tuple[str, int, int]] = []
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            done = m.end()
    for m in _IP.finditer(text):
        parts = m.group().split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# ---- word shapes -------------------------------------------------------------------------

_CLASS = np.full(256, 9, dtype=np.int64)
for _i, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "@", ".", "-", "+", "()[]<>", ":/=_\"'")):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[128:] = 10
_CLASS_VALUE = W.constants(16, 51)


class Shapes:
    """Words of texts with their shape features; sequences are lines."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        w = self.words = W.Words(data, offs, W.EXACT)
        n = len(w.start)
        cls = _CLASS[data]
        run = np.ones(len(data), dtype=bool)
        run[1:] = cls[1:] != cls[:-1]
        run[w.start] = True
        rank = np.cumsum(run)
        p, q = W._powers(int(rank[-1]) + 2 if len(rank) else 2)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(np.where(run, _CLASS_VALUE[cls] * p[rank], np.uint64(0)), out=total[1:])
        shape = W.mix((total[w.end] - total[w.start]) * q[rank[w.start]] if n else np.empty(0, np.uint64))
        digits = np.r_[0, np.cumsum(cls == 2)]
        self.digits = (digits[w.end] - digits[w.start]).astype(np.int64)
        size = np.minimum(self.digits, 20) * 8 + np.minimum(np.log2(np.maximum(w.end - w.start, 1)).astype(np.int64), 7)
        # lines: a newline byte between two words, or another text, starts a new sequence
        lines = np.r_[0, np.cumsum(data == 10)]
        new = np.ones(n, dtype=bool)
        if n:
            new[1:] = (w.doc[1:] != w.doc[:-1]) | (lines[w.start[1:]] != lines[w.start[:-1]])
        self.sequence = np.flatnonzero(new)
        none = np.uint64(1)

        def beside(x):
            """Of the words before and after each."""
            before, after = np.full(n, none), np.full(n, none)
            if n:
                before[1:] = np.where(new[1:], none, x[:-1])
                after[:-1] = np.where(new[1:], none, x[1:])
            return before, after

        known = w.hash
        parts = (shape, *beside(shape), size.astype(np.uint64) + np.uint64(7), known, *beside(known))
        salts = W.constants(TEMPLATES, 52)
        self.features = np.stack([(W.mix(x * s) >> np.uint64(52)).astype(np.int32) for x, s in zip(parts, salts)], axis=1) if n else np.empty((0, TEMPLATES), np.int32)


# ---- the random field --------------------------------------------------------------------


class Field:
    """weights (TEMPLATES * FEATURES, tags), transitions (tags, tags), start (tags)."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, start: np.ndarray):
        self.weights, self.transitions, self.start = weights, transitions, start

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return sum(self.weights[t * FEATURES + features[..., t]] for t in range(TEMPLATES))

    def viterbi(self, emission: np.ndarray, lengths: np.ndarray, start: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Best tags (sequences, steps) of padded emissions (sequences, steps, tags).

        start: scores of the first tags, by sequence; last: the last tags, -1 where they are free.
        """
        s, steps, k = emission.shape
        back = np.zeros((steps, s, k), dtype=np.int8)
        score = (self.start if start is None else start) + emission[:, 0]
        for t in range(1, steps):
            best, came = self._after(score[:, None, :])
            back[t] = came[:, 0]
            score = np.where((t < lengths)[:, None], best[:, 0] + emission[:, t], score)
        tags = np.zeros((s, steps), dtype=np.int8)
        tag = score.argmax(axis=1)
        if last is not None:
            tag = np.where(last >= 0, last, tag)
        row = np.arange(s)
        for t in range(steps - 1, -1, -1):
            inside = t < lengths
            tags[inside, t] = tag[inside]
            if t:
                tag = np.where(inside, back[t, row, tag], tag)
        return tags

    def _after(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best score of each next tag, the tag before it) from scores (sequences, rows, tags)."""
        best = score[:, :, 0, None] + self.transitions[0]
        came = np.zeros(best.shape, dtype=np.int8)
        for m in range(1, len(self.start)):
            other = score[:, :, m, None] + self.transitions[m]
            came[other > best] = m
            np.maximum(best, other, out=best)
        return best, came

    def certain(self, emission: np.ndarray) -> np.ndarray:
        """Of each row of 2 * AROUND + 1 words the middle word's tag, if all best paths through it agree, else -1."""
        s, _, k = emission.shape
        to = np.broadcast_to(self.transitions, (s, k, k)) + emission[:, 0, None, :]
        for t in range(1, AROUND + 1):
            to = self._after(to)[0] + emission[:, t, None, :]
        on = np.broadcast_to(self.transitions, (s, k, k)) + emission[:, 2 * AROUND, None, :]
        for t in range(2 * AROUND - 1, AROUND, -1):
            on = np.max(self.transitions[None, :, :, None] + (emission[:, t, :, None] + on)[:, None, :, :], axis=2)
        tags = (to[:, :, :, None] + on[:, None, :, :]).argmax(axis=2).reshape(s, -1)
        return np.where((tags == tags[:, :1]).all(axis=1), tags[:, 0], -1)

    def decode(self, shapes: Shapes) -> np.ndarray:
        """Tag of every word."""
        out = np.zeros(len(shapes.words.start), dtype=np.int8)
        first = shapes.sequence
        end = np.r_[first[1:], len(out)]
        cuts = [np.arange(a + PART, b - AROUND, PART) for a, b in zip(first, end) if b - a > PART + AROUND]
        cuts = np.concatenate(cuts) if cuts else np.empty(0, np.int64)
        found = [self.certain(self.emissions(shapes.features[c[:, None] + np.arange(-AROUND, AROUND + 1)])) for c in (cuts[i : i + TOGETHER] for i in range(0, len(cuts), TOGETHER))]
        tags = np.concatenate(found) if found else np.empty(0, np.int64)
        cuts, tags = cuts[tags >= 0], tags[tags >= 0]
        # parts end with the words that are certain
        at = np.sort(np.r_[first, cuts + 1])
        n = np.diff(np.r_[at, len(out)])
        before, last = np.full(len(at), -1), np.full(len(at), -1)
        begins = np.searchsorted(at, cuts + 1)
        before[begins] = tags
        last[begins - 1] = tags
        order = np.argsort(n, kind="stable")
        for i in range(0, len(order), TOGETHER):
            rows = order[i : i + TOGETHER]
            start = np.where((before[rows] < 0)[:, None], self.start[None], self.transitions[before[rows]])
            index = np.minimum(at[rows, None] + np.arange(int(n[rows].max())), len(out) - 1)
            got = self.viterbi(self.emissions(shapes.features[index]), n[rows], start, last[rows])
            inside = np.arange(got.shape[1])[None] < n[rows, None]
            out[index[inside]] = got[inside]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(rows: list[tuple[str, list[str]]], steps: int = 90, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood from (sentence, tags of its words) by Adam on full gradients."""
    text = "\n".join(s for s, _ in rows)
    data = np.frombuffer(text.encode(), np.uint8)
    shapes = Shapes(data, np.array([0, len(data)]))
    lengths = np.array([len(t) for _, t in rows])
    s, t_max, k = len(rows), int(lengths.max()), len(TAGS)
    at = np.minimum(shapes.sequence[:, None] + np.arange(t_max), len(shapes.features) - 1)
    ids = shapes.features[at] + np.arange(TEMPLATES) * FEATURES
    gold = np.zeros((s, t_max), dtype=int)
    for i, (_, tags) in enumerate(rows):
        gold[i, : len(tags)] = [TAGS.index(x) for x in tags]
    inside = np.arange(t_max)[None] < lengths[:, None]
    field = Field(np.zeros((TEMPLATES * FEATURES, k)), np.zeros((k, k)), np.zeros(k))
    params = [field.weights, field.transitions, field.start]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    one = np.eye(k)
    for step in range(1, steps + 1):
        e = field.weights[ids].sum(axis=2)
        alpha, beta = np.zeros((s, t_max, k)), np.zeros((s, t_max, k))
        alpha[:, 0] = field.start + e[:, 0]
        for t in range(1, t_max):
            new = _log_sum(alpha[:, t - 1, :, None] + field.transitions, 1) + e[:, t]
            alpha[:, t] = np.where(inside[:, t, None], new, alpha[:, t - 1])
        for t in range(t_max - 2, -1, -1):
            new = _log_sum(field.transitions + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(inside[:, t + 1, None], new, 0.0)
        z = _log_sum(alpha[:, -1], 1)
        post = np.exp(alpha + beta - z[:, None, None]) * inside[..., None]
        diff = one[gold] * inside[..., None] - post
        g_w = np.zeros_like(field.weights)
        for f in range(TEMPLATES):
            np.add.at(g_w, ids[:, :, f], diff)
        g_t = np.zeros((k, k))
        for t in range(1, t_max):
            pair = np.exp(alpha[:, t - 1, :, None] + field.transitions + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
            g_t += ((one[gold[:, t - 1]][:, :, None] * one[gold[:, t]][:, None, :] - pair) * inside[:, t, None, None]).sum(axis=0)
        g_s = diff[:, 0].sum(axis=0)
        for p, g, mm, vv in zip(params, (g_w, g_t, g_s), m, v):
            g = g / s - decay * p
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            p += rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    return field


def labelled_table(rows: int = 900, seed: int = 9) -> list[tuple[str, list[str]]]:
    """Made-up sentences with tagged words: every second one holds a span among plain words."""
    r = random.Random(seed)
    syllables = "ba ke li mo nu ra se ti vo za er an on st th sch ung ción é ñ è ü ß ñe éa".split()
    plain_name = [x for x in syllables if x.isascii()]

    def d(n):
        return "".join(r.choice("0123456789") for _ in range(n))

    def word():
        w = "".join(r.choice(syllables) for _ in range(r.choice((1, 2, 2, 3, 3, 4, 5, 7))))
        return r.choice((w, w, w, w, w.capitalize(), w + ",", w + ".", w.upper(), w + r.choice(("&&&", "***", "###", "$$$", "%%%", "!", "?", ":", ";")), "|", f"({w})", f"[{w}]", f"{w}-{w}", f"{w}/{w}", "at", "dot", "no", "a"))

    def name():
        return "".join(r.choice(plain_name) for _ in range(2)) + r.choice(("", d(2), "." + r.choice(plain_name), "_" + r.choice(plain_name)))

    def checked():
        body = d(15)
        return next(body + x for x in "0123456789" if luhn(body + x))

    def fours(sep):
        c = checked()
        return sep.join(c[i : i + 4] for i in range(0, 16, 4))

    site = lambda: "".join(r.choice(plain_name) for _ in range(r.choice((1, 2))))
    spans = {
        "email": (
            lambda: f"{name()}@{site()}.example.com", lambda: f"{name()} [at] {site()}.{r.choice(('com', 'net', 'org', 'example.org'))}", lambda: f"{name()} (at) {site()} (dot) example",
            lambda: f"{name()} [at] {site()} [dot] com", lambda: f"{name()}(at){site()}.net", lambda: f"{name()}[at]{site()}[dot]org",
        ),
        "ip": (lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), lambda: f"[{'.'.join(str(r.randint(1, 255)) for _ in range(4))}]"),
        "card": (checked, lambda: fours("."), lambda: fours("/"), lambda: fours(" "), lambda: fours("_")),
        "phone": (
            lambda: f"+{r.randint(1, 9)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}",
            lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"({d(3)}){d(3)}-{d(4)}", lambda: f"{d(3)}/{d(3)}-{d(4)}",
        ),
    }
    plain = (
        lambda: d(r.randint(1, 6)),
        lambda: f"{d(1)}.{d(1)}.{d(1)}",
        lambda: f"20{d(2)}-{d(2)}-{d(2)}",
        lambda: f"${d(2)}.{d(2)}",
        lambda: f"{d(1)},{d(3)},{d(3)}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((18, 32, 40)))),
        lambda: "key=" + "".join(r.choice("0123456789ABCDEFGHJK") for _ in range(16)),
        lambda: d(r.choice((9, 11, 12, 20, 24))),
        lambda: f"{r.choice(syllables)}%%%",
        lambda: f"{d(2)}:{d(2)}",
        lambda: f"{d(3)}-{d(4)}",
        lambda: f"({d(4)})",
        lambda: f"http://{site()}.example.com/{site()}",
        lambda: f"{site()}.example.org",
        lambda: f"@{site()}",
    )
    out = []
    for i in range(rows):
        words = [word() for _ in range(r.randint(0, 7))]
        tags = ["O"] * len(words)
        if i % 2 == 0:
            kind = KINDS[i // 2 % 4]
            span = r.choice(spans[kind])().split()
            span[-1] += r.choice(("", "", "", ".", ",", "%%%", "$$$", ";"))
            words += span
            tags += [f"B-{kind}"] + [f"I-{kind}"] * (len(span) - 1)
        else:
            words.append(r.choice(plain)())
            tags.append("O")
        more = [word() for _ in range(r.randint(0, 6))]
        out.append((" ".join(words + more), tags + ["O"] * len(more)))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


_TRIM_LEFT, _TRIM_RIGHT = "\"'<[{,;:", ".,;:!?\"'>]}&*#$%"


def _valid(kind: str, span: str) -> bool:
    """Arithmetic that a span of the field has to meet: a card's check digit, the parts of an address; none for others."""
    if kind == "card":
        return luhn(_digits(span))
    if kind == "ip":
        return all(int(p or 256) <= 255 for p in re.sub(r"[^0-9.]", "", span).strip(".").split("."))
    return True


def _find(field: Field, data: np.ndarray, offs: np.ndarray) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text, in code points."""
    shapes = Shapes(data, offs)
    w = shapes.words
    tags = field.decode(shapes)
    raw = data.tobytes()
    special = np.r_[0, np.cumsum((data == 64) | ((data >= 48) & (data <= 57)))]
    point = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    marked = np.flatnonzero(tags)
    by_doc = np.searchsorted(marked, w.first)
    out = []
    for d, (a, b) in enumerate(zip(offs[:-1], offs[1:])):
        base = base_spans(raw[a:b].decode()) if special[b] > special[a] else []
        added = []
        i, end = by_doc[d], by_doc[d + 1]
        while i < end:
            j = i + 1
            kind = (tags[marked[i]] - 1) // 2
            while j < end and marked[j] == marked[j - 1] + 1 and tags[marked[j]] == 2 * kind + 2:
                j += 1
            lo, hi = w.start[marked[i]], w.end[marked[j - 1]]
            text = raw[lo:hi].decode()
            cut_left = len(text) - len(text.lstrip(_TRIM_LEFT))
            body = text[cut_left:].rstrip(_TRIM_RIGHT)
            start = int(point[lo] - point[a]) + cut_left
            if body and _valid(KINDS[kind], body) and not any(s < start + len(body) and start < e for _, s, e in base):
                added.append((KINDS[kind], start, start + len(body)))
            i = j
        out.append((base, added))
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def _report(field: Field):
    def run(batches):
        for batch, data, offs in W.chunks(batches, "_text"):
            found = _find(field, data, offs)
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in KINDS]
            sha = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            spans = [_joined([*base, *added]) for base, added in found]
            more = pa.array([len(added) for _, added in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array(spans, pa.string()), more], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return run


def _redact(field: Field):
    def run(batches):
        for batch, data, offs in W.chunks(batches, "_text"):
            raw = data.tobytes()
            texts = []
            for (a, b), (base, added) in zip(zip(offs[:-1], offs[1:]), _find(field, data, offs)):
                text = raw[a:b].decode()
                out, at = [], 0
                for kind, s, e in sorted([*base, *added], key=lambda x: (x[1], -x[2])):
                    if e > at:
                        out += [text[at : max(at, s)], f"<{kind}>"] if s >= at else []
                        at = max(at, e)
                texts.append("".join([*out, text[at:]]))
            i = batch.schema.get_field_index("_text")
            yield batch.set_column(i, "_text", pa.array(texts, pa.string()))

    return run


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 are of the base spans; spans holds all, n_added counts those of
    the random field. docs has ``doc_id`` and ``text``; other columns are not read. Null text is
    empty text and has no spans. Null doc_ids are kept and rows that repeat are judged each. An
    added span never overlaps a base span. An empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(_report(field or default_field()), f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long")


def redact_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with every span of ``text`` replaced by ``<kind>``.

    Other columns stay, whatever their names; null text stays null. Rows that repeat are
    redacted each. An empty table gives an empty one.
    """
    # the caller's columns travel in a struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    done = rows.mapInArrow(_redact(field or default_field()), rows.schema)
    shown = [F.when(F.col("_row.text").isNotNull(), F.col("_text")).alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns]
    return done.select(*shown)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


QUERIES = {"op9_pii": op9_pii}
SQL: dict[str, str] = {}
