"""Fill-in-middle documents by a piece table.

A document is a list of descriptors (buffer, start, end) over two immutable buffers: its text and
the sentinels. Cutting splits descriptors, an arrangement permutes them among sentinels, and the
output is what the descriptors name, in order; no part of a text is changed or joined before that.
To restore, the output is read as a text buffer of its own: it is cut at its sentinels, the
sentinels' descriptors fall away and the inverse permutation puts the others in order. Hashes are
fed descriptor by descriptor.

Texts stay UTF-8 in Arrow's buffers. All delimiters are ASCII, so places in bytes cut between
characters. Everything is done where the rows lie, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import words as W
from foliant.llm.storage import table

#: Order of the parts (0 prefix, 1 middle, 2 suffix) in each form, and the sentinel before each part by its place.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
LEADS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}
TEXT, SENTINELS = 0, 1


class Plan(NamedTuple):
    """seed: of the draws; fim, spm: percent of documents rearranged, and of those in spm; sentinels: before prefix, suffix, middle."""

    seed: int = 42
    fim: int = 50
    spm: int = 80
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def marks(self) -> list[bytes]:
        return [s.encode() for s in self.sentinels]


class Piece(NamedTuple):
    buffer: int
    start: int
    end: int


class PieceTable:
    """Descriptors over immutable buffers."""

    __slots__ = ("buffers", "pieces")

    def __init__(self, *buffers: memoryview, pieces: list[Piece] | None = None):
        self.buffers = buffers
        self.pieces = [Piece(TEXT, 0, len(buffers[TEXT]))] if pieces is None else pieces

    def cut(self, *places: int) -> PieceTable:
        """Splits at places of the content, in ascending order; a place at a border makes an empty piece."""
        out, at, left = [], 0, list(places)
        for p in self.pieces:
            while left and left[0] <= at + p.end - p.start:
                middle = p.start + left.pop(0) - at
                out.append(p._replace(end=middle))
                at += middle - p.start
                p = p._replace(start=middle)
            out.append(p)
            at += p.end - p.start
        return PieceTable(*self.buffers, pieces=out)

    def permuted(self, order: tuple[int, ...]) -> PieceTable:
        return PieceTable(*self.buffers, pieces=[self.pieces[i] for i in order])

    def led_by(self, leads: list[Piece]) -> PieceTable:
        """A piece of ``leads`` before each piece."""
        return PieceTable(*self.buffers, pieces=[x for pair in zip(leads, self.pieces) for x in pair])

    def stream(self) -> Iterator[memoryview]:
        for b, start, end in self.pieces:
            yield self.buffers[b][start:end]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for part in self.stream():
            h.update(part)
        return h.hexdigest()

    def text(self) -> bytes:
        return b"".join(self.stream())


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(order.index(i) for i in range(len(order)))


def arranged(text: memoryview, form: str, a: int, b: int, marks: list[bytes]) -> PieceTable:
    """The document in a form, prefix to byte a, middle to byte b."""
    whole = PieceTable(text, memoryview(b"".join(marks)))
    if form == "plain":
        return whole
    ends = np.cumsum([len(m) for m in marks]).tolist()
    leads = [Piece(SENTINELS, ends[i] - len(marks[i]), ends[i]) for i in LEADS[form]]
    return whole.cut(a, b).permuted(ORDERS[form]).led_by(leads)


def restored(output: bytes, form: str, marks: list[bytes]) -> PieceTable:
    """The document's text, from its output and form alone.

    No sentinel occurs in a rearranged document, nor across the border of a text and a sentinel
    (a sentinel's first character occurs in it once), so the first of each is the one put there.
    """
    whole = PieceTable(memoryview(output))
    if form == "plain":
        return whole
    places, at = [], 0
    for i in LEADS[form]:
        at = output.index(marks[i], at)
        places += [at, at + len(marks[i])]
        at += len(marks[i])
    # pieces: nothing, then sentinel and part by turns
    parts = PieceTable(*whole.buffers, pieces=whole.cut(*places).pieces[2::2])
    return parts.permuted(inverse(ORDERS[form]))


def draws(doc_id: int, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4))


def _token_ends(data: np.ndarray, offs: np.ndarray) -> Callable[[int], np.ndarray]:
    """For text i, where its tokens end, after a 0: words with the blanks before them, and the blanks at the end."""
    w = W.Words(data, offs, W.EXACT)

    def ends(i: int) -> np.ndarray:
        own = w.end[w.first[i] : w.first[i + 1]] - offs[i]
        size = offs[i + 1] - offs[i]
        tail = [size] if size > (own[-1] if len(own) else 0) else []
        return np.r_[0, own, tail].astype(np.int64)

    return ends


def _arrange(plan: Plan) -> Callable:
    marks = plan.marks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in W.chunks(batches, "text"):
            ids = batch.column(0).to_pylist()
            ends = _token_ends(data, offs)
            chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            raw = data.tobytes()
            view, rows = memoryview(raw), []
            for i, doc_id in enumerate(ids):
                lo, hi = int(offs[i]), int(offs[i + 1])
                text, tokens = view[lo:hi], ends(i)
                n, form, a, b = len(tokens) - 1, "plain", 0, 0
                if doc_id is not None and n:
                    h1, h2, h3, h4 = draws(doc_id, plan.seed)
                    if h3 % 100 < plan.fim and not any(raw.find(m, lo, hi) >= 0 for m in marks):
                        form = "spm" if h4 % 100 < plan.spm else "psm"
                        a, b = (int(tokens[x]) for x in sorted((h1 % (n + 1), h2 % (n + 1))))
                pieces = arranged(text, form, a, b, marks)
                moved = form != "plain"
                rows.append(
                    (
                        doc_id, n, form, int(chars[lo + a] - chars[lo]) if moved else None, int(chars[lo + b] - chars[lo + a]) if moved else None,
                        pieces.text(), pieces.sha256(),
                    )
                )
            yield _batch(rows, ARRANGED)

    return run


ARRANGED = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("output_sha256", pa.string())]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([_column(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if values and isinstance(values[0], bytes) and pa.types.is_string(kind):
        return pa.array(values, pa.binary()).view(kind)
    return pa.array(values, kind)


def _restore(marks: list[bytes], what: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            output, form = (batch.column(batch.schema.get_field_index(c)) for c in ("output", "form"))
            pieces = (restored(o.as_py() or b"", f or "plain", marks) for o, f in zip(output.cast(pa.binary()), form.to_pylist()))
            found = [p.sha256() if what == "restored_sha256" else p.text() for p in pieces]
            kept = [batch.column(i) for i, f in enumerate(batch.schema.names) if f != "output"]
            names = [f for f in batch.schema.names if f != "output"]
            yield pa.RecordBatch.from_arrays([*kept, _column(found, pa.string())], [*names, what])

    return run


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row a row of docs (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output, output_sha256.

    n counts tokens: a word with the white space before it, or white space at the end. Null text
    is empty text, and stays plain, as does a row without a doc_id (nothing to draw by) and a text
    that holds a sentinel. Rows that repeat a doc_id are cut by the same draws, each by its own n.
    Columns beyond those two, whatever their names, are not read. An empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(_arrange(plan), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")


def restore(moved: DataFrame, plan: Plan = Plan(), what: str = "text") -> DataFrame:
    """The rows of ``moved`` (with output and form, and other columns) with the text that they came
    from in place of the output; as ``what`` = restored_sha256 its hash only.

    Null output is empty, null form plain. An output that lacks a sentinel of its form is an error.
    """
    kept = [f"`{c}` {t}" for c, t in moved.dtypes if c != "output"]
    return moved.mapInArrow(_restore(plan.marks(), what), ", ".join([*kept, f"{what} string"]))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return restore(fill_in_middle(table(spark, sf_dir, "documents")), what="restored_sha256")


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
SQL = {
    "op13_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  sha256('42:' || doc_id) AS h FROM documents),
c AS (SELECT *, len(w)::BIGINT AS n, [('0x' || substr(h, 1, 8))::BIGINT % (len(w) + 1), ('0x' || substr(h, 9, 8))::BIGINT % (len(w) + 1)] AS ab,
  ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR coalesce(h3 >= 50, true) THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(w[1:list_min(ab)], '') AS p, array_to_string(w[list_min(ab) + 1:list_max(ab)], '') AS m, array_to_string(w[list_max(ab) + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f
""",
}
