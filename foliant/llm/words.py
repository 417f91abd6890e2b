"""Whole texts as flat numpy columns of words.

Texts come from Arrow as one UTF-8 buffer with offsets. Words are found and hashed for a few
megabytes of documents at a time, without a Python object per word. All delimiters are ASCII,
so working on bytes is the same as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once (numpy columns take some 100 times that); a longer document is handled alone.
CHUNK_BYTES = 1 << 19
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that depend on the seed only."""
    x = (np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1_000_003)) * U64(0x9E3779B97F4A7C15)
    return mix(x) | U64(1)


class Alphabet:
    """Which bytes belong to words, and a hash value per byte (equal for letters folded together)."""

    def __init__(self, inside: np.ndarray, fold_case: bool):
        self.inside = inside
        low = np.arange(256)
        if fold_case:
            low[65:91] += 32
        self.value = constants(256, 11)[low]


def _inside(spaces: bool) -> np.ndarray:
    b = np.arange(256)
    if spaces:
        return ~((b == 0x20) | ((b >= 0x09) & (b <= 0x0D)))
    return (b >= 0x80) | ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x61) & (b <= 0x7A)) | ((b >= 0x41) & (b <= 0x5A))


#: Words [^\x20\x09-\x0D]+, as they are and with A-Z lower-cased.
EXACT = Alphabet(_inside(True), False)
FOLDED = Alphabet(_inside(True), True)
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased.
ALNUM = Alphabet(_inside(False), True)

_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("p", _P), ("q", _P_INV)):
            t = np.full(size, base, dtype=U64)
            t[0] = 1
            _tables[key] = np.multiply.accumulate(t)
    return _tables["p"], _tables["q"]


class Words:
    """start, end: byte ranges; hash: 64 bits a word; doc: index of the text; first: index of each text's first word (one more at the end)."""

    __slots__ = ("start", "end", "hash", "doc", "first")

    def __init__(self, data: np.ndarray, offs: np.ndarray, alphabet: Alphabet):
        inside = alphabet.inside[data]
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offs] = True
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | edge[1:n]
            ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))
        self.hash = self._hashes(data, alphabet)

    def _hashes(self, data: np.ndarray, alphabet: Alphabet) -> np.ndarray:
        out = np.empty(len(self.start), dtype=U64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + CHUNK_BYTES, "right")))
            a, b = int(self.start[i]), int(self.end[j - 1])
            p, q = _powers(b - a + 1)
            total = np.zeros(b - a + 1, dtype=U64)
            np.cumsum(alphabet.value[data[a:b]] * p[: b - a], out=total[1:])
            s, e = self.start[i:j] - a, self.end[i:j] - a
            out[i:j] = mix((total[e] - total[s]) * q[s] + (e - s).astype(U64) * _P)
            i = j
        return out


def grams(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of every k words that follow each other (also across texts); k - 1 fewer than words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    c = constants(k, seed)
    total = np.zeros(n, dtype=U64)
    for j in range(k):
        total += words[j : j + n] * c[j]
    return mix(total)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0 or column.buffers()[1] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about CHUNK_BYTES of text each, with the text's bytes and offsets."""
    for batch in batches:
        data, offs = utf8(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK_BYTES, "right")) - 1)
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def longs(values: np.ndarray) -> pa.Array:
    """64-bit words as Spark's long."""
    return pa.array(values.view(np.int64) if values.dtype == U64 else values.astype(np.int64))
