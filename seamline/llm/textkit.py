"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Every function handles a whole chunk of rows at once with numpy; a chunk is a
run of rows holding a bounded number of bytes (a longer text stands alone), so
memory does not grow with the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MIX1, _MIX2, _GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 one); uint64 in and out."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, U64) + _GOLD
        x = (x ^ (x >> U64(30))) * _MIX1
        x = (x ^ (x >> U64(27))) * _MIX2
        return x ^ (x >> U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix64(np.arange(n, dtype=U64) + U64(salt) * U64(1_000_003))


#: One random value per byte for the polynomial word hash.
_BYTE = seeds(256, 11)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, U64), "inv": np.ones(1, U64)}

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Word characters where punctuation separates: ASCII letters and every byte of a non-ASCII character.
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[65:91] = LETTER[128:] = True


def _grown(name: str, base: int, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())  # chunks hold a power of two at most, so this seldom grows again
        step = np.full(size, base, U64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[name] = np.multiply.accumulate(step)
    return have[:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes and ``rows`` rows each, at least one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, lo + rows, max(hi, lo + 1))
        yield lo, hi
        lo = hi


class Words:
    """The words of a chunk of texts: byte ranges, 64-bit hashes, and each text's range of words.

    ``keep`` marks the bytes that belong to words; a word never crosses texts.
    A-Z are lower-cased first when ``fold`` is set. ``table`` holds a random value
    for each byte; another table gives hashes that collide elsewhere.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None, fold: bool = True, salt: int = 0, table: np.ndarray = _BYTE):
        self.low = low = FOLD[raw] if fold else raw
        inside = ~SPACE[low] if keep is None else keep[low]
        n = len(low)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)  # of each text, and the end
        if len(self.start):
            with np.errstate(over="ignore"):
                x = table[low]
                x *= _grown("p", _P, n)
                x[~inside] = 0
                h = np.add.reduceat(x, self.start)
                h *= _grown("inv", _PINV, n)[self.start]
                h += (self.end - self.start).astype(U64) * _MIX1 + U64(salt)
            self.hash = mix64(h)
        else:
            self.hash = np.empty(0, U64)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int) -> str:
        return self.low[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def hash_word(word: str, salt: int = 0) -> int:
    """The hash that ``Words`` gives this (already lower-cased) word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Words(raw, np.array([0, len(raw)]), keep=np.ones(256, bool), fold=False, salt=salt).hash[0])


def window_hash(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hash of every ``n`` consecutive items of ``h`` (len(h) - n + 1 values)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    out = np.zeros(m, U64)
    with np.errstate(over="ignore"):
        for k, s in enumerate(seeds(n, salt)):
            out += h[k : k + m] * (s | U64(1))
    return mix64(out)


def sub_buffers(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    return raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def column_chunks(batch: pa.RecordBatch, name: str, limit: int = 1 << 20, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row from, row to, bytes, offsets) of a batch's string column, chunk by chunk."""
    raw, offsets = string_buffers(batch.column(batch.schema.get_field_index(name)))
    for lo, hi in row_chunks(offsets, limit, rows):
        yield (lo, hi, *sub_buffers(raw, offsets, lo, hi))
