"""Words and shingles of whole Arrow string columns as numpy arrays.

A column's UTF-8 bytes are hashed without making a Python object for any word:
byte tables lower-case A-Z and mark blanks (0x20 and 0x09-0x0D), a running
polynomial sum modulo 2^64 gives every word's hash from its two ends.  Nulls
count as empty texts.  `slices` bounds what is held at once: some MB of text,
or one text if that is longer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64
_PRIME = 0x9E3779B97F4A7C55


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_BYTE_LOWER = _BYTE[LOWER]
_tables = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _tables["n"] < n:
        size = max(SLICE_BYTES + 2, n + n // 4)
        inverse = pow(_PRIME, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for key, base in (("up", _PRIME), ("down", inverse)):
                table = np.full(size, base, _U)
                table[0] = 1
                _tables[key] = np.multiply.accumulate(table)
        _tables["n"] = size
    return _tables["up"], _tables["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's first byte, with one offset more."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """Pieces (first row, array) of a column, each of at most `most` bytes or one text."""
    _, at = utf8(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, column.slice(first, last - first)
        first = last


def gathered(batches, column: int, most: int = 4 << 20):
    """Arrow batches joined until the column has `most` bytes: what is done once a batch is then done for many texts."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.column(column).nbytes
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@dataclass
class Words:
    """Words of a slice: hash, first byte and end by word; the first word of each text, with one more."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    at: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(column: pa.Array, blank: np.ndarray = BLANK, lower: bool = True) -> Words:
    data, at = utf8(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, _U), none, none, np.zeros(len(at), np.int64), data, at)
    gap = blank[data]
    edges = at[:-1][at[:-1] < len(data)]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1]
    before[edges] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, gap[1:]
    after[edges[edges > 0] - 1] = True
    start = np.flatnonzero(before & ~gap)
    end = np.flatnonzero(after & ~gap) + 1
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, _U)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        h = mix(h + (end - start).astype(_U) * _U(0xA24BAED4963EE407))
    return Words(h, start, end, np.searchsorted(start, at), data, at)


def hash_bytes(text: bytes, lower: bool = False) -> int:
    """The hash that words() gives a word of these bytes."""
    found = words(pa.array([text], pa.binary()), np.zeros(256, bool), lower)
    return int(found.hash[0]) if len(found.hash) else 0


def shingles(w: Words, k: int = 5) -> list[np.ndarray]:
    """For each text its set of hashes of k following words, sorted; a shorter text's only member is its whole sequence."""
    n = len(w.hash)
    step = _U(0xC6BC279692B5C323)
    counts = np.diff(w.first)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, n - k + 1), _U)
        for j in range(k):
            rolled = rolled * step + w.hash[j : j + len(rolled)]
        rolled = mix(rolled)
    none = np.zeros(0, _U)
    out: list[np.ndarray] = []
    for a, m in zip(w.first[:-1].tolist(), counts.tolist()):
        if m >= k:
            s = np.sort(rolled[a : a + m - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif m:
            with np.errstate(over="ignore"):
                whole = _U(m)
                for x in w.hash[a : a + m]:
                    whole = whole * step + x
            out.append(mix(np.array([whole], _U)))
        else:
            out.append(none)
    return out
