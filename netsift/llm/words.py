"""Words, shingles and 64-bit hashes of whole texts, computed on UTF-8 bytes with numpy.

A text column arrives as an Arrow array. Its bytes are classed by a table of 256 entries, so word borders
and A-Z lower-casing are array operations and no word becomes a Python object. Separators are ASCII,
so classing bytes equals classing code points. Work proceeds in pieces of about ``PIECE`` bytes of text
(a longer single text is a piece of its own), whatever the size of the Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 2 << 20
HASH_BYTES = 1 << 16
GIVE_BACK_ROWS = 1000

_SEED = 0x9E3779B97F4A7C15
_U = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words between ASCII white space: [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Runs of letters, digits and non-ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Returns freed memory to the system. Workers live on between stages and else keep what their largest one touched."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def pieces(offsets: np.ndarray, size: int = PIECE, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes and ``rows`` rows, of one row at least. After the last, freed memory goes back."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, at + rows, n)
        yield at, to
        at = to
    if n >= GIVE_BACK_ROWS:
        give_back()


@dataclass
class Words:
    """The words of some rows: byte borders in ``low`` (lower-cased bytes), hashes, n + 1 offsets by row, and those in bytes."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray
    bytes: np.ndarray | None = None

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def word(self, k: int) -> bytes:
        return self.low[self.starts[k] : self.ends[k]].tobytes()


def _hash_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each byte is mixed together with its place in the word, and a word's sum is mixed once more.

    A polynomial over 64-bit numbers would do with less work, but has pairs of plain words with one hash.
    """
    out = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + HASH_BYTES, "right")))
        first, last = int(starts[at]), int(ends[to - 1])
        s, e = starts[at:to] - first, ends[at:to] - first
        place = np.arange(last - first) - np.repeat(s, np.diff(s, append=last - first))
        sums = np.zeros(last - first + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum(mix(((place.astype(_U) << _U(8)) | low[first:last]) + _U(_SEED)), out=sums[1:])
            out[at:to] = mix(sums[e] - sums[s] + (e - s).astype(_U))
        at = to
    return out


def find_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED) -> Words:
    """All words of rows; ``data`` are the rows' bytes and ``offsets`` their borders in it."""
    low = LOWER[data]
    inside = kind[low]
    begins = np.empty(len(low) + 1, bool)
    begins[0] = begins[-1] = False
    before, after = begins[:-1].copy(), begins[1:].copy()
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    before[filled] = False
    after[offsets[1:][np.diff(offsets) > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(low, starts, ends, _hash_words(low, starts, ends), np.searchsorted(starts, offsets, "left"), offsets)


def column_words(column: pa.Array, kind: np.ndarray = SPACED, size: int = PIECE) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) over the pieces of a column."""
    data, offsets = text_bytes(column)
    for a, b in pieces(offsets, size):
        yield a, b, find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], kind)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words, and n + 1 offsets by row. Shorter rows have no window."""
    h = words.hashes
    counts = np.maximum(np.diff(words.rows) - n + 1, 0)
    rows = np.zeros(len(words.rows), np.int64)
    np.cumsum(counts, out=rows[1:])
    first = np.repeat(words.rows[:-1] - rows[:-1], counts) + np.arange(rows[-1])
    out = np.full(len(first), n, _U)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _U(0xD6E8FEB86659FD93) + h[first + k]
    return mix(out), rows


def whole(hashes: np.ndarray) -> int:
    """The hash of a word sequence as one shingle."""
    out = len(hashes)
    for h in hashes.tolist():
        out = (out * 0xD6E8FEB86659FD93 + h) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([out], _U))[0])


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """For each row its sorted distinct n-word shingles; with fewer words the whole sequence as one; empty without words."""
    h, rows = windows(words, n)
    out = []
    for k in range(len(rows) - 1):
        if rows[k + 1] > rows[k]:
            out.append(np.unique(h[rows[k] : rows[k + 1]]))
        else:
            own = words.hashes[words.rows[k] : words.rows[k + 1]]
            out.append(np.array([whole(own)], _U) if len(own) else np.zeros(0, _U))
    return out
