"""Vectorised text kernels over Arrow string columns: word spans, word hashes, shingle hashes.

A column is worked through in slices of about ``SLICE_BYTES`` of text and at most ``SLICE_ROWS`` rows (one
row at least), so that memory does not depend on the batch.  Hashes are polynomials modulo 2**64 over random byte values, taken from one
running sum, so that no word is ever made into a Python object.  A row may be longer than a slice: its bytes are
walked in pieces of ``SLICE_BYTES``, so that only its words and shingles are held, not the sums over its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_ROWS = 1 << 21, 4096
U = np.uint64
#: Multiplier of the word polynomial (odd, so that it has an inverse) and of the shingle polynomial.
WORD_MUL, SHINGLE_MUL = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))


def _table(kind: str) -> np.ndarray:
    """Which bytes belong to words: all but ASCII white space, or letters, digits and bytes of non-ASCII characters."""
    inside = np.ones(256, dtype=bool)
    if kind == "space":
        inside[[0x20, 9, 10, 11, 12, 13]] = False
    else:
        inside[:128] = [chr(b).isalnum() for b in range(128)]
    return inside


class _Cache(dict):
    """Starts empty wherever it is sent: what it holds is cheaper to compute than to ship with every task."""

    def __reduce__(self):
        return _Cache, ()


_POWERS: dict[int, np.ndarray] = _Cache()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """WORD_MUL ** i and WORD_MUL ** -i for i < n; n is SLICE_BYTES at most, so the cache is bounded."""
    if 0 not in _POWERS or len(_POWERS[0]) < n:
        for key, base in ((0, pow(int(WORD_MUL), -1, 1 << 64)), (1, int(WORD_MUL))):
            p = np.full(n, base, dtype=U)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS[1][:n], _POWERS[0][:n]


def pieces(n: int):
    """(begin, end) of runs of at most SLICE_BYTES bytes."""
    for a in range(0, n, SLICE_BYTES):
        yield a, min(n, a + SLICE_BYTES)


def counts_before(table: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of the sorted positions ``at``, the sum of ``table`` over the bytes before it."""
    out, total = np.zeros(len(at), dtype=np.int64), 0
    for a, b in pieces(len(data)):
        sums = np.cumsum(table[data[a:b]])
        lo, hi = np.searchsorted(at, (a, b), side="right")
        out[lo:hi] = total + sums[at[lo:hi] - a - 1]
        total += int(sums[-1])
    return out


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES):
    """(first row, bytes, offsets) of consecutive rows of a string column; a null row has no bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    if column.null_count:
        column = pc.fill_null(column, "")
        _, off, data = column.buffers()
        offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1
        end = min(n, max(end, row + 1), row + SLICE_ROWS)
        yield row, bytes_[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a slice: ``start``, ``end`` (byte positions), ``doc`` (row in the slice), ``hash``, and ``first`` (per row, its first word; one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str = "space"):
        inside, values, n = _table(kind), _byte_values(), len(data)
        starts, ends, at_start, at_end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, U)]
        inverses, total, scale, inverse_scale = [np.zeros(0, U)], U(0), 1, 1
        for a, b in pieces(n):
            here = inside[data[a:b]]
            before, after = np.empty_like(here), np.empty_like(here)
            before[1:], after[:-1] = here[:-1], here[1:]
            before[0], after[-1] = a > 0 and inside[data[a - 1]], b < n and inside[data[min(b, n - 1)]]
            edge = offsets[(offsets >= a) & (offsets <= b)] - a  # a word never runs over a row's edge
            before[edge[edge < b - a]] = False
            after[edge[edge > 0] - 1] = False
            s, e = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
            up, down = _powers(b - a)
            sums = np.zeros(b - a + 1, dtype=U)
            np.cumsum(values[data[a:b]] * up, out=sums[1:])
            sums = sums * U(scale) + total
            starts.append(s + a)
            ends.append(e + a)
            at_start.append(sums[s])
            at_end.append(sums[e])
            inverses.append(down[s] * U(inverse_scale))
            total = sums[-1]
            scale = scale * pow(int(WORD_MUL), b - a, 1 << 64) % 2**64
            inverse_scale = inverse_scale * pow(int(WORD_MUL), -(b - a), 1 << 64) % 2**64
        self.start, self.end = np.concatenate(starts), np.concatenate(ends)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = mix((np.concatenate(at_end) - np.concatenate(at_start)) * np.concatenate(inverses))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a row, and the rows.  A row of fewer words (one at least) has one run: all its words."""
    h, n = words.hash, len(words.hash)
    counts = np.diff(words.first)
    out_hash, out_doc = [], []
    if n >= size:
        acc = np.zeros(n - size + 1, dtype=U)
        for k in range(size):
            acc = acc * SHINGLE_MUL + h[k : n - size + 1 + k]
        whole = words.doc[: n - size + 1] == words.doc[size - 1 :]
        out_hash.append(acc[whole])
        out_doc.append(words.doc[: n - size + 1][whole])
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        acc = U(0)
        with np.errstate(over="ignore"):
            for x in h[words.first[d] : words.first[d + 1]]:
                acc = acc * SHINGLE_MUL + x
        out_hash.append(np.array([acc ^ U(counts[d])], dtype=U))
        out_doc.append(np.array([d]))
    if not out_hash:
        return np.zeros(0, U), np.zeros(0, np.int64)
    if len(out_hash) == 1:
        return mix(out_hash[0]), out_doc[0]
    doc = np.concatenate(out_doc)
    order = np.argsort(doc, kind="stable")
    return mix(np.concatenate(out_hash))[order], doc[order]


def distinct_weighted(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) with their counts, by row."""
    if not len(hashes):
        return hashes, docs, np.zeros(0)
    order = np.lexsort((hashes, docs))
    h, d = hashes[order], docs[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], d[at], np.diff(np.append(at, len(h))).astype(np.float64)
