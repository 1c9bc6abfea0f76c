"""Word and gram hashes of whole Arrow text columns, without a Python step per word.

Texts stay in their Arrow buffer.  A word is a run of bytes other than space and
the five ASCII control spaces; A-Z are read as a-z.  Its hash is a polynomial over
random byte values modulo 2**64, read off running sums, then scrambled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 19                       # bytes handled at a time: bounds the temporary arrays
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
MARKS = np.ones(256, dtype=bool)      # every ASCII byte but letters and digits parts words
MARKS[128:] = MARKS[48:58] = MARKS[65:91] = MARKS[97:123] = False
_rng = np.random.default_rng(20240131)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
GRAM_VALUE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def scramble(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> U(31))
        h = h * U(0xBF58476D1CE4E5B9)
        h = h ^ (h >> U(27))
        h = h * U(0x94D049BB133111EB)
        return h ^ (h >> U(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each text; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def batch_slices(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(to, n)
        at = to


def words(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word, and the number of words before each text (one more than texts).

    ``apart`` marks the bytes that part words; with MARKS, accented capitals are folded too.
    """
    starts, ends, hashes = [], [], []
    edges = offsets[1:-1]
    inverse = pow(_BASE, -1, 1 << 64)
    at = 0
    while at < len(raw):
        to = min(len(raw), at + PIECE)
        if to < len(raw):                                  # end a piece at a space or between texts, never inside a word
            back = np.flatnonzero(apart[raw[at:to]])
            between = int(np.searchsorted(offsets, to, side="right")) - 1
            stop = max(at + int(back[-1]) + 1 if len(back) else 0, int(offsets[between]))
            if stop <= at:
                ahead = np.flatnonzero(apart[raw[to:]])
                following = offsets[offsets > to]
                stop = min(to + int(ahead[0]) if len(ahead) else len(raw), int(following[0]) if len(following) else len(raw))
            to = stop
        piece = FOLD[raw[at:to]]
        if apart is MARKS:                                 # also the accented capitals of Latin-1 (two bytes in UTF-8)
            accented = np.flatnonzero((piece[:-1] == 0xC3) & (piece[1:] >= 0x80) & (piece[1:] <= 0x9E) & (piece[1:] != 0x97)) + 1
            piece[accented] += 32
        inside = ~apart[piece]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = edges[np.searchsorted(edges, at):np.searchsorted(edges, to)] - at
        cut = cut[(cut > 0) & (cut < len(piece))]
        begin[cut] = inside[cut]
        end[cut - 1] = inside[cut - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        with np.errstate(over="ignore"):
            total = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(BYTE_VALUE[piece] * _powers(_BASE, len(piece)), out=total[1:])
            h = (total[e] - total[s]) * _powers(inverse, len(piece) + 1)[s]
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(scramble(h))
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    value = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return start, end, value, np.searchsorted(start, offsets)


def grams(value: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside each text, in order, and their number before each text.

    A text with fewer words, but at least one, has its whole sequence as one gram.
    """
    counts = np.diff(first)
    n = len(value)
    with np.errstate(over="ignore"):
        run = np.zeros(max(0, n - size + 1), dtype=np.uint64)
        for k in range(size):
            run += value[k:n - size + 1 + k] * GRAM_VALUE[k] if n >= size else 0
    run = scramble(run)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    before = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(made, out=before[1:])
    out = np.zeros(int(before[-1]), dtype=np.uint64)
    row = np.repeat(np.arange(len(counts)), made)
    at = first[:-1][row] + (np.arange(len(out)) - before[:-1][row])
    long_ = counts[row] >= size
    out[long_] = run[at[long_]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        part = value[first[i]:first[i + 1]]
        with np.errstate(over="ignore"):
            whole = (part * GRAM_VALUE[:len(part)]).sum(dtype=np.uint64) + U(len(part))
        out[before[i]] = scramble(np.array([whole], dtype=np.uint64))[0]
    return out, before
