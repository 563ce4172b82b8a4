"""Vectorised window fingerprints over Arrow string columns.

Everything here works on one Arrow record batch inside a task and keeps its
arrays to about a quarter of a megabyte of text at a time, so memory does not follow the
batch or the partition (one document longer than that is handled alone).

A *window* is a run of ``width`` consecutive items (words or bytes).  Among the
``width - gram + 1`` grams inside a window the smallest hash is its *anchor*;
the anchor depends on nothing but the window's content, so equal windows have
equal anchors wherever they stand.  A *span* is a maximal run of consecutive
windows of one document with the same anchor.  Two facts make the exact
operators cheap: equal spans mean equal windows throughout, and equal windows
can only stand in spans with equal anchors.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd multipliers of the polynomial hashes (arithmetic is modulo 2**64).
BYTE_BASE = 0x9E3779B97F4A7C15
ITEM_BASE = 0xD6E8FEB86659FD93
CHUNK_BYTES = 1 << 18

#: Words of more blocks of eight bytes are digested one by one.
MOST_BLOCKS = 4

_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = 1 << max(10, (n - 1).bit_length())
            self._up, self._down = (self._table(b, size) for b in (self.base, self.inverse))
        return self._up[:n], self._down[:n]

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out = np.ones(size, np.uint64)
        done = 1
        while done < size:  # doubling: out[done:2*done] = out[:done] * base**done
            out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        return out


_BYTES, _ITEMS = _Powers(BYTE_BASE), _Powers(ITEM_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass(frozen=True)
class Key:
    """Secret parameters of the keyed hashes of one run: a start, odd multipliers and a key of digests.

    No two different words, or runs of items, can be prepared that collide under a key
    drawn later; the polynomials above, linear modulo 2**64, have such (Thue-Morse) words
    whatever their base.
    """

    start: int
    factors: tuple[int, ...]
    digest: bytes

    @staticmethod
    def draw() -> Key:
        odd = tuple(secrets.randbits(64) | 1 for _ in range(MOST_BLOCKS + 2))
        return Key(secrets.randbits(64), odd, secrets.token_bytes(32))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets from 0) for runs of rows; nulls are empty texts."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


@dataclass
class Words:
    """Words of a chunk: byte starts and ends, hashes, and per document the first word's index."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, key: Key | None = None) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each document; ``lower`` folds A-Z only. With a ``key`` hashes are keyed."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return Words(start, end, _ranges(data, start, end) if key is None else _keyed(data, start, end, key), np.searchsorted(start, offsets))


def _keyed(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: Key) -> np.ndarray:
    """Keyed hashes of the byte ranges: blocks of eight bytes mixed one after the other; long ranges by a keyed digest."""
    size = end - start
    blocks = -(-size // 8)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    out = mix(size.astype(np.uint64) * np.uint64(BYTE_BASE) ^ np.uint64(key.start))
    for j in range(min(MOST_BLOCKS, int(blocks.max(initial=0)))):
        at = np.flatnonzero(blocks > j)
        block = windows[start[at] + 8 * j].view("<u8").ravel()
        left = np.minimum(size[at] - 8 * j, 8).astype(np.uint64)
        block &= np.uint64(_MASK) >> (np.uint64(64) - np.uint64(8) * left)
        out[at] = mix((out[at] ^ block) * np.uint64(key.factors[j]))
    for i in np.flatnonzero(blocks > MOST_BLOCKS).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key.digest).digest(), "little")
    return out


def _ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, in pieces of a bounded size where a text is very long."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + 4 * CHUNK_BYTES, "right")))
        low, high = int(start[at]), int(end[stop - 1])
        up, down = _BYTES.get(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        a, b = start[at:stop] - low, end[at:stop] - low
        out[at:stop] = mix((total[b] - total[a]) * down[a])
        at = stop
    return out


class Rolling:
    """Hashes of runs of items, from one prefix sum."""

    def __init__(self, items: np.ndarray):
        self.n = len(items)
        up, self._down = _ITEMS.get(self.n + 1)
        self._sum = np.zeros(self.n + 1, np.uint64)
        np.cumsum(items * up[:-1], out=self._sum[1:])

    def all(self, width: int) -> np.ndarray:
        """Of every run of ``width`` items (runs may cross documents)."""
        m = max(0, self.n - width + 1)
        return mix((self._sum[width : width + m] - self._sum[:m]) * self._down[:m])

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start] + (end - start).astype(np.uint64))


class Windows:
    """Keyed hashes of runs of items, by doubling.

    The hash of a run of ``2**k`` items is a keyed mix of those of its halves, that of any
    other run a mix of the two longest such runs at its ends: no sum in it is linear over
    more than two parts.  One level is held at a time.
    """

    def __init__(self, items: np.ndarray, key: Key):
        self.n, self._first = len(items), 0
        self._a, self._b = (np.uint64(f) for f in key.factors[MOST_BLOCKS:])
        self._base = self._level = mix(items ^ np.uint64(key.start))
        self._k = 0

    @staticmethod
    def of_bytes(data: np.ndarray, key: Key, least: int) -> Windows:
        """Runs of bytes; where none is shorter than eight (``least``), eight bytes are read at once."""
        if least < 8 or len(data) < 8:
            return Windows(data.astype(np.uint64), key)
        eights = np.lib.stride_tricks.sliding_window_view(data, 8)
        out = Windows(np.ascontiguousarray(eights).view("<u8").ravel(), key)
        out.n, out._first, out._k = len(data), 3, 3
        return out

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        x = left * self._a
        x += right
        x ^= x >> np.uint64(32)
        x *= self._b
        x ^= x >> np.uint64(29)
        return x

    def _to(self, k: int) -> np.ndarray:
        """Hashes of all runs of ``2**k`` items."""
        if k < self._k:
            self._k, self._level = self._first, self._base
        while self._k < k:
            half = 1 << self._k
            m = max(0, len(self._level) - half)
            self._level = self._join(self._level[:m], self._level[half : half + m])
            self._k += 1
        return self._level

    def all(self, width: int) -> np.ndarray:
        """Of every run of ``width`` items (runs may cross documents)."""
        m = max(0, self.n - width + 1)
        k = width.bit_length() - 1
        level, rest = self._to(k), width - (1 << k)
        return mix(self._join(level[:m], level[rest : rest + m]) + np.uint64(width))

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the runs ``[start, end)``; equal to ``all`` where the width is that."""
        out, size = np.zeros(len(start), np.uint64), end - start
        for k in range(int(size.max(initial=1)).bit_length()):
            at = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
            if len(at):
                level = self._to(k)
                out[at] = mix(self._join(level[start[at]], level[end[at] - (1 << k)]) + size[at].astype(np.uint64))
        return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values: block-wise prefix and suffix minima."""
    n = len(x)
    if width <= 1 or n < width:
        return x if n >= width else x[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    table = padded.reshape(blocks, width)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


@dataclass
class Spans:
    """Spans of a chunk. Window starts first..last (item indexes, inclusive), by document row."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    hash: np.ndarray


def spans(items: np.ndarray | Windows, bounds: np.ndarray, width: int, gram: int) -> Spans:
    """Spans of all windows of all documents of a chunk: over items, or over their keyed windows."""
    rolling = items if isinstance(items, Windows) else Rolling(items)
    grams = rolling.all(gram)
    best = sliding_min(grams, width - gram + 1)
    counts = np.diff(bounds) - width + 1
    rows = np.flatnonzero(counts > 0)
    if not len(rows):
        none = np.zeros(0, np.int64)
        return Spans(none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    valid = np.zeros(len(best) + 1, np.int8)
    np.add.at(valid, bounds[rows], 1)
    np.add.at(valid, bounds[rows] + counts[rows], -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    new = valid.copy()
    new[1:] &= (best[1:] != best[:-1]) | (grams[: len(best) - 1] == best[1:])
    new[bounds[rows]] = True
    ends = valid.copy()
    ends[:-1] &= new[1:] | ~valid[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(ends)
    return Spans(np.searchsorted(bounds, first, "right") - 1, first, last, best[first], rolling.some(first, last + width))


def cover_ranges(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Mask of the ``n`` items that any of the ranges ``[start, end)`` covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step)[:n] > 0
