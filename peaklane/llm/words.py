"""Words of Arrow text columns as numpy arrays, many documents at a time.

A batch's UTF-8 bytes lie in one buffer, so words are found and hashed by whole-array operations; documents are
taken in slices of about ``SLICE`` bytes, which bounds the temporaries (a longer document is a slice of its own).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
SLICE = 1 << 20
#: Bytes that separate words: blank and the controls 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: The ASCII bytes that are neither letters (lower case) nor digits.
PLAIN_BLANK = np.zeros(256, bool)
PLAIN_BLANK[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _draw(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """``first``: for each document, the number of words before it (one entry more than documents); ``start`` and
    ``end``: the bytes of each word in ``data``; ``code``: a 64-bit hash of each word."""

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which ``size`` words of one document begin, and a 64-bit hash of each such window."""
        n = len(self.code)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n - size + 1, np.uint64)
        for k, c in enumerate(_draw(seed, size)):
            total += self.code[k : n - size + 1 + k] * c
        at = np.arange(n - size + 1)
        at = at[at + size <= np.repeat(self.first[1:], np.diff(self.first))[: len(at)]]
        return at, mixed(total[at])

    def recoded(self, keep: np.ndarray, seed: int) -> np.ndarray:
        """A second 64-bit hash of the words under ``keep``, independent of ``code``; 0 for the others."""
        out, held = np.zeros(len(self.code), np.uint64), np.flatnonzero(keep)
        table, base = _draw(seed, 256), _draw(seed + 1, 1)[0]
        size = (self.end - self.start)[held]
        into = np.concatenate([[0], np.cumsum(size)])
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max(initial=0)), base, np.uint64)]))
        for a, b in _slices(into):
            here = np.arange(into[a], into[b])
            inside = here - np.repeat(into[a:b], size[a:b])
            found = table[self.data[np.repeat(self.start[held[a:b]], size[a:b]) + inside]] * power[inside]
            out[held[a:b]] = mixed(np.add.reduceat(found, into[a:b] - into[a]))
        return out

    def packed(self, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The words under ``keep``, each with a blank after it, and the place of each (one entry more than words)."""
        size = (self.end - self.start)[keep]
        into = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(into[-1], 0x20, np.uint8)
        shift = self.start[keep] - into[:-1]
        for a, b in _slices(into):
            here = np.arange(into[a], into[b])
            within = here - np.repeat(into[a:b], size[a:b] + 1) < np.repeat(size[a:b], size[a:b] + 1)
            out[here[within]] = self.data[(here + np.repeat(shift[a:b], size[a:b] + 1))[within]]
        return out.tobytes(), into

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """Of each document the words under ``keep``, joined by one blank."""
        raw, into = self.packed(keep)
        kept = np.concatenate([[0], np.cumsum(keep)])[self.first]
        return [raw[into[a] : max(into[a], into[b] - 1)] for a, b in zip(kept[:-1], kept[1:], strict=True)]

    def stems(self, size: int, seed: int) -> np.ndarray:
        """A 64-bit hash of the first ``size`` bytes of each word."""
        table = _draw(seed, 256)
        code, length = np.zeros(len(self.start), np.uint64), self.end - self.start
        for k, power in enumerate(_draw(seed + 1, size)):
            has = length > k
            code[has] += table[self.data[self.start[has] + k]] * power
        return mixed(code)


def _slices(offsets: np.ndarray):
    """Ranges of items whose ``offsets`` span about ``SLICE``."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def _buffers(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays([column.cast(pa.large_string()).fill_null("")])
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column, *, seed: int, lower: bool = False, blank: np.ndarray = BLANK) -> Words:
    """The words of an Arrow string column (null: none), split at the bytes ``blank``; ``lower`` maps A-Z first."""
    data, offsets = _buffers(column)
    data = LOWER[data] if lower else data
    table, base = _draw(seed, 256), _draw(seed + 1, 1)[0]
    power = np.ones(1, np.uint64)
    starts, ends, codes = [], [], []
    for a, b in _slices(offsets):
        lo, hi = offsets[a], offsets[b]
        part = data[lo:hi]
        if not len(part):
            continue
        word = ~blank[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[offsets[a : b + 1] - lo] = True
        before = np.concatenate([[False], word[:-1]])
        after = np.concatenate([word[1:], [False]])
        s = np.flatnonzero(word & (~before | edge[:-1]))
        if not len(s):
            continue
        e = np.flatnonzero(word & (~after | edge[1:])) + 1
        size = e - s
        if size.max() > len(power):
            with np.errstate(over="ignore"):
                power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()), base, np.uint64)]))
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        inside = np.arange(int(size.sum())) - np.repeat(at, size)
        codes.append(mixed(np.add.reduceat(table[part[word]] * power[inside], at)))
        starts.append(s + lo)
        ends.append(e + lo)
    gather = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = gather(starts, np.int64)
    return Words(data, np.searchsorted(start, offsets), start, gather(ends, np.int64), gather(codes, np.uint64))
