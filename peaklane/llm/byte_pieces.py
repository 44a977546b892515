"""Byte-level BPE over whole Arrow batches.

The tokenizers library cuts a text into pieces (a word with the blank before it, a number, a run of signs) and merges
each piece on its own. Pieces recur, so they are cut here by array operations on the bytes of many documents, looked up
by their exact bytes, and only pieces that were not met before are given to the library.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np

from peaklane.llm.words import _buffers

#: Bytes of text cut at once.
SLICE = 1 << 19
#: Slots of the piece table (a power of two, 24 bytes each), and the slots in which a piece may stand.
SLOTS, WAYS = 1 << 20, 4
_LETTER, _NUMBER, _SPACE, _SIGN = 1, 2, 3, 4  # 0: a character whose class is left to the library


def _class(c: int) -> int:
    kind = unicodedata.category(chr(c))[0]
    return _LETTER if kind == "L" else _NUMBER if kind == "N" else _SPACE if c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0) else _SIGN


_TWO = np.array([_class(c) for c in range(0x250)], np.uint8)
_ONE = np.concatenate([_TWO[:128], np.zeros(128, np.uint8)])
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_WEIGHTS = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: The character that stands for each byte in the vocabulary: itself if it can be seen, else one beyond them, in order.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: chr(b) for b in _SEEN} | {b: chr(0x100 + k) for k, b in enumerate(sorted(set(range(0x100)) - set(_SEEN)))}
#: A place where a piece begins whatever stands before and after: a blank between a sign or letter and a letter.
_SAFE = re.compile(rb"[!-~](?= [A-Za-z])")


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    cls = _ONE[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        two = lead[data[lead] < 0xC9 + 1]
        code = ((data[two].astype(np.int64) & 0x1F) << 6) | (data[two + 1] & 0x3F)
        known = code < 0x250
        cls[two[known]] = cls[two[known] + 1] = _TWO[code[known]]
        three = lead[data[lead] == 0xE2]
        three = three[(data[three + 1] == 0x80) & (data[three + 2] >= 0x90) & (data[three + 2] <= 0xA7)]  # dashes, quotes, dots
        for k in range(3):
            cls[three + k] = _SIGN
    return cls


def piece_starts(data: np.ndarray, cls: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where pieces begin. ``data`` has spare bytes behind; ``edge`` marks where a text begins, and what is behind them all."""
    n = len(cls)
    flag = edge.copy()
    new = edge[:n].copy()
    new[1:] |= cls[1:] != cls[:-1]
    run = np.flatnonzero(new)
    end = np.append(run[1:], n)
    space = cls[run] == _SPACE
    after_blank = ~edge[run] & (data[run - 1] == 0x20)
    # a run of white space leaves its last character to what follows; a blank becomes part of the piece behind it
    flag[run[space]] = True
    last = end[space] - 1 - (data[end[space] - 1] >= 0x80)
    alone = last[(last > run[space]) & ~edge[end[space]] & (data[last] != 0x20)]
    flag[alone] = True
    flag[(run - after_blank)[~space]] = True
    # 's 't 'm 'd 're 've 'll, unless a blank took the apostrophe
    mark = run[(data[run] == 0x27) & (end == run + 1) & ~after_blank]
    mark = mark[~edge[mark + 1] & (cls[np.minimum(mark + 1, n - 1)] == _LETTER)]
    if len(mark):
        one, two = data[mark + 1], data[mark + 2]
        single = (one == 0x73) | (one == 0x74) | (one == 0x6D) | (one == 0x64)
        pair = ~edge[mark + 2] & (((two == 0x65) & ((one == 0x72) | (one == 0x76))) | ((one == 0x6C) & (two == 0x6C)))
        cut = mark[single | pair]
        flag[cut + 1] = False
        flag[cut + np.where(single, 2, 3)[single | pair]] = True
    return np.flatnonzero(flag[:n])


def _places(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of runs, one run after the other."""
    return np.arange(int(count.sum())) + np.repeat(start - np.cumsum(count) + count, count)


class Encoder:
    """Encodes texts with the tokenizers library; pieces of text that recur are encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        pre = told["pre_tokenizer"] or {}
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [t["content"].encode() for t in told["added_tokens"] if t["content"]]
        self.by_piece = told["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        # remembered pieces of up to 16 bytes (size 0: a free slot), and where their ids stand in the pool
        self.low, self.high, self.at = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint32)
        self.size, self.count, self.met = np.zeros(SLOTS, np.uint8), np.zeros(SLOTS, np.uint8), np.zeros(SLOTS, bool)
        self.pool = np.zeros(0, self.width)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _solved(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of pieces, which the library's model encodes; they are put into the pool."""
        tokenize = self.tokenizer.model.tokenize
        ids = [[t.id for t in tokenize(p.decode("latin-1").translate(_SHOWN))] for p in pieces]
        count = np.array([len(own) for own in ids], np.int64)
        place = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate([self.pool, np.array([i for own in ids for i in own], self.width)])
        return place, count

    def _forget(self) -> None:
        """Free half of the slots or more: of pieces not met since they were learnt or since this was last done, or of all."""
        self.size[~self.met] = 0
        held = np.flatnonzero(self.size)
        if len(held) > SLOTS // 4:
            self.size[:], held = 0, held[:0]
        count = self.count[held].astype(np.int64)
        self.pool = self.pool[_places(self.at[held].astype(np.int64), count)]
        self.at[held] = np.cumsum(count) - count
        self.met[:] = False

    def _remember(self, home: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, place: np.ndarray, count: np.ndarray) -> None:
        """Give pieces a free slot; those that find none are encoded again when they recur."""
        left = np.flatnonzero((size <= 16) & (count < 256))
        for way in range(WAYS):
            slot = home[left] ^ way
            free = self.size[slot] == 0
            into, one = np.unique(slot[free], return_index=True)
            own = left[free][one]
            self.low[into], self.high[into], self.size[into] = low[own], high[own], size[own]
            self.at[into], self.count[into], self.met[into] = place[own], count[own], False
            placed = np.zeros(len(home), bool)
            placed[own] = True
            left = left[~placed[left]]

    def _looked_up(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of all pieces of ``data``, which has spare bytes behind."""
        lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        short = np.minimum(size, 16)
        low = lanes[start] & _MASK[np.minimum(short, 8)]
        high = lanes[start + 8] & _MASK[np.maximum(short, 8) - 8]
        mixed = low * _WEIGHTS[0] + high * _WEIGHTS[1] + size.astype(np.uint64) * _WEIGHTS[2]
        mixed ^= mixed >> np.uint64(32)
        home = ((mixed * _WEIGHTS[0]) >> np.uint64(34)).astype(np.int64) % SLOTS
        place, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        left = np.arange(len(start))
        for way in range(WAYS):
            slot = home[left] ^ way
            same = (self.low[slot] == low[left]) & (self.high[slot] == high[left]) & (self.size[slot] == size[left])
            hit, slot = left[same], slot[same]
            place[hit], count[hit] = self.at[slot], self.count[slot]
            self.met[slot] = True
            left = left[~same]
        if len(left):
            raw = memoryview(data)
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(bytes(raw[a:b]), len(number)) for a, b in zip(start[left].tolist(), (start[left] + size[left]).tolist(), strict=True)], np.int64)
            new_place, new_count = self._solved(list(number))
            place[left], count[left] = new_place[which], new_count[which]
            own = left[np.unique(which, return_index=True)[1]]
            self._remember(home[own], low[own], high[own], size[own], place[own], count[own])
        return place, count

    def _part(self, data: np.ndarray, cuts: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of ``data[:-16]`` that ``cuts`` separate, and their number for each; ``ends`` says after
        which of them ``end_id`` follows."""
        n = len(data) - 16
        edge = np.zeros(n + 3, bool)
        edge[cuts] = True
        edge[n:] = True
        cls = _classes(data)[:n]
        odd = np.zeros(len(cuts) - 1, bool)
        if self.by_piece:
            odd[np.unique(np.searchsorted(cuts, np.flatnonzero(cls == 0), "right") - 1)] = True
            raw = data[:n].tobytes()
            for s in self.special:
                for m in re.finditer(re.escape(s), raw):
                    first, last = np.searchsorted(cuts, [m.start(), m.end() - 1], "right") - 1
                    odd[first : last + 1] = True
        else:
            odd[:] = True
        start = piece_starts(data, cls, edge) if n else np.zeros(0, np.int64)
        text = np.searchsorted(cuts, start, "right") - 1
        size = np.diff(np.append(start, n))
        plain = ~odd[text]
        start, size, text = start[plain], size[plain], text[plain]
        place, count = self._looked_up(data, start, size)
        strange = np.flatnonzero(odd & (np.diff(cuts) > 0))
        told = self._plain([data[cuts[k] : cuts[k + 1]].tobytes().decode() for k in strange])
        pool = np.concatenate([self.pool, *[np.array(ids, self.width) for ids in told], np.array([end_id], self.width)])
        extra = len(self.pool) + np.cumsum([0, *map(len, told)])
        own = np.flatnonzero(ends)
        # pieces, strange texts and end ids in the order of their texts, each a run of the pool
        key = np.concatenate([text * 2, strange * 2, own * 2 + 1])
        order = np.argsort(key, kind="stable")
        place = np.concatenate([place, extra[:-1], np.full(len(own), len(pool) - 1)])[order]
        count = np.concatenate([count, np.array([len(t) for t in told], np.int64), np.ones(len(own), np.int64)])[order]
        ids, into = pool[_places(place, count)], np.concatenate([[0], np.cumsum(count)])
        lengths = np.diff(into[np.searchsorted(key[order] // 2, np.arange(len(cuts)))])
        return ids, lengths

    def encode(self, column, end_id: int):
        """For slices of an Arrow string column (null: empty): the ids of all their texts, ``end_id`` after each text,
        and for each text that ends there its number of ids in all slices."""
        data, offsets = _buffers(column)
        pending, divisible = 0, self.by_piece and not any(b" " in s for s in self.special)
        for lo, hi, cuts, ends in _slices(data, offsets, divisible):
            part = np.zeros(hi - lo + 16, np.uint8)
            part[: hi - lo] = data[lo:hi]
            if np.count_nonzero(self.size) > SLOTS // 2:
                self._forget()
            ids, lengths = self._part(part, cuts - lo, ends, end_id)
            total = np.concatenate([[0], np.cumsum(lengths)])
            stop = total[1:][ends]
            yield ids, np.diff(stop, prepend=-pending) if len(stop) else stop
            pending = total[-1] - stop[-1] if len(stop) else pending + total[-1]


def _slices(data: np.ndarray, offsets: np.ndarray, divisible: bool):
    """(start, stop, cuts, ends): byte ranges of about ``SLICE``, the places that separate their texts, and which of these
    parts end a text. A longer text is divided at safe places if ``divisible``."""
    inner = []
    for k in np.flatnonzero(np.diff(offsets) > SLICE).tolist() if divisible else []:
        lo, hi = int(offsets[k]), int(offsets[k + 1])
        raw, at = data[lo:hi].tobytes(), SLICE
        while at < hi - lo and (m := _SAFE.search(raw, at)):
            inner.append(lo + m.end())
            at = m.end() + SLICE
    cuts = np.concatenate([offsets, np.array(inner, np.int64)])
    order = np.argsort(cuts, kind="stable")
    cuts, is_text = cuts[order], (np.arange(len(cuts)) < len(offsets))[order]
    a, n = 0, len(cuts) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(cuts, cuts[a] + SLICE, "right")) - 1))
        yield int(cuts[a]), int(cuts[b]), cuts[a : b + 1], is_text[a + 1 : b + 1]
        a = b


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
