"""Numbers of the words of many texts, with what was learned of each word.

Words are spans of one buffer of UTF-8. They are told apart by two 64-bit multilinear hashes with
fixed random coefficients, whose collisions are out of reach (below 2**-110 a pair), looked up in an
open-addressed table, all words of a batch at once. What is learned of a word is its ids, kept in one
pool, and some figures. The book holds MOST bytes besides the words of the stretch at hand; when it
is full it begins anew. Words of more than LONGEST bytes are learned each time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST = 64
MOST = 48 << 20
#: Bytes of words that are looked up at a time.
STRETCH = 1 << 20
_RNG = np.random.default_rng(61)
_C1 = _RNG.integers(0, 2**63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C2 = _RNG.integers(0, 2**63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: What learns words: a list of them to flat ids, ids of each, and rows of figures.
Learn = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each span; of spans over LONGEST they mean nothing."""
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    own = raw[place + np.repeat(starts, sizes)].astype(np.uint64) + np.uint64(1)
    np.minimum(place, LONGEST - 1, out=place)
    h1, h2 = (np.add.reduceat(own * c[place], first) for c in (_C1, _C2))
    size = sizes.astype(np.uint64)
    return (h1 ^ (h1 >> np.uint64(29)) ^ size) * _MIX, h2 ^ (size << np.uint64(56))


class WordBook:
    def __init__(self, learn: Learn, figures: int = 0, most: int = MOST) -> None:
        self.learn, self.width, self.most = learn, figures, most
        self.clear()

    def clear(self) -> None:
        self.n, self.used, self.bits = 0, 0, 12
        self.h1, self.h2 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.offset, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.figures, self.pool = np.zeros((self.width, 0)), np.zeros(0, np.int32)
        self.slots = np.full(1 << self.bits, -1, np.int32)

    @property
    def held(self) -> int:
        return sum(x.nbytes for x in (self.h1, self.h2, self.offset, self.count, self.figures, self.pool, self.slots))

    def _place(self, h1: np.ndarray) -> np.ndarray:
        return (h1 * _MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at, mask = self._place(h1), (1 << self.bits) - 1
        out, open_ = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        while len(open_):
            number = self.slots[at[open_]]
            some = number >= 0
            open_, number = open_[some], number[some]
            same = (self.h1[number] == h1[open_]) & (self.h2[number] == h2[open_])
            out[open_[same]] = number[same]
            open_ = open_[~same]
            at[open_] = (at[open_] + 1) & mask
        return out

    def _insert(self, numbers: np.ndarray) -> None:
        at, mask = self._place(self.h1[numbers]), (1 << self.bits) - 1
        open_ = np.arange(len(numbers))
        while len(open_):
            free = open_[self.slots[at[open_]] < 0]
            first = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[first]] = numbers[first]
            open_ = open_[self.slots[at[open_]] != numbers[open_]]
            at[open_] = (at[open_] + 1) & mask

    def _add(self, words: list[str], h1: np.ndarray, h2: np.ndarray) -> None:
        ids, counts, figures = self.learn(words)
        n, more = self.n, len(words)
        self._room(n + more, self.used + len(ids))
        self.h1[n : n + more], self.h2[n : n + more] = h1, h2
        self.offset[n : n + more], self.count[n : n + more] = self.used + np.cumsum(counts) - counts, counts
        self.figures[:, n : n + more], self.pool[self.used : self.used + len(ids)] = figures, ids
        self.n, self.used = n + more, self.used + len(ids)

    def _room(self, words: int, ids: int) -> None:
        if words > len(self.h1):
            more = max(1024, words + words // 4) - len(self.h1)
            self.h1, self.h2, self.offset, self.count = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.h1, self.h2, self.offset, self.count))
            self.figures = np.hstack([self.figures, np.zeros((self.width, more))])
        if ids > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(4096, ids + ids // 4) - len(self.pool), np.int32)])
        if 2 * words > len(self.slots):
            self.bits = (3 * words).bit_length()
            self.slots = np.full(1 << self.bits, -1, np.int32)
            self._insert(np.arange(self.n))

    def numbers(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each span of raw; good until the next call."""
        if self.held > self.most:
            self.clear()
        if not len(starts):
            return np.zeros(0, np.int64)
        h1, h2 = hashes(raw, starts, sizes)
        _, first, back = np.unique(h1, return_index=True, return_inverse=True)
        if (sizes > LONGEST).any() or (h2[first[back]] != h2).any():
            return self._numbers_one_by_one(raw, starts, sizes, h1, h2)
        found = self._find(h1[first], h2[first])
        new = np.flatnonzero(found < 0)
        if len(new):
            some = first[new]
            self._learned(raw, starts, sizes, h1, h2, some)
            found[new] = np.arange(self.n - len(new), self.n)
        return found[back]

    def _learned(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, h1: np.ndarray, h2: np.ndarray, some: np.ndarray) -> None:
        """Learns the words at `some`, which get the numbers next in turn, and puts them in the table."""
        text = raw.tobytes()
        begin = self.n
        self._add([text[a : a + b].decode() for a, b in zip(starts[some].tolist(), sizes[some].tolist(), strict=True)], h1[some], h2[some])
        self._insert(np.arange(begin, self.n))

    def _numbers_one_by_one(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """As numbers(), where words are too long for the table, which does not keep them."""
        out = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(sizes <= LONGEST)
        out[short] = self._find(h1[short], h2[short])
        text, own, at = raw.tobytes(), {}, []
        for i in np.flatnonzero(out < 0).tolist():
            word = text[starts[i] : starts[i] + sizes[i]]
            if word not in own:
                own[word] = self.n + len(own)
                at.append(i)
            out[i] = own[word]
        if own:
            begin, where = self.n, np.array(at)
            self._add([w.decode() for w in own], h1[where], h2[where])
            self._insert(begin + np.flatnonzero(sizes[where] <= LONGEST))
        return out

    def read(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words in a row, how many each has, and the figures of each."""
        ends, out, at = np.cumsum(sizes), [], 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRETCH)))
            low, high = int(starts[at]), int(starts[to - 1] + sizes[to - 1])
            numbers = self.numbers(raw[low:high], starts[at:to] - low, sizes[at:to])
            counts = self.count[numbers].astype(np.int64)
            before = np.cumsum(counts) - counts
            out.append((self.pool[np.arange(int(counts.sum())) + np.repeat(self.offset[numbers] - before, counts)], counts, self.figures[:, numbers]))
            at = to
        if not out:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((self.width, 0))
        return out[0] if len(out) == 1 else tuple(np.concatenate(x, axis=-1) for x in zip(*out, strict=True))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of the texts in a row (null: empty), and where each begins, with the end."""
    own = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
    held = own.buffers()[2]
    raw = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and len(own) else np.zeros(0, np.uint8)
    return raw, at - at[0]
