"""Elias-Fano sequences and the two-level n-gram trie built on them, with memory-mapped levels."""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Number of ones in every byte, and the place of the k-th one in every byte.
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_PLACE = np.array([[[i for i in range(8) if b >> i & 1] + [0] * 8][0][:8] for b in range(256)], np.uint8)


class EliasFano:
    """A monotone sequence below ``universe``: low bits packed, high bits as unary gaps in a bit vector."""

    def __init__(self, values: np.ndarray, universe: int) -> None:
        n = len(values)
        self.n = n
        self.low_bits = max(0, (int(universe) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        ones = high + np.arange(n)
        bits = np.zeros((int(universe) >> self.low_bits) + n + 2, np.uint8)
        bits[ones] = 1
        self.high = np.packbits(bits, bitorder="little")
        self.low = np.zeros((n * self.low_bits + 7) // 8 + 8, np.uint8)
        if self.low_bits and n:
            low = values & np.uint64((1 << self.low_bits) - 1)
            spread = (low[:, None] >> np.arange(self.low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(spread.ravel(), bitorder="little")
            self.low[: len(packed)] = packed
        self._rank()

    def _rank(self) -> None:
        """Samples: ones before every 8-byte block of the high bits."""
        counts = np.add.reduceat(_ONES[self.high].astype(np.int64), np.arange(0, len(self.high), 8)) if len(self.high) else np.zeros(0, np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        self.zeros = np.arange(len(self.before)) * 64 - self.before

    def arrays(self) -> dict[str, np.ndarray]:
        return {"high": self.high, "low": self.low}

    def _select(self, k: np.ndarray, samples: np.ndarray, flip: int) -> np.ndarray:
        """Place of the k-th one (flip 0) or zero (flip 255) of the high bits."""
        block = np.searchsorted(samples, k, side="right") - 1
        left = k - samples[block]
        at = block * 8
        done = np.zeros(len(k), bool)
        for _ in range(8):
            byte = np.minimum(at, len(self.high) - 1)
            here = _ONES[self.high[byte] ^ flip].astype(np.int64)
            step = ~done & (left >= here)
            done |= ~step
            left = np.where(step, left - here, left)
            at = at + step
        byte = np.minimum(at, len(self.high) - 1)
        return at * 8 + _PLACE[self.high[byte] ^ flip, np.minimum(left, 7)]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        window = np.zeros(len(i), np.uint64)
        for k in range(8):
            window |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        got = window >> shift
        spill = shift.astype(np.int64) + self.low_bits > 64
        if spill.any():
            got[spill] |= self.low[byte[spill] + 8].astype(np.uint64) << (np.uint64(64) - shift[spill])
        return got & np.uint64((1 << self.low_bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = self._select(i, self.before, 0) - i
        return high.astype(np.uint64) << np.uint64(self.low_bits) | self.lows(i)

    def successor(self, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of the first value >= key in [lo, hi) of each key; hi where there is none.

        The values that share a key's high bits lie between two zeros of the bit vector; among them the low
        bits are searched by halving.
        """
        keys = keys.astype(np.uint64)
        high = (keys >> np.uint64(self.low_bits)).astype(np.int64)
        want = keys & np.uint64((1 << self.low_bits) - 1)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, 255) + 1 - high, 0)
        end = self._select(high, self.zeros, 255) - high
        a, b = np.clip(begin, lo, hi), np.clip(end, lo, hi)
        while (open_ := a < b).any():
            middle = (a + b) >> 1
            below = open_ & (self.lows(np.minimum(middle, max(self.n - 1, 0))) < want)
            a, b = np.where(below, middle + 1, a), np.where(open_ & ~below, middle, b)
        return a


def quantise(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(codes, book): values replaced by the nearest of at most ``levels``.

    Few distinct values are kept exactly. Otherwise half of the levels are quantiles, and half lie evenly between
    the extremes, so that rare large values stay near themselves too.
    """
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    book = np.unique(values)
    if len(book) > levels:
        book = np.unique(np.concatenate([np.quantile(values, (np.arange(levels // 2) + 0.5) / (levels // 2)), np.linspace(book[0], book[-1], levels // 2)]))
    return np.searchsorted((book[1:] + book[:-1]) / 2, values).astype(np.uint8), book


class Trie:
    """Predicted words, and below each word the contexts that it was seen after, in context order.

    ``roots`` is the number of words, ``pairs`` are sorted keys word * contexts + context. The first level has a
    monotone pointer and a quantised back-off value for each word, the second the context of each n-gram and its
    quantised value. All levels go to one file that is mapped into memory.
    """

    def __init__(self, roots: int, contexts: int, pairs: np.ndarray, back_off: np.ndarray, values: np.ndarray, folder: str | None = None) -> None:
        self.contexts = max(contexts, 1)
        pointers = np.searchsorted(pairs, np.arange(roots + 1, dtype=np.uint64) * np.uint64(self.contexts))
        self.pointers = EliasFano(pointers, len(pairs) + 1)
        self.keys = EliasFano(pairs, max(roots, 1) * self.contexts)
        code1, self.book1 = quantise(back_off)
        code2, self.book2 = quantise(values)
        parts = [self.pointers.high, self.pointers.low, self.keys.high, self.keys.low, code1, code2]
        handle, self.path = tempfile.mkstemp(prefix="trie-", dir=folder)
        with os.fdopen(handle, "wb") as out:
            for part in parts:
                out.write(part.tobytes())
            out.write(b"\0")
        level = np.memmap(self.path, np.uint8, "r")
        at = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        views = [level[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        self.pointers.high, self.pointers.low, self.keys.high, self.keys.low, self.code1, self.code2 = views
        self.bytes = int(at[-1])

    def values(self, root: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The n-gram's value where it was seen, else the word's back-off value."""
        lo, hi = self.pointers[root].astype(np.int64), self.pointers[root + 1].astype(np.int64)
        key = root.astype(np.uint64) * np.uint64(self.contexts) + context.astype(np.uint64)
        at = self.keys.successor(key, lo, hi)
        out = self.book1[self.code1[root]]
        inside = np.flatnonzero(at < hi)
        hit = inside[self.keys[at[inside]] == key[inside]]
        out[hit] = self.book2[self.code2[at[hit]]]
        return out

    def close(self) -> None:
        os.unlink(self.path)

    def __enter__(self) -> Trie:
        return self

    def __exit__(self, *_) -> None:
        self.close()
