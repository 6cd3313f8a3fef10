"""Variable-order byte context models, scored by table look-up.

A model counts the byte strings of 1..order+1 bytes of its training text. Its probability of a
byte depends on the preceding ``order`` bytes alone, so the value of every (order+1)-byte string
seen in training is worked out once for all models; scoring a text is one look-up a byte.
"""

from __future__ import annotations

import numpy as np

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[48:58] = 48
_FOLD[128:256] = np.arange(128, 256)


def folded(data: bytes) -> np.ndarray:
    """Case, digits and ASCII signs removed: A-Z lower, digits 0, other ASCII a space; À-Þ as à-þ."""
    raw = np.frombuffer(data, dtype=np.uint8)
    out = _FOLD[raw]
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1
    capital = after[(raw[after] >= 0x80) & (raw[after] <= 0x9E) & (raw[after] != 0x97)]
    out[capital] += 32
    return out


def _keys(data: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes that end at each position, as one integer (positions before: zero bytes)."""
    out = data.astype(np.uint64)
    for back in range(1, length):
        out[back:] |= data[: len(data) - back].astype(np.uint64) << np.uint64(8 * back)
    return out


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class ContextModel:
    """Counts of one class of text. kind: ``ppm`` (escape method C with exclusions) or
    ``interpolated`` (Witten-Bell smoothing). Given ``counted``, strings of order+1 bytes with their
    numbers, the text is not needed."""

    def __init__(self, data: np.ndarray | None, order: int, kind: str, counted: tuple[np.ndarray, np.ndarray] | None = None):
        self.order, self.kind = order, kind
        self.grams: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.totals: list[np.ndarray] = []
        self.symbols: list[np.ndarray] = []
        self.excluded: list[np.ndarray] = []
        for level in range(order + 1):
            if counted:
                grams, back = np.unique(counted[0] & np.uint64((1 << 8 * (level + 1)) - 1), return_inverse=True)
                counts = np.bincount(back, counted[1])
            else:
                grams, counts = np.unique(_keys(data, level + 1)[level:], return_counts=True)
            if not len(grams):  # shorter than the context
                grams, counts = np.array([np.uint64((1 << 64) - 1)]), np.array([1])
            contexts, inverse = np.unique(grams >> np.uint64(8), return_inverse=True)
            self.grams.append(grams)
            self.counts.append(counts.astype(np.float64))
            self.contexts.append(contexts)
            self.totals.append(np.bincount(inverse, counts))
            self.symbols.append(np.bincount(inverse).astype(np.float64))
            lower = counts.astype(np.float64)
            if level:
                at, ok = _find(self.grams[level - 1], grams & np.uint64((1 << 8 * level) - 1))
                lower = np.where(ok, self.counts[level - 1][at], 0)
            self.excluded.append(np.bincount(inverse, lower))

    def log(self, grams: np.ndarray) -> np.ndarray:
        """Natural log of the probability of the last byte of each (order+1)-byte string."""
        parts = []
        for level in range(self.order + 1):
            short = grams & np.uint64((1 << 8 * (level + 1)) - 1)
            at, ok = _find(self.grams[level], short)
            ctx, seen = _find(self.contexts[level], short >> np.uint64(8))
            parts.append([np.where(ok, self.counts[level][at], 0)] + [np.where(seen, x[level][ctx], 0) for x in (self.totals, self.symbols, self.excluded)])
        if self.kind == "interpolated":
            p = np.full(len(grams), 1 / 256)
            for n, total, symbols, _ in parts:
                p = np.where(total > 0, (n + symbols * p) / np.maximum(total + symbols, 1), p)
            return np.log(p)
        out = np.full(len(grams), -np.log(max(1.0, 256 - self.symbols[0][0])))
        for level, (n, total, symbols, _) in enumerate(parts):
            above = parts[level + 1] if level < self.order else [np.zeros(len(grams))] * 4
            rest, novel = np.maximum(total - above[3], 0), np.maximum(symbols - above[2], 0)
            whole = np.maximum(rest + novel, 1e-9)
            with np.errstate(divide="ignore"):
                escape = np.where(novel > 0, np.log(np.maximum(novel, 1e-9) / whole), 0)
                value = np.where(n > 0, np.log(np.maximum(n, 1e-9) / whole), escape + out)
            out = np.where(total > 0, value, out)
        return out


class Scorer:
    """Sum of log probabilities of whole texts under several models of one order and kind."""

    def __init__(self, models: list[ContextModel]):
        self.models, self.order = models, models[0].order
        self.keys = np.unique(np.concatenate([m.grams[-1] for m in models]))
        self.values = self._exact(self.keys).astype(np.float32)
        self.bits = max(12, int(8 * len(self.keys) - 1).bit_length())
        self._slots: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_slots": None}

    def _exact(self, grams: np.ndarray) -> np.ndarray:
        return np.stack([m.log(grams) for m in self.models], axis=1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _table(self) -> np.ndarray:
        if self._slots is None:
            slots = np.full((1 << self.bits) + len(self.keys) + 1, -1, dtype=np.int32)
            left, at = np.arange(len(self.keys), dtype=np.int32), self._slot(self.keys)
            while len(left):
                free = slots[at] < 0
                slots[at[free]] = left[free]
                stay = slots[at] != left
                left, at = left[stay], at[stay] + 1
            self._slots = slots
        return self._slots

    def values_of(self, grams: np.ndarray) -> np.ndarray:
        slots, at = self._table(), self._slot(grams)
        found = slots[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != grams))
        step = 0
        while len(wrong):
            step += 1
            found[wrong] = slots[at[wrong] + step]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[found[wrong]] != grams[wrong])]
        out = self.values[found]
        missing = np.flatnonzero(found < 0)
        if len(missing):
            rare, back = np.unique(grams[missing], return_inverse=True)
            out[missing] = self._exact(rare).astype(np.float32)[back]
        return out

    def score(self, docs: list[bytes], fold=folded) -> np.ndarray:
        """One row a text, one column a model. Every text starts after ``order`` spaces (an empty text: 0)."""
        if not docs:
            return np.zeros((0, len(self.models)))
        pad = b" " * (self.order + 1)
        data = fold(pad + pad.join(docs))
        lengths = np.fromiter((len(d) for d in docs), dtype=np.int64, count=len(docs))
        start = np.cumsum(lengths + len(pad)) - lengths
        values = self.values_of(_keys(data, self.order + 1)).astype(np.float64)
        own = np.zeros(len(data) + 1, dtype=np.int8)
        own[start] += 1
        np.subtract.at(own, start + lengths, 1)
        values[np.cumsum(own[:-1]) <= 0] = 0
        return np.add.reduceat(values, start - len(pad), axis=0)


def training(docs: list[bytes], order: int, fold=folded) -> np.ndarray:
    """Texts put together as ``Scorer.score`` sees them."""
    pad = b" " * (order + 1)
    return fold(pad + pad.join(docs))


def counted(docs: list[bytes], order: int, fold=folded) -> tuple[np.ndarray, np.ndarray]:
    """The (order+1)-byte strings that end in each text or in the spaces after it, and how often they do.

    Those of several lists add up to those of all texts, in any order.
    """
    pad = b" " * (order + 1)
    return np.unique(_keys(fold(pad + pad.join(docs) + pad), order + 1)[order + 1 :], return_counts=True)
