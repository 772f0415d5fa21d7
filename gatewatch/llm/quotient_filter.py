"""Counting quotient filters over packed n-grams of word ids.

An n-gram of ids of ``bits`` bits each is packed into a few lanes and permuted by a Feistel network whose rounds
change one lane by a hash of the others, which can be undone. The permuted number is cut into a bucket, a
quotient and the whole remainder: nothing is lost, so the counts are exact and the n-grams can be read back.
A filter keeps its entries sorted. Written out, a bucket has the quotients' run lengths in unary, the remainders
in as few bytes as they need, and the counters in a byte each, with larger ones behind.
"""

from __future__ import annotations

from functools import reduce

import numpy as np

_U = np.uint64
#: Multipliers of the mixing step (fixed values of a well-known 64-bit finaliser).
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
_SALT = 0x9E3779B97F4A7C15
#: Counters from here on are written in full.
_LARGE = 255


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _MIX[0]
    x = (x ^ x >> _U(27)) * _MIX[1]
    return x ^ x >> _U(31)


class Ngrams:
    """How n-grams of ``words`` ids become permuted numbers (arrays of 64-bit limbs, most significant first)."""

    def __init__(self, words: int, bits: int):
        if not 1 <= bits <= 32:
            raise ValueError("word ids have 1 to 32 bits")
        self.words, self.bits = words, bits
        self.of_lane = [1, 1] if words == 2 else [2] * (words // 2) + [1] * (words % 2)
        self.widths = [bits * n for n in self.of_lane]
        self.masks = [_U((1 << w) - 1) for w in self.widths]
        self.one_limb = sum(self.widths) <= 64
        self.limb_widths = [sum(self.widths)] if self.one_limb else self.widths

    def _rounds(self) -> list[int]:
        return [r % len(self.widths) for r in range(len(self.widths) + 1)]

    def _round(self, lanes: list[np.ndarray], j: int, r: int) -> None:
        others = reduce(lambda seen, lane: mixed(seen + lane), (lane for i, lane in enumerate(lanes) if i != j), _U(_SALT * (r + 1) & (1 << 64) - 1))
        lanes[j] = lanes[j] ^ others & self.masks[j]

    def permuted(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """Limbs of the n-grams whose first, second, ... ids are given."""
        lanes, at = [], 0
        for n in self.of_lane:
            lanes.append(reduce(lambda lane, x: lane << _U(self.bits) | x, (x.astype(_U) for x in ids[at : at + n])))
            at += n
        for r, j in enumerate(self._rounds()):
            self._round(lanes, j, r)
        return [reduce(lambda limb, k: limb << _U(self.widths[k]) | lanes[k], range(1, len(lanes)), lanes[0])] if self.one_limb else lanes

    def ids(self, limbs: list[np.ndarray]) -> np.ndarray:
        """The n-grams of permuted numbers, a row each."""
        lanes = list(limbs)
        if self.one_limb:
            lanes, rest = [], limbs[0]
            for k in range(len(self.widths) - 1, -1, -1):
                lanes.insert(0, rest & self.masks[k])
                rest = rest >> _U(self.widths[k])
        for r, j in reversed(list(enumerate(self._rounds()))):
            self._round(lanes, j, r)
        one = _U((1 << self.bits) - 1)
        return np.stack([lane >> _U(self.bits * (n - 1 - k)) & one for lane, n in zip(lanes, self.of_lane, strict=True) for k in range(n)], axis=1).astype(np.int64)

    def marks(self, limbs: list[np.ndarray]) -> np.ndarray:
        """64 bits that spread the n-grams evenly."""
        return reduce(lambda seen, limb: mixed(seen + limb), limbs, _U(_SALT)).view(np.int64)


class Filter:
    """Sorted distinct limbs and their counts."""

    def __init__(self, limbs: list[np.ndarray], counts: np.ndarray):
        self.limbs, self.counts = limbs, counts

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def of(cls, limbs: list[np.ndarray], counts: np.ndarray | None = None) -> Filter:
        order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
        limbs = [x[order] for x in limbs]
        n = len(order)
        new = np.ones(n, dtype=bool)
        if n:
            new[1:] = reduce(np.logical_or, (x[1:] != x[:-1] for x in limbs))
        starts = np.flatnonzero(new)
        totals = np.diff(np.append(starts, n)) if counts is None else np.add.reduceat(counts[order], starts) if n else counts
        return cls([x[starts] for x in limbs], totals.astype(np.int64))

    @classmethod
    def merged(cls, filters: list[Filter]) -> Filter:
        limbs = [np.concatenate(x) for x in zip(*(f.limbs for f in filters), strict=True)]
        return cls.of(limbs, np.concatenate([f.counts for f in filters]))

    def buckets(self, grams: Ngrams, bucket_bits: int) -> list[tuple[int, bytes]]:
        """The filter in buckets of the highest ``bucket_bits`` bits, written out."""
        rest = grams.limb_widths[0] - bucket_bits
        number = (self.limbs[0] >> _U(rest)).astype(np.int64)
        starts = np.flatnonzero(np.diff(number, prepend=-1))
        ends = np.append(starts[1:], len(number))
        return [(int(number[a]), self._written(a, b, grams, rest)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _written(self, a: int, b: int, grams: Ngrams, rest: int) -> bytes:
        n = b - a
        q = min(rest, n.bit_length())
        low = rest - q
        first = self.limbs[0][a:b] & _U((1 << rest) - 1)
        runs = np.bincount((first >> _U(low)).astype(np.int64), minlength=1 << q)
        unary = np.ones(n + (1 << q), dtype=np.uint8)
        unary[np.cumsum(runs) + np.arange(1 << q)] = 0
        counts = self.counts[a:b]
        parts = [np.array([n], "<i8").tobytes(), np.packbits(unary).tobytes()]
        parts += [_bytes(x, w) for x, w in zip([first & _U((1 << low) - 1), *(x[a:b] for x in self.limbs[1:])], [low, *grams.limb_widths[1:]], strict=True)]
        parts += [np.minimum(counts, _LARGE).astype(np.uint8).tobytes(), counts[counts >= _LARGE].astype("<i8").tobytes()]
        return b"".join(parts)

    @classmethod
    def read(cls, number: int, data: bytes, grams: Ngrams, bucket_bits: int) -> Filter:
        """A bucket as it was written."""
        rest = grams.limb_widths[0] - bucket_bits
        n = int(np.frombuffer(data, "<i8", 1)[0])
        q = min(rest, n.bit_length())
        low, at = rest - q, 8
        size = (n + (1 << q) + 7) // 8
        unary = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n + (1 << q))
        runs = np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1
        at += size
        limbs = []
        for w in [low, *grams.limb_widths[1:]]:
            limb, at = _numbers(data, at, n, w)
            limbs.append(limb)
        limbs[0] |= np.repeat(np.arange(1 << q, dtype=_U), runs) << _U(low) | _U(number << rest)
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        counts[counts == _LARGE] = np.frombuffer(data, "<i8", -1, at + n)
        return cls(limbs, counts)


def _bytes(x: np.ndarray, width: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, : (width + 7) // 8].tobytes()


def _numbers(data: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    size = (width + 7) // 8
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    return out.view("<u8").reshape(n).astype(_U), at + n * size
