"""Sets of word shingles as sorted 64-bit hashes, made for whole batches of texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes of text that are hashed at once.
SLICE_BYTES = 1 << 21
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, flat, and each text's count.

    A word is a run of bytes other than the six white-space characters, with A to Z in lower case.
    """
    counts = np.zeros(len(texts), dtype=np.int64)
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64), counts
    inside = ~_SPACES[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start = np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), counts
    end = np.flatnonzero(edge == -1)  # data ends with a blank
    size = end - start
    longest = int(size.max())
    value = np.zeros(len(start), dtype=np.uint64)
    low = _LOWER[data].astype(np.uint64) + np.uint64(1)
    live = np.arange(len(start))
    for k in range(min(longest, 64)):
        value[live] = value[live] * _BASE + low[start[live] + k]
        live = live[size[live] > k + 1]
    for w in live.tolist():  # very long words
        value[w] = xxhash.xxh3_64_intdigest(_LOWER[data[start[w] : end[w]]].tobytes())
    value = mixed(value ^ size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return value, np.diff(np.searchsorted(start, bounds))


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, flat and ascending within a text, and each text's count.

    A text with fewer words than a shingle has its whole word sequence as the only one; one without words,
    or null, has none.
    """
    value, counts = word_hashes([(t or "").encode() for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    begins = ends - counts
    made = np.zeros(0, dtype=np.uint64)
    of = np.zeros(0, dtype=np.int64)
    if len(value) >= words:
        code = np.zeros(len(value) - words + 1, dtype=np.uint64)
        for k in range(words):
            code = code * _BASE + value[k : k + len(code)]
        whole = owner[: len(code)] == owner[words - 1 :]
        made, of = mixed(code[whole]), owner[: len(code)][whole]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        codes = []
        for d in short.tolist():
            code = np.uint64(counts[d])
            for v in value[begins[d] : ends[d]]:
                code = np.uint64((int(code) * int(_BASE) + int(v)) & 0xFFFFFFFFFFFFFFFF)
            codes.append(code)
        made, of = np.concatenate([made, mixed(np.array(codes, dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D))]), np.concatenate([of, short])
    order = np.lexsort((made, of))
    made, of = made[order], of[order]
    if len(made):
        keep = np.concatenate([[True], (made[1:] != made[:-1]) | (of[1:] != of[:-1])])
        made, of = made[keep], of[keep]
    return made, np.bincount(of, minlength=len(texts))
