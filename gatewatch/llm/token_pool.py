"""Token ids by the tokenizers library, with parts of words remembered.

A text is cut at spaces, where no token of either kind of vocabulary crosses. Words of plain and Latin-1
characters are split further as the vocabulary does it, and the library merges each distinct part once; other
words go whole through the library. Texts are then put together from the remembered ids by array operations.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a process remembers, with their parts, before it starts afresh.
POOL_WORDS = 1_000_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 4 << 20
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Characters of which the splitting is left to the library: all but letters, digits, punctuation, plain white space.
_OTHER = re.compile(rf"[^\t-\r -~{_LETTER}]")
#: Stands between words that are split at once; it is one of the others.
_NUL = "\x00"
#: How the two vocabularies split a text before merging (fixed values), for known characters.
_SPLITS = {
    "lower": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9\x00]+|\x00"),
    "bytes": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9\x00]+|\s+(?=[\s\x00])|\s+|\x00"),
}
#: White space before a space: there the byte vocabulary's tokens depend on both sides.
_ODD = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_CUT = re.compile(r"(?<=\S)(?= )")


def gathered(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + len]``, one after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lens), lens) + np.arange(total)]


class Lists:
    """Id lists of strings, flat."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.at, self.len = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add_flat(self, strings: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        self.place.update(zip(strings, range(len(self.at), len(self.at) + len(strings)), strict=True))
        self.at = np.concatenate([self.at, np.cumsum(lens) - lens + len(self.ids)])
        self.len = np.concatenate([self.len, lens])
        self.ids = np.concatenate([self.ids, ids])

    def add(self, strings: list[str], lists: list[list[int]]) -> None:
        lens = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        self.add_flat(strings, np.fromiter(chain.from_iterable(lists), np.int32, int(lens.sum())), lens)

    def find(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, strings), dtype=np.int64, count=len(strings))

    def take(self, index: np.ndarray) -> np.ndarray:
        return gathered(self.ids, self.at[index], self.len[index])


def _characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte value.

    Printable Latin-1 characters but the soft hyphen stand for their own code, and the characters from U+0100
    for the remaining byte values in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in own)
    out = [chr(b) for b in range(256)]
    for k, b in enumerate(rest):
        out[b] = chr(0x100 + k)
    return out


_SPELLING = _characters()


class TokenPool:
    """Encodes texts as one vocabulary file does.

    ``lower`` vocabularies lower-case and drop white space; ``bytes`` vocabularies keep it, and each text is
    encoded with a space before it. ``plain`` makes the strings of special tokens ordinary text.
    """

    def __init__(self, path: str, kind: str, plain: bool, pool_words: int = POOL_WORDS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.kind, self.split, self.pool_words = kind, _SPLITS[kind], pool_words
        self.merge = self.tokenizer.model.tokenize
        with open(path, encoding="utf-8") as file:
            self.specials = [] if plain else [t["content"] for t in json.load(file)["added_tokens"]]
        self._start_parts()
        self.known = Lists()

    def _start_parts(self) -> None:
        self.parts = Lists()
        self.parts.add([_NUL], [[]])

    def words(self, texts: pa.Array) -> pa.ListArray:
        """Of each text, words such that its tokens are those of each word after a space."""
        plain = pc.split_pattern(texts, " ")
        if self.kind == "lower" or not pc.any(odd := pc.match_substring_regex(texts, _ODD)).as_py():
            return plain
        cut = [[w[1:] for w in _CUT.split(" " + t)] for t in texts.filter(odd).to_pylist()]
        at = odd.to_numpy(zero_copy_only=False)
        order = np.argsort(np.concatenate([np.flatnonzero(~at), np.flatnonzero(at)]))
        return pa.concat_arrays([plain.filter(pc.invert(odd)), pa.array(cut, plain.type)]).take(pa.array(order))

    def _merged(self, parts: list[str]) -> list[list[int]]:
        """Ids of what the vocabulary's splitting leaves together, spelled in the bytes' own characters."""
        spelled = _NUL.join(parts).encode().decode("latin-1").translate(_SPELLING).split(_SPELLING[0])
        return [[t.id for t in self.merge(s)] for s in spelled]

    def _split(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of known characters, flat, and each word's count."""
        blank = "" if self.kind == "lower" else " "
        joined = _NUL.join(blank + w for w in words) + _NUL
        flat = self.split.findall(joined.lower() if self.kind == "lower" else joined)
        if new := list(set(flat).difference(self.parts.place)):
            self.parts.add(new, self._merged(new))
        index = self.parts.find(flat)
        ends = np.cumsum(self.parts.len[index])
        last = ends[np.flatnonzero(index == self.parts.place[_NUL])]
        return self.parts.take(index), np.diff(last, prepend=0)

    def _learn(self, words: list[str]) -> None:
        odd = []
        if _OTHER.search("".join(words)) or any(s in w for s in self.specials for w in words):
            odd = [w for w in words if _OTHER.search(w) or any(s in w for s in self.specials)]
            words = list(set(words).difference(odd))
        if words:
            ids, lens = self._split(words)
            self.known.add_flat(words, ids, lens)
        if odd:
            found = self.tokenizer.encode_batch_fast([" " + w for w in odd], add_special_tokens=False)
            self.known.add(odd, [e.ids for e in found])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and each text's count. An empty text of a ``bytes`` vocabulary is one space."""
        per_text = self.words(texts)
        coded = per_text.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known.place) > self.pool_words:
            self.known = Lists()
        if len(self.parts.place) > self.pool_words:
            self._start_parts()
        if new := [w for w in words if w not in self.known.place]:
            self._learn(new)
        index = self.known.find(words)[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(self.known.len[index])])
        bounds = np.concatenate([[0], np.cumsum(per_text.value_lengths().to_numpy())])
        return self.known.take(index), np.diff(ends[bounds])


@lru_cache(maxsize=4)
def token_pool(path: str, kind: str, plain: bool) -> TokenPool:
    """One pool a process: what one task has encoded, the next one in that worker knows."""
    return TokenPool(path, kind, plain)


@lru_cache(maxsize=2)
def byte_strings(path: str) -> list[bytes]:
    """Bytes of each entry of a byte-level vocabulary, by id."""
    value = {c: b for b, c in enumerate(_SPELLING)}
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    specials = {t["id"]: t["content"].encode() for t in data["added_tokens"]}
    out = [b""] * (1 + max(*specials, *data["model"]["vocab"].values()))
    for token, i in data["model"]["vocab"].items():
        out[i] = specials[i] if i in specials else bytes(value[c] for c in token)
    return out
