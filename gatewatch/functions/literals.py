"""Literals that a text must hold before a pattern is worth trying.

From each pattern come clauses: sets of literals of which every match holds at least one. One pass of an
automaton over a text, with all clauses' literals, then tells which patterns can match at all. Letter case is
ignored, so the answer errs only towards trying.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most literals that a clause spells out.
MOST_LITERALS = 64
#: Patterns in one number of a mask.
WORD = 62
_QUANTIFIER = re.compile(r"[*+?]\??|\{(\d+)(,\d*)?\}\??")
_CLASS = re.compile(r"\[(\^?)((?:\\.|[^\]\\])*)\]")

#: What a part of a pattern can spell: all its texts if they are few (else None), and its clauses.
Spelled = tuple[set[str] | None, list[frozenset[str]]]


class _Reader:
    """Reads a pattern of ECMAScript from left to right."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def alternatives(self) -> Spelled:
        parts = [self._sequence()]
        while self.at < len(self.pattern) and self.pattern[self.at] == "|":
            self.at += 1
            parts.append(self._sequence())
        if len(parts) == 1:
            return parts[0]
        exact = _few(set().union(*(e for e, _ in parts))) if all(e is not None for e, _ in parts) else None
        best = [_best(e, clauses) for e, clauses in parts]
        either = frozenset().union(*best) if all(best) else frozenset()
        return exact, [either] if either and len(either) <= MOST_LITERALS else []

    def _sequence(self) -> Spelled:
        run: set[str] = {""}
        clauses, whole = [], True
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            exact, own = self._item()
            joined = _few({a + b for a in run for b in exact}) if exact is not None else None
            if joined is not None:
                run = joined
                continue
            whole = False
            clauses += [*_clause(run), *own] if exact is None else _clause(run)
            run = exact if exact is not None else {""}
        return (run, _clause(run)) if whole else (None, clauses + _clause(run))

    def _item(self) -> Spelled:
        exact, clauses = self._atom()
        found = _QUANTIFIER.match(self.pattern, self.at)
        if not found:
            return exact, clauses
        self.at = found.end()
        mark = found[0].rstrip("?") if len(found[0]) > 1 else found[0]
        if mark == "?":
            return (exact | {""} if exact is not None else None), []
        if mark == "*" or found[1] == "0":
            return None, []
        return None, clauses or (_clause(exact) if exact is not None else [])

    def _atom(self) -> Spelled:
        c = self.pattern[self.at]
        if c == "(":
            ahead = re.compile(r"\((\?[=!]|\?<[=!]|\?:|)").match(self.pattern, self.at)
            self.at = ahead.end()
            inner = self.alternatives()
            self.at += 1
            return ({""}, []) if ahead[1] not in ("", "?:") else inner
        if c == "[":
            found = _CLASS.match(self.pattern, self.at)
            self.at = found.end()
            plain = not found[1] and found[2].isascii() and re.fullmatch(r"(?:[^\\-]|\\[^\w\s]){1,8}", found[2])
            return ({x.lower() for x in re.sub(r"\\(.)", r"\1", found[2])} if plain else None), []
        self.at += 1
        if c == "\\":
            c = self.pattern[self.at]
            self.at += 1
            if c in "bB":
                return {""}, []
            if c.isalnum():
                return None, []
        elif c in "^$":
            return {""}, []
        elif c == ".":
            return None, []
        return ({c.lower()} if c.isascii() else None), []


def _few(texts: set[str]) -> set[str] | None:
    return texts if len(texts) <= MOST_LITERALS else None


def _clause(run: set[str]) -> list[frozenset[str]]:
    return [frozenset(run)] if run and all(run) else []


def _best(exact: set[str] | None, clauses: list[frozenset[str]]) -> frozenset[str]:
    """The clause with the longest literals, of equal ones the one with the fewest."""
    options = [*clauses, *(_clause(exact) if exact is not None else [])]
    return max(options, key=lambda c: (min(map(len, c)), -len(c)), default=frozenset())


def required(pattern: str) -> list[frozenset[str]]:
    """Clauses of a pattern, in lower case; none if nothing can be said."""
    reader = _Reader(pattern)
    _, clauses = reader.alternatives()
    return clauses if reader.at == len(pattern) else []


class Screen:
    """All patterns' literals in one automaton."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.clauses = [required(p) for p in patterns]
        literals = sorted({x for clauses in self.clauses for c in clauses for x in c})
        place = {x: 1 << k for k, x in enumerate(literals)}
        self.wanted = [[sum(place[x] for x in c) for c in clauses] for clauses in self.clauses]
        self.automaton = ahocorasick.Automaton()
        for x, bit in place.items():
            self.automaton.add_word(x, bit)
        if place:
            self.automaton.make_automaton()
        self.memory: dict[int, list[int]] = {}

    def _found(self, text: str) -> int:
        # bytes.lower() changes A-Z only, and one character stands for each byte, as the literals are ASCII
        lowered = text.encode().lower().decode("latin-1")
        found = 0
        for bit in {bit for _, bit in self.automaton.iter(lowered)} if len(self.automaton) else ():
            found |= bit
        return found

    def mask(self, text: str) -> list[int]:
        """Bits of the patterns to try, ``WORD`` to a number."""
        found = self._found(text)
        if found not in self.memory:
            if len(self.memory) > 10_000:
                self.memory.clear()
            words = [0] * -(-len(self.wanted) // WORD)
            for k, clauses in enumerate(self.wanted):
                if all(found & c for c in clauses):
                    words[k // WORD] |= 1 << k % WORD
            self.memory[found] = words
        return self.memory[found]


def mask_of(text: Column, patterns: list[str]) -> Column:
    """Which patterns each text can match: an array of numbers, or null for null."""

    @F.pandas_udf("array<long>")
    def masks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        screen = Screen(patterns)
        for texts in batches:
            yield texts.map(screen.mask, na_action="ignore")

    return masks(text)


def to_try(mask: str, k: int) -> str:
    """SQL: whether pattern ``k`` is in the mask column."""
    return f"(`{mask}`[{k // WORD}] & {1 << k % WORD}L) <> 0"
