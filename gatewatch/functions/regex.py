"""ECMAScript patterns as Java patterns with the same meaning."""

from __future__ import annotations

_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
SPACES = r"\s   -     　﻿"
_LINE = r"[^\n\r  ]"


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """Translates what differs: end anchor, word boundary, white space, dot, nested brackets, non-ASCII case."""
    out, in_class, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            two = pattern[at : at + 2]
            at += 2
            if two == r"\b" and not in_class:
                out.append(_BOUNDARY)
            elif two == r"\s":
                out.append(SPACES if in_class else f"[{SPACES}]")
            elif two == r"\/":
                out.append("/")
            else:
                out.append(two)
            continue
        at += 1
        if in_class:
            in_class = c != "]"
            out.append("\\" + c if c in "[&" else _cases(c, ignore_case))
        elif c == "[":
            in_class = True
            out.append(c)
        elif c == "$":
            out.append(r"\z")
        elif c == ".":
            out.append(_LINE)
        else:
            cases = _cases(c, ignore_case)
            out.append(cases if len(cases) == 1 else f"[{cases}]")
    return ("(?i)" if ignore_case else "") + "".join(out)


def _cases(c: str, ignore_case: bool) -> str:
    if not ignore_case or c.isascii() or len(c.upper()) != 1:
        return c
    return "".join(dict.fromkeys((c, c.upper(), c.lower())))


def any_of(patterns) -> str:
    """One alternation of patterns (of :class:`gatewatch.catalogs.Pattern`)."""
    return "|".join(f"(?:{to_java(p.pattern, p.ignore_case)})" for p in patterns)
