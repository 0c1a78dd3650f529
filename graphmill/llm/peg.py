"""A small packrat parser: parsing expressions over text with source offsets.

Each rule is tried at most once per offset, as results are kept by (rule, offset); parsing is linear in
the text. Terminals are regular expressions. Matching a rule gives (end, value) or None; an action turns
the values of a rule into one value and gets the offsets of the match.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

Match = tuple[int, Any] | None
Expr = Callable[["Parser", int], Match]


class Parser:
    """The text and what has been matched in it so far."""

    __slots__ = ("text", "rules", "memo")

    def __init__(self, text: str, rules: dict[str, Expr]):
        self.text, self.rules = text, rules
        self.memo: dict[tuple[str, int], Match] = {}


def token(pattern: str, flags: int = 0) -> Expr:
    """A terminal; its value is the text matched."""
    match = re.compile(pattern, flags).match

    def run(p: Parser, at: int) -> Match:
        m = match(p.text, at)
        return (m.end(), m[0]) if m else None

    return run


def rule(name: str) -> Expr:
    """A named rule, kept by offset."""

    def run(p: Parser, at: int) -> Match:
        key = (name, at)
        if key not in p.memo:
            p.memo[key] = p.rules[name](p, at)
        return p.memo[key]

    return run


def seq(*parts: Expr) -> Expr:
    def run(p: Parser, at: int) -> Match:
        values = []
        for part in parts:
            got = part(p, at)
            if got is None:
                return None
            at = got[0]
            values.append(got[1])
        return at, values

    return run


def first(*options: Expr) -> Expr:
    """Ordered choice."""

    def run(p: Parser, at: int) -> Match:
        for option in options:
            got = option(p, at)
            if got is not None:
                return got
        return None

    return run


def many(part: Expr, least: int = 0) -> Expr:
    def run(p: Parser, at: int) -> Match:
        values = []
        while (got := part(p, at)) is not None and got[0] > at:
            at = got[0]
            values.append(got[1])
        return (at, values) if len(values) >= least else None

    return run


def maybe(part: Expr) -> Expr:
    def run(p: Parser, at: int) -> Match:
        return part(p, at) or (at, None)

    return run


def unless(part: Expr) -> Expr:
    """Succeeds without taking text where ``part`` does not match."""

    def run(p: Parser, at: int) -> Match:
        return None if part(p, at) is not None else (at, None)

    return run


def act(part: Expr, action: Callable[[int, int, Any], Any]) -> Expr:
    """The value of ``part`` through ``action(start, end, value)``."""

    def run(p: Parser, at: int) -> Match:
        got = part(p, at)
        return None if got is None else (got[0], action(at, got[0], got[1]))

    return run
