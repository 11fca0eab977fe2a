"""Splits texts into pre-tokens exactly as a tokenizer library does.

The pattern runs in the ``regex`` module, whose Unicode tables may be newer than the
library's. Characters beyond the common ones are therefore put to the library once, and a
character that the two class differently is replaced, for the split alone, by a stand-in
of the library's class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import regex

#: One character of each class that every Unicode version agrees on.
STAND_IN = {"L": "一", "N": "٠", "S": " ", "O": "☃"}
_CLASSES = (("S", regex.compile(r"\s")), ("L", regex.compile(r"\p{L}")), ("N", regex.compile(r"\p{N}")))


def own_class(char: str) -> str:
    return next((name for name, pattern in _CLASSES if pattern.match(char)), "O")


class Splitter:
    """``library_class`` tells the library's class of a character: L, N, S or O."""

    def __init__(self, pattern: str, library_class: Callable[[str], str]):
        self.pattern = regex.compile(pattern)
        self.library_class = library_class
        self.known: dict[str, str | None] = {}

    def stand_in(self, char: str) -> str | None:
        if char not in self.known:
            there = self.library_class(char)
            self.known[char] = None if there == own_class(char) else STAND_IN[there]
        return self.known[char]

    def odd(self, text: str) -> dict[int, str]:
        try:
            text.encode("latin-1")
            return {}
        except UnicodeEncodeError:
            unusual = {c for c in set(text) if c > "ÿ"}
            return {ord(c): s for c in unusual if (s := self.stand_in(c))}

    def stretches(self, text: str, size: int) -> Iterator[list[str]]:
        """The pre-tokens of a very long text, ``size`` at a time."""
        matches = self.pattern.finditer(text.translate(odd) if (odd := self.odd(text)) else text)
        while pieces := [text[m.start() : m.end()] for m in islice(matches, size)]:
            yield pieces

    def split(self, text: str) -> list[str]:
        odd = self.odd(text)
        if not odd:
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(odd))]
