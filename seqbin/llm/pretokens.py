"""Cutting texts into pre-tokens."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import public_tokenizers
import regex

# letters, digits, punctuation and white space on which all regex engines agree
ODD = re.compile("[^\t\n\r\x20-\x7e¡«»¿-ɏ–—‘-”…]")
# the byte-level pattern for texts without any odd character
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that gives all matches of ``pattern`` in a text.

    For the byte-level pattern, texts of plain characters take a quicker expression
    with the same matches.
    """
    general = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return general
    odd, plain = ODD.search, _PLAIN.findall
    return lambda text: general(text) if odd(text) else plain(text)


class Remembered(dict):
    """Pre-tokens and what ``encode`` makes of them, of bounded size.

    There are two generations of at most ``remember`` entries: when the younger is
    full it becomes the older, and what is used again moves over. Pre-tokens of more
    than ``longest`` characters are encoded anew each time.
    """

    def __init__(self, encode: Callable[[str], Any], remember: int, longest: int = 64):
        super().__init__()
        self.encode, self.remember, self.longest = encode, remember, longest
        self.older: dict[str, Any] = {}

    def __missing__(self, piece: str) -> Any:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.remember:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids
