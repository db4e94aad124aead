"""Splitting a text for byte-pair vocabularies so that equal pieces are encoded once.

A text may be cut before every space that is followed by something else than white space: no piece of the usual
byte-level pattern crosses such a place, and what follows does not change the pieces before it. The chunks between
the cuts are mostly single words, repeat often, and are looked up in a memo.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .common import Memo

_LOOSE = re.compile(r"\s")


class Loose(Exception):
    """A space before white space or at the end: the text is not cut there."""


class ChunkMemo:
    """Values of the chunks of texts; ``compute`` gets the text of a chunk or of a whole irregular text."""

    def __init__(self, compute: Callable[[str], object], limit: int = 300_000):
        self.compute = compute
        self.after_space = Memo(self._after_space, limit)

    def _after_space(self, part: str):
        if not part or _LOOSE.match(part):
            raise Loose
        return self.compute(" " + part)

    def values(self, text: str) -> list:
        """One value per chunk, in order."""
        head, *rest = text.split(" ")
        try:
            found = list(map(self.after_space.__getitem__, rest))
        except Loose:
            return [self.compute(text)]
        return [self.compute(head), *found] if head else found
