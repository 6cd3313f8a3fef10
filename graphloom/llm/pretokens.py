"""Pre-tokens of byte-level vocabularies, and a bounded memory of what they encode to."""

from __future__ import annotations

import re
from collections.abc import Callable

#: The byte-level pre-token pattern. A fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for Python, where letters, numbers and white space are as there: Latin, Greek, Cyrillic and
#: general punctuation (a test holds each character against the library). OTHER finds any other one.
NUMBER = "0-9²³¹¼-¾"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W_{NUMBER}]+| ?[{NUMBER}]+| ?(?:[^\s\w{NUMBER}]|_)+|\s+(?!\S)|\s+")
OTHER = re.compile("[^\u0000-\u001b -ɏΆ-ҁҊ-ԣ‐-‧‰-⁞]")


class Memory:
    """Values of pre-tokens, worked out in batches; begins anew beyond ``limit`` of them.

    Pre-tokens of over LONG characters are forgotten at the next call, so the bytes held are bounded, too.
    """

    LONG = 64

    def __init__(self, compute: Callable[[list[str]], list], limit: int, fixed: dict | None = None):
        self.compute, self.limit, self.fixed = compute, limit, fixed or {}
        self.known, self.long = dict(self.fixed), []

    def of(self, lists: list[list[str]]) -> dict:
        """A table that has every piece of ``lists``, good until the next call."""
        for piece in self.long:
            self.known.pop(piece, None)
        missing = set().union(*lists).difference(self.known)
        if len(self.known) + len(missing) > len(self.fixed) + self.limit:
            self.known = dict(self.fixed)
            missing = set().union(*lists).difference(self.known)
        names = list(missing)
        for at in range(0, len(names), 5000):
            part = names[at : at + 5000]
            self.known.update(zip(part, self.compute(part)))
        self.long = [x for x in names if len(x) > self.LONG]
        return self.known
