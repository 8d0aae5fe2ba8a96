"""Words of texts as bytes, in stretches of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .common import STEP


class Words:
    """Runs of certain bytes, given as the inside of a character class, of texts whose A to Z are lower-cased."""

    def __init__(self, inside: bytes):
        self.word, self.gap = re.compile(b"[" + inside + b"]+"), re.compile(b"[^" + inside + b"]")

    def lists(self, text: bytes, size: int = STEP) -> Iterator[list[bytes]]:
        """The words in order, a list for each stretch of about size bytes; no word is cut."""
        text, at = text.lower(), 0
        while at < len(text):
            cut = self.gap.search(text, at + size) if at + size < len(text) else None
            end = cut.start() if cut else len(text)
            yield self.word.findall(text, at, end)
            at = end
