"""Words of whole texts, in pieces, so that a very long text never becomes
one long list of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

PIECE = 4 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")   # what bytes.split() cuts at


def word_chunks(data: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text (UTF-8), in lists of about ``piece`` bytes each;
    a word is never cut."""
    at = 0
    while at < len(data):
        cut = SPACE.search(data, at + piece)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end
