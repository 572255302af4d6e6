"""Code-point class tables and chunking shared by the text operators (NumPy, inside tasks)."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE, SEPARATOR = range(5)

# The code points with the White_Space property.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
    0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """uint8 class of each code point: letter (L*), number (N*), white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)),
        dtype=np.uint8,
        count=sys.maxunicode + 1,
    )
    table[list(WHITE_SPACE)] = SPACE
    return table


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """uint32 lower-case code point of each code point (itself where that is not one code point)."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000:
            continue
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def chunks(texts: list[str], budget: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``budget`` characters; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > budget:
            yield start, i
            start = size = 0
            start = i
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
