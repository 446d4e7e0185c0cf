"""Helpers shared by the text operators.

A word is a maximal run of characters other than space and the controls
0x09-0x0D; Python's ``bytes.split()`` cuts at exactly these six bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.storage import cut, scratch, table  # noqa: F401  the operators take them from here

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


#: Bytes of a long text that are taken at once.
LONG = 1 << 18
SPACES = re.compile(rb"[\x20\x09-\x0d]+")


def word_pieces(raw: bytes, keep: int, size: int | None = None) -> Iterator[tuple[list[bytes], int]]:
    """(words, how many of them were met before) of a text: one piece for most
    texts; a long one is cut at white space after about ``size`` bytes, and a
    piece begins with the ``keep`` words before it."""
    size = size or LONG
    at, met, held = 0, 0, []
    while len(raw) - at > 2 * size and (found := SPACES.search(raw, at + size)):
        words = held + raw[at : found.start()].split()
        at, held = found.end(), words
        if len(words) > keep:  # else white space, or a few very long words
            yield words, met
            held = words[len(words) - keep :]
            met = len(held)
    yield held + (raw[at:] if at else raw).split(), met


def held_out(column: str, folds: int) -> Column:
    """Whether crc32 of the id, written as text, leaves 1 on division."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == 1, F.lit(False))
