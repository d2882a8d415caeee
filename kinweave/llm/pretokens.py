"""Byte positions of pre-tokens by the pattern of the byte-level vocabularies, without a regex engine.

The pattern, 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ , cuts a
text at changes of character class; a blank before a run belongs to the run, the last of several white
characters before something else stands apart, and an apostrophe that starts a pre-token takes one or
two letters with it. Each of these rules is a comparison of neighbouring characters.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

from .ragged import Chunk

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Characters with the property White_Space.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def classes() -> np.ndarray:
    """Class of each code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[list(WHITE)] = SPACE
    return table


def split(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) in bytes, as words() returns them; pre-tokens cover every byte."""
    if not c.size:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(c.n + 1, np.int64)
    raw = c.data[: c.size]
    lead = (raw & 0xC0) != 0x80
    if lead.all():
        point, place, off = raw, None, c.off
    else:
        point = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.flatnonzero(lead)
        off = np.searchsorted(place, c.off)
    n = len(point)
    kind = classes()[point]
    edge = np.zeros(n + 1, bool)  # a text starts here
    edge[off] = True
    edge[n] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    # the last white character before something else: apart, or in front of what follows
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~edge[1:n]
    blank = last & (point == 0x20)
    start |= last
    after = np.flatnonzero(blank) + 1
    start[after] = False
    # apostrophes that start a pre-token, with the letters that they take
    quote = np.flatnonzero((point == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~edge[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        one = point[quote + 1]
        two = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], point[np.minimum(quote + 2, n - 1)], 0)
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        took = np.where(short, 1, np.where(long, 2, 0))
        hit, took = quote[took > 0], took[took > 0]
        start[hit + 1] = False
        rest = hit + 1 + took
        start[rest[rest < n]] = True
    at = np.flatnonzero(start)
    first = np.searchsorted(at, off)
    starts = at if place is None else place[at]
    ends = np.append(starts[1:], c.size)
    return starts, ends, first
