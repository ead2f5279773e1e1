"""Vectorised splitting of UTF-8 text into the matches of the byte-level BPE pattern.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\s L N]+|\\s+(?!\\S)|\\s+`` with the Unicode
classes of letters and numbers. Its matches follow from the classes of neighbouring characters:

* a token starts where the class changes, except that one space belongs to the token after it;
* of white space before a visible character the last character is split off;
* an apostrophe that starts a token takes one of the seven endings with it.

So the whole buffer of a chunk is split with a few array operations, without a regular expression.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE, WHITE = range(5)
#: White_Space of the Unicode standard without the blank.
WHITE_SPACE = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that an apostrophe takes.
ENDINGS = [b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"]


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(sys.maxunicode + 1):
        if kind := kinds.get(unicodedata.category(chr(c))[0]):
            out[c] = kind
    out[WHITE_SPACE] = WHITE
    out[32] = SPACE
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of valid UTF-8 belongs to."""
    table = classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0xFF >> (size + 1))
        last = len(data) - 1
        for k in (1, 2, 3):
            has = size > k
            point = np.where(has, (point << 6) | (data[np.minimum(lead + k, last)] & 0x3F), point)
        kind = table[point]
        out[lead] = kind
        for k in (1, 2, 3):
            has = size > k
            out[lead[has] + k] = kind[has]
    return out


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions at which the tokens of all texts start. data: their bytes; offsets: n + 1 bounds of the texts."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = byte_classes(data)
    head = np.zeros(n + 1, dtype=bool)  # first byte of a text, or behind the end
    head[offsets] = True
    char = (data & 0xC0) != 0x80
    white = kind >= SPACE
    flat = np.where(white, WHITE, kind)
    start = np.empty(n, dtype=bool)
    start[0] = True
    start[1:] = flat[1:] != flat[:-1]
    start |= head[:n]
    # The first byte behind each character; is it white space, and of the same text?
    shown = np.empty(n, dtype=bool)  # a visible character of the same text follows
    shown[-1] = False
    shown[:-1] = ~white[1:] & ~head[1:n]
    multi = white & (data >= 0x80)
    tail = white & shown  # last byte of the white space before a visible character
    if multi.any():  # the head of a last white character of several bytes
        at = np.flatnonzero(tail & multi)
        back = at.copy()
        while (more := ~char[back]).any():
            back[more] -= 1
        tail[at] = False
        tail[back] = True
    start |= tail
    # A blank that is split off joins what follows.
    at = np.flatnonzero(tail & (kind == SPACE))
    start[at + 1] = False
    # Apostrophes that start a token.
    quote = np.flatnonzero((data == 39) & start)
    if len(quote):
        padded = np.concatenate([data, np.zeros(2, dtype=np.uint8)])
        stop = offsets[np.searchsorted(offsets, quote, side="right")]  # end of the text
        one, two = padded[quote + 1], padded[quote + 2]
        for ending in ENDINGS:
            hit = (one == ending[0]) & (quote + len(ending) < stop)
            if len(ending) == 2:
                hit &= two == ending[1]
            where = quote[hit]
            start[where + 1] = False
            after = where + 1 + len(ending)
            after = after[after < n]
            start[after] = True
            # a blank behind an ending starts a token of its own already; a letter now does
    return np.flatnonzero(start)


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def inverse() -> np.uint64:
    return np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2 ** 64."""
    global _powers
    if len(_powers[0]) < n:
        out = []
        for base in (MULTIPLIER, inverse()):
            row = np.full(n, base, dtype=np.uint64)
            row[0] = 1
            out.append(np.multiply.accumulate(row))
        _powers = out[0], out[1]
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte times power, from which span_hashes() has the hash of any span."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((mixed(np.arange(1, 257, dtype=np.uint64)))[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal spans have equal hashes wherever they are."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
