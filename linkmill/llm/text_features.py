"""Features of whole texts, computed for a chunk of texts at once."""

from __future__ import annotations

import numpy as np

from linkmill.llm.linear import Rows
from linkmill.llm.pretoken import LETTER, NUMBER, SPACE, byte_classes, prefix_sums, span_hashes

#: Characters that count as symbols, as the quality rules do.
SYMBOLS = b"#*$%&|<>"
SHAPES = ["log_words", "upper", "digit", "symbol", "exclaim", "other", "distinct", "next_equal", "word_length", "repeat_pairs", "marked_words", "line_length", "distinct_lines"]


def lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs of set bytes; a run ends with its text."""
    n = len(mask)
    head = np.zeros(n + 1, dtype=bool)
    head[offsets] = True
    start, stop = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1] | head[1:n]
    stop[:-1] &= ~mask[1:] | head[1:n]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return start, stop, np.searchsorted(offsets, start, side="right") - 1


def word_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Rows:
    """Which hashed words (runs of letters, ASCII lower-cased) each text has, as rows of ones."""
    texts = len(offsets) - 1
    if not len(data):
        return Rows(np.zeros(texts + 1, np.int64), np.zeros(0, np.int32), np.zeros(0), width)
    start, stop, text = runs(byte_classes(data) == LETTER, offsets)
    column = (span_hashes(prefix_sums(lower(data)), start, stop) % np.uint64(width)).astype(np.int64)
    both = np.unique(text * width + column)
    text, column = both // width, both % width
    return Rows(np.append(0, np.cumsum(np.bincount(text, minlength=texts))), column.astype(np.int32), np.ones(len(column)), width)


def shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of SHAPES for each text; all zero for a text without words."""
    texts = len(offsets) - 1
    out = np.zeros((texts, len(SHAPES)))
    if not len(data):
        return out
    kind = byte_classes(data)
    start, stop, text = runs(kind < SPACE, offsets)
    count = np.bincount(text, minlength=texts)
    size = np.maximum(np.diff(offsets), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(mask))[offsets]) / size

    word = span_hashes(prefix_sums(data), start, stop)
    same = np.append(False, (word[1:] == word[:-1]) & (text[1:] == text[:-1]))
    each = np.maximum(count, 1)

    def distinct(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        bounds, keys = np.searchsorted(of, np.arange(texts + 1)), keys.copy()
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            keys[s:e].sort()
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        new[bounds[:-1][bounds[:-1] < len(keys)]] = True
        return np.bincount(of[new], minlength=texts)

    pair = word[:-1] * np.uint64(31) + word[1:] if len(word) else word
    inner = (text[1:] == text[:-1]) if len(text) else np.zeros(0, bool)
    pairs = np.bincount(text[1:][inner], minlength=texts) if len(text) else count
    odd = np.isin(data, np.frombuffer(SYMBOLS + b"!", np.uint8))
    marks = np.append(0, np.cumsum(odd))
    marked = np.bincount(text, weights=marks[stop] > marks[start], minlength=texts)
    line_start, line_stop, line_text = runs(data != 10, offsets)
    lines = np.maximum(np.bincount(line_text, minlength=texts), 1)
    line = span_hashes(prefix_sums(data), line_start, line_stop)
    upper = (data >= 65) & (data <= 90)
    out[:] = np.stack(
        [
            np.log1p(count) / 10,
            share(upper),
            share(kind == NUMBER),
            share(np.isin(data, np.frombuffer(SYMBOLS, np.uint8))),
            share(data == 33),
            share(kind == 0),
            distinct(word, text) / each,
            np.bincount(text, weights=same, minlength=texts) / each,
            np.log1p(np.bincount(text, weights=stop - start, minlength=texts) / each) / 5,
            1 - distinct(pair[inner], text[1:][inner]) / np.maximum(pairs, 1) if len(text) else np.zeros(texts),
            marked / each,
            np.log1p(size / lines) / 10,
            distinct(line, line_text) / lines,
        ],
        axis=1,
    )
    return np.where(count[:, None] > 0, out, 0.0)
