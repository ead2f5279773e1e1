"""Ids of texts by a byte-level tokenizer of the ``tokenizers`` library, each distinct word encoded once.

A word is a match of the pre-tokenizer's pattern. Merges never cross words, so a text's ids are those
of its words one after another. A worker process keeps the codes of the words it has met, up to a bound.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from linkmill.llm.pretoken import prefix_sums, span_hashes, token_starts

#: Distinct words that a process remembers; beyond that it forgets all and starts again.
WORDS = 600_000
#: Words that are handed to the library in one call.
CALL = 4096

Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]  # words to their ids in a row, and how many each has


def library_encoder(tokenizer) -> Encode:
    """The encoder of a ``tokenizers.Tokenizer`` with a byte-level pre-tokenizer."""

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for k in range(0, len(words), CALL):
            part = words[k : k + CALL]
            found = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, dtype=np.uint32))
            counts.append(np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(part)))
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(counts)

    return encode


class WordCodes:
    """Codes of words by their 64-bit hash."""

    def __init__(self, encode: Encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.start = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.codes = np.zeros(0, dtype=np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.known) + len(hashes) > WORDS:
            self.clear()
        ids, counts = self.encode(words)
        starts = len(self.codes) + np.cumsum(counts) - counts
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.start = np.insert(self.start, at, starts)
        self.count = np.insert(self.count, at, counts)
        self.codes = np.concatenate([self.codes, ids])

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the n + 1 bounds of the texts among them."""
        starts = token_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        hashes = span_hashes(prefix_sums(data), starts, ends)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        fresh = np.empty(len(order), dtype=bool)
        fresh[0] = True
        fresh[1:] = ordered[1:] != ordered[:-1]
        inverse = np.empty(len(order), dtype=np.int64)
        inverse[order] = np.cumsum(fresh) - 1
        distinct, first = ordered[fresh], order[fresh]
        new = self._missing(distinct)
        if len(new) and len(self.known) + len(new) > WORDS:
            self.clear()
            new = np.arange(len(distinct))
        if len(new):
            raw = data.tobytes()
            self._learn(distinct[new], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        at = np.searchsorted(self.known, distinct)
        start, count = self.start[at][inverse], self.count[at][inverse]
        done = np.cumsum(count)
        ids = self.codes[np.repeat(start - (done - count), count) + np.arange(done[-1])]
        bounds = np.append(0, done)[np.searchsorted(starts, offsets)]
        return ids, bounds

    def _missing(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        return np.flatnonzero(self.known[at] != hashes) if len(self.known) else np.arange(len(hashes))
