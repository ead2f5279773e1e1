"""Sum-of-squares online packing of tokenised documents into fixed windows (operator 2).

Documents are tokenised, ended with one end token and packed as they come. What exceeds a window is
cut into full windows from the document's start; the remainder is an item of the online packer. The
packer keeps a level array: how many partially filled windows stand at each fill level. An item goes
to the level (or to a new window) after which the sum of the squared counts is smallest, ties to the
fuller window. A segment of at most ``segment_tokens`` tokens is packed by itself, so that memory is
bounded; at its end the windows still open are closed by cutting: the emptiest give their tokens to
the fullest, and what is left of the last one is cut into sequences of power-of-two lengths, which
need no padding. No shuffle is needed: each input partition packs its own rows.

Defined results: a null or empty text is one end token; a null id is kept as null; repeated rows are
packed once each; an empty table gives no row; columns beside the id and the text are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmill.llm.runtime import text_buffer, text_chunks
from linkmill.llm.wordcodes import WordCodes, library_encoder

WINDOW = 2048
END_ID = 1
SEGMENT_TOKENS = 1 << 22
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


@functools.lru_cache(maxsize=2)
def codes(path: str) -> WordCodes:
    """The word codes of a byte-level tokenizer file; a worker process loads it once."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return WordCodes(library_encoder(tokenizer))


class LevelPacker:
    """Open windows by fill level. Pieces are [doc, start, ids, doc_tokens]."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}

    def place(self, piece: list) -> list | None:
        """Put a piece into the best level; the window if that fills it."""
        size = len(piece[2])
        held = self.count[1 : self.window - size + 1]
        levels = np.flatnonzero(held) + 1
        best, level = 2 * int(self.count[size]) + 1 if size < self.window else 1, 0
        if len(levels):
            to = levels + size
            change = 2 - 2 * self.count[levels] + 2 * self.count[to]
            change[to == self.window] -= 1  # a full window is no longer counted: only the old level changes
            k = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                level = int(levels[k])
        if level:
            bin_ = self.open[level].pop()
            self.count[level] -= 1
        else:
            bin_ = []
        bin_.append(piece)
        if level + size == self.window:
            return bin_
        self.count[level + size] += 1
        self.open.setdefault(level + size, []).append(bin_)
        return None

    def close(self) -> Iterator[list]:
        """Close all open windows, cutting the emptiest to fill the fullest."""
        bins = [(level, b) for level in sorted(self.open, reverse=True) for b in self.open[level]]
        self.count[:] = 0
        self.open = {}
        low = len(bins) - 1
        for high, (level, full) in enumerate(bins):
            if high > low:
                return
            gap = self.window - level
            while gap and low > high:
                given = bins[low][1]
                if not given:
                    low -= 1
                    continue
                piece = given.pop()
                if len(piece[2]) > gap:
                    doc, start, ids, total = piece
                    given.append([doc, start + gap, ids[gap:], total])
                    piece = [doc, start, ids[:gap], total]
                gap -= len(piece[2])
                full.append(piece)
            if not gap:
                yield full
            else:
                yield from powers_of_two(full)
                return


def powers_of_two(pieces: list) -> Iterator[list]:
    """Cut a window into sequences whose lengths are the binary digits of its length."""
    rest, at, into = sum(len(p[2]) for p in pieces), 0, []
    digits = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    room = digits[at] if digits else 0
    for doc, start, ids, total in pieces:
        while len(ids):
            cut = ids[:room]
            into.append([doc, start, cut, total])
            start, ids, room = start + len(cut), ids[len(cut) :], room - len(cut)
            if not room:
                yield into
                at, into = at + 1, []
                room = digits[at] if at < len(digits) else 0


def packed(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int, segment_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    coder, packer, rows, held, seen = codes(path), LevelPacker(window), [], 0, 0

    def put(pieces: list) -> None:
        nonlocal number, held
        at = 0
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids), total, number, at, ids.tobytes()))
            at += len(ids)
        held += at
        number += 1

    def flush() -> pa.RecordBatch:
        nonlocal rows, held
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        rows, held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 6 + [pa.binary()], strict=True)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    for batch in batches:
        for chunk in text_chunks(batch):
            ids, bounds = coder.texts(*text_buffer(chunk["text"]))
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            for doc, a, b in zip(chunk["doc_id"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                total = b - a
                for start in range(0, total - window + 1, window):
                    put([[doc, start, ids[a + start : a + start + window], total]])
                if rest := total % window:
                    done = packer.place([doc, total - rest, ids[b - rest : b].copy(), total])
                    if done:
                        put(done)
                seen += total
                if seen >= segment_tokens:
                    for pieces in packer.close():
                        put(pieces)
                    seen = 0
                if held >= 1 << 20:
                    yield flush()
    for pieces in packer.close():
        put(pieces)
    yield flush()


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens.

    ids: the piece's ids as little-endian unsigned 32-bit integers; start: the document's ids before
    it; doc_tokens: all ids of the document with the end token; offset: its place in the sequence.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: packed(batches, tokenizer_path, window, end_id, segment_tokens), PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """The contract's columns of op2."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
