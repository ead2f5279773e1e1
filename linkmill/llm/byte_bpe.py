"""Byte-level BPE encoding and decoding by a rank file (operator 10).

A rank file says which byte strings are tokens; two neighbours merge if their bytes together are a
token, the lowest rank first and the leftmost of equal ones. The ``tokenizers`` library wants a list
of merges over characters instead. So each byte is mapped to a printable character, and all splits
of each token into two tokens become merges in the order of the token's rank. That is the same but
where two overlapping places give the same token by different splits; such a word holds a stretch
with period p of 2 p + 1 bytes or more, and these words are merged by rank directly.

Decoding reverses the character table. Token bounds may fall inside a character: offsets are given
in bytes and in characters (a token covers each character of which it has a byte), and text is only
decoded where whole byte strings are put together again.

Defined results: null text is empty and has no ids; ids that are no token decode to nothing;
repeated rows and null document ids are kept; columns beside the id and the text are ignored.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmill.llm.runtime import blobs, text_buffer, text_chunks
from linkmill.llm.wordcodes import WordCodes, library_encoder


@functools.cache
def byte_chars() -> list[str]:
    """The printable character of each byte: itself if it is visible in Latin-1, else the next from 256 on."""
    seen = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    hidden = iter(range(256, 512))
    return [chr(b if b in seen else next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


#: A stretch of period p that has at least 2 p + 1 bytes.
PERIODIC = re.compile(rb"(?s)((.).*?)\1\2")
#: Longer words are merged by rank at once: looking for periods takes time by the square of the length.
LONG_WORD = 256


def merge_by_rank(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by lowest rank, leftmost first."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    after, before, part = list(range(1, n + 1)), list(range(-1, n - 1)), [word[i : i + 1] for i in range(n)]
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:
            continue
        part[i], part[j] = part[i] + part[j], b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and (r := ranks.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
    return [ranks[p] for p in part if p]


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_chars()
        self.ranks = ranks
        named = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
        merges = [(named[a], named[b]) for token in sorted(ranks, key=ranks.get) for k in range(1, len(token)) if (a := token[:k]) in ranks and (b := token[k:]) in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={named[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.library = library_encoder(self.tokenizer)
        self.codes = WordCodes(self.words)
        # The reverse: from a token's characters back to its bytes.
        back = {c: b for b, c in enumerate(chars)}
        tokens = [b""] * (max(ranks.values()) + 1)
        for name, rank in self.tokenizer.get_vocab().items():
            tokens[rank] = bytes(map(back.__getitem__, name))
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.library(words)
        odd = [k for k, w in enumerate(words) if len(w) > LONG_WORD or PERIODIC.search(w.encode())]
        if odd:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in odd:
                parts[k] = np.array(merge_by_rank(words[k].encode(), self.ranks), dtype=np.uint32)
                counts[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, counts

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all id lists in a row, and their n + 1 bounds."""
        known = ids < len(self.size)
        at = np.where(known, ids, 0).astype(np.int64)
        size = np.where(known, self.size[at], 0)
        done = np.cumsum(size)
        total = int(done[-1]) if len(done) else 0
        data = self.bytes[np.repeat(self.place[at] - (done - size), size) + np.arange(total)]
        return data, np.append(0, done)[bounds]

    def offsets(self, ids: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte end, first character and character end of each token of one text with these bytes."""
        ends = np.cumsum(self.size[ids.astype(np.int64)])
        chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        return ends, np.maximum(chars[np.minimum(ends - self.size[ids.astype(np.int64)] + 1, len(data))] - 1, 0), chars[ends]


@functools.lru_cache(maxsize=2)
def coder(path: str) -> ByteBpe:
    return ByteBpe(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = coder(path)
    for batch in batches:
        for chunk in text_chunks(batch):
            ids, bounds = bpe.codes.texts(*text_buffer(chunk["text"]))
            yield pa.RecordBatch.from_arrays([chunk["doc_id"], pa.array(np.diff(bounds), pa.int64()), blobs(ids.astype("<u4").view(np.uint8), bounds * 4)], names=["doc_id", "n_tokens", "ids"])


def decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = coder(path)
    for batch in batches:
        for part in text_chunks(batch, "ids", 1 << 22):
            column = pc.fill_null(part["ids"].cast(pa.large_binary()), b"")
            bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
            data, ends = bpe.decode(np.frombuffer(raw.tobytes(), dtype="<u4"), (bounds - bounds[0]) // 4)
            yield pa.RecordBatch.from_arrays([*(part[k] for k in range(part.num_columns)), blobs(data, ends)], names=[*part.schema.names, "decoded"])


def both(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = coder(path)
    for batch in encoded(batches, path):
        size = np.asarray(batch["n_tokens"])
        raw = np.frombuffer(batch["ids"].buffers()[2] or b"", dtype="<u4")[: int(size.sum())]
        data, ends = bpe.decode(raw, np.append(0, np.cumsum(size)))
        yield pa.RecordBatch.from_arrays([*batch.columns, blobs(data, ends)], names=[*batch.schema.names, "decoded"])


def spans(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = coder(path)
    for batch in batches:
        for part in text_chunks(batch, "ids", 1 << 20):
            rows = []
            for doc, blob in zip(part["doc_id"].to_pylist(), part["ids"].to_pylist(), strict=True):
                ids = np.frombuffer(blob or b"", dtype="<u4")
                data, _ = bpe.decode(ids, np.array([0, len(ids)]))
                rows.append((doc, *(x.tolist() for x in (ids, *bpe.offsets(ids, data)))))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "token_ids", "byte_ends", "char_starts", "char_ends"])


def encode_texts(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers in a row) of every text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: encoded(batches, ranks_path), "doc_id long, n_tokens long, ids binary")


def decode_ids(rows: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded``, the bytes of the column ``ids``; a lossless inverse of encode_texts()."""
    held = rows.drop("decoded")
    schema = T.StructType([*held.schema.fields, T.StructField("decoded", T.BinaryType())])
    return held.mapInArrow(lambda batches: decoded(batches, ranks_path), schema)


def round_trip(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_texts() and decode_ids() in one pass and one worker: doc_id, n_tokens, ids, decoded."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: both(batches, ranks_path), "doc_id long, n_tokens long, ids binary, decoded binary")


def token_offsets(rows: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, token_ids, and for each token its end in bytes and the characters it covers."""
    return rows.select("doc_id", "ids").mapInArrow(lambda batches: spans(batches, ranks_path), "doc_id long, token_ids array<long>, byte_ends array<long>, char_starts array<long>, char_ends array<long>")
