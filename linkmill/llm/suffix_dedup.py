"""Removal of passages that occur earlier in the corpus, by longest-previous-factor arrays (operator 3).

A byte goes if it lies in a ``length``-byte string that also starts earlier: in a document with a
smaller id, or earlier in the same one. In terms of the longest-previous-factor (LPF) array of the
whole corpus: position i starts a later copy if LPF[i] >= length.

One array of the whole corpus fits nowhere, so the positions are dealt out such that equal strings
meet. Every string of ``length`` bytes holds ``length - k + 1`` k-byte strings; the one with the
smallest hash (the leftmost of equal ones) is its anchor, which depends on nothing but the string.
Neighbouring positions mostly share their anchor; the stretch of text under them is a context.

1. One pass over the text makes a row per context: anchor hash, context hash, document, position. A
   worker sends each distinct context of its block once: later ones are known to be copies.
2. The rows meet by anchor. Contexts equal to an earlier one are copies throughout. Anchors with a
   single context need nothing more, and these are nearly all.
3. For anchors with several contexts the text of each distinct context is fetched and laid out in
   the order (anchor, document, position). Blocks of such text get a suffix array by prefix doubling;
   the previous and next smaller positions in suffix order give LPF, and with it the copies.
   An anchor with more than ``HOT_CONTEXTS`` contexts (the edge of a passage that very many documents
   share) is instead cut into its single strings, which are aggregated by content before they meet.
4. The copies' stretches meet their documents, which are rewritten.

Hashes are of 64 bits; a context is told apart by two of them, a hot string by its anchor and xxhash64.

Defined results: null text is empty; a row with a null id is compared with none and kept whole; rows
that repeat an id are one document (equal rows are judged alike; of different texts the one place counts once);
a text of any length is read whole, piece by piece; empty tables give no rows; other columns, whatever
their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkmill.llm.pretoken import MULTIPLIER, mixed, powers, prefix_sums, span_hashes
from linkmill.llm.runtime import staged, text_buffer, text_chunks

LENGTH = 100
#: Bytes of an anchor.
ANCHOR = 32
#: Contexts that a worker compares before it sends them.
BLOCK_CONTEXTS = 400_000
#: Bytes of context text in one suffix array; a larger group of one anchor is a block of its own.
BLOCK_BYTES = 2 << 20
HOT_CONTEXTS = 8_192
#: Positions of a single text that are looked at together. A position within a chunk has 28 bits.
PIECE = 1 << 23
_POSITION = np.uint64((1 << 28) - 1)
FOUND = "anchor long, context long, doc long, at long, n int"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def contexts_of(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, text number, first position and number of positions of each context."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int32))
    if len(data) < length:
        return none
    sums = prefix_sums(data)
    _, down = powers(len(data) + 1)
    grams = mixed((sums[anchor:] - sums[:-anchor]) * down[: len(data) - anchor + 1])
    key = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    chosen = (sliding_min(key, length - anchor + 1) & _POSITION).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(chosen)]
    whole = offsets[1:][text] - np.arange(len(chosen)) >= length
    new = np.empty(len(chosen), dtype=bool)
    new[0] = True
    new[1:] = (chosen[1:] != chosen[:-1]) | ~whole[:-1] | (text[1:] != text[:-1])
    new &= whole
    first = np.flatnonzero(new)
    if not len(first):
        return none
    ends = np.cumsum(whole)  # positions of a context follow one another, all of them whole
    count = np.diff(np.append(ends[first] - 1, ends[-1]))
    at = chosen[first]
    seen = span_hashes(sums, first, first + count - 1 + length)
    seen = mixed(seen + (at - first).astype(np.uint64) * MULTIPLIER)
    return grams[at].view(np.int64), seen.view(np.int64), text[first], first - offsets[text[first]], count.astype(np.int32)


def pieces_of(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """contexts_of() the texts. A single very long text is gone through in pieces that share ``length`` - 1 bytes:
    a context ends at the end of a piece, and equal strings have equal anchors wherever they are."""
    if len(data) <= PIECE or len(offsets) != 2:
        return contexts_of(data, offsets, length, anchor)
    found = []
    for start in range(0, len(data) - length + 1, PIECE):
        part = data[start : start + PIECE + length - 1]
        h, c, text, at, n = contexts_of(part, np.array([0, len(part)]), length, anchor)
        found.append((h, c, text, at + start, n))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def merged(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join stretches that follow one another in a document; sorted by document and position."""
    if not len(doc):
        return doc, at, n
    new = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + n[:-1]))
    first = np.flatnonzero(new)
    return doc[first], at[first], np.add.reduceat(n, first)


def anchored(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND: contexts (n > 0), and stretches that are copies within the block (n < 0)."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, size
        h, c, doc, at, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held, size = [], 0
        order = np.lexsort((at, doc, c, h))
        h, c, doc, at, n = (x[order] for x in (h, c, doc, at, n))
        new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        copy = (doc != doc[lead]) | (at != at[lead])  # a repeated id may give the same place twice: no copy
        repeat = ~new & ~copy
        d, a, m = doc[copy], at[copy], n[copy]
        order = np.lexsort((a, d))
        d, a, m = merged(d[order], a[order], m[order])
        spread = mixed(d.astype(np.uint64) * MULTIPLIER + a.astype(np.uint64)).view(np.int64)
        keep = ~copy & ~repeat
        columns = [np.concatenate(x) for x in ((h[keep], spread), (c[keep], spread), (doc[keep], d), (at[keep], a), (n[keep], -m))]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 4 + [pa.int32()], strict=True)], names=["anchor", "context", "doc", "at", "n"])

    for batch in batches:
        for chunk in text_chunks(batch):
            h, c, text, at, n = pieces_of(*text_buffer(chunk["text"]), length, anchor)
            if len(h):
                held.append((h, c, np.asarray(chunk["doc_id"])[text], at.astype(np.int64), n))
                size += len(h)
            if size >= BLOCK_CONTEXTS:
                yield flush()
    if size:
        yield flush()


def suffix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Rank of each position by its first ``length`` bytes (0 behind the end), by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    span = 8

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1])) + 1
        return rank

    rank = ranked(key)
    while span < length:
        step = min(span, length - span)
        rank = ranked(rank * (n + 2) + np.append(rank[step:], np.zeros(min(step, n), np.int64)))
        span += step
    return rank


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the previous and of the next smaller value, -1 or n if there is none, by pointer jumping."""
    n = len(values)
    out = []
    for row in (values, values[::-1]):
        at = np.arange(n) - 1
        open_ = np.flatnonzero((at >= 0) & (row[np.maximum(at, 0)] >= row))
        while len(open_):
            at[open_] = at[at[open_]]
            open_ = open_[(at[open_] >= 0) & (row[np.maximum(at[open_], 0)] >= row[open_])]
        out.append(at)
    return out[0], n - 1 - out[1][::-1]


def copies(text: np.ndarray, positions: np.ndarray, length: int) -> np.ndarray:
    """Which of the ascending positions have LPF >= length, counting only these positions.

    Suffixes whose first ``length`` bytes agree stand together in suffix order with common prefixes
    of ``length`` or more; the earlier match with the longest common prefix is the nearest smaller
    position before or behind in that order.
    """
    if not len(positions):
        return np.zeros(0, dtype=bool)
    rank = suffix_ranks(text, length)[positions]
    order = np.argsort(rank, kind="stable")
    group = rank[order]
    before, behind = nearest_smaller(order)
    same = np.zeros(len(order), dtype=bool)
    for near in (before, behind):
        has = (near >= 0) & (near < len(order))
        same |= has & (group[np.where(has, near, 0)] == group)
    out = np.zeros(len(order), dtype=bool)
    out[order] = same
    return out


def fetched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The text of each wanted context. In: doc, text, want (a list of anchor, at, n)."""
    for batch in batches:
        for chunk in text_chunks(batch):
            want = chunk["want"]
            flat = want.flatten()
            row = np.repeat(np.arange(len(want)), np.diff(np.asarray(want.offsets)))
            data, offsets = text_buffer(chunk["text"])
            at, n = np.asarray(flat.field("at")), np.asarray(flat.field("n"))
            start = offsets[row] + at
            stop = start + n - 1 + length
            there = stop <= offsets[row + 1]  # else another row with the same id has it
            if not there.all():
                flat, row, at, n, start, stop = flat.filter(pa.array(there)), row[there], at[there], n[there], start[there], stop[there]
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([flat.field("anchor"), pa.array(np.asarray(chunk["doc"])[row], pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int32()), pa.array(texts, pa.binary())], names=["anchor", "doc", "at", "n", "text"])


def resolved(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Stretches of copies among contexts that come sorted by anchor, document and position."""
    rows: list[pa.RecordBatch] = []
    size = 0

    def block(part: pa.Table) -> pa.RecordBatch:
        key = [np.asarray(part[c]) for c in ("anchor", "doc", "at")]
        new = np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0))
        part = part.filter(pa.array(new))  # a place that two rows with one id give counts once
        column = part["text"].combine_chunks()
        text, offsets = text_buffer(column)
        n, doc, at = (np.asarray(part[c]).astype(np.int64) for c in ("n", "doc", "at"))
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        hit = copies(text, offsets[row] + step, length)
        d, a, m = merged(doc[row][hit], (at[row] + step)[hit], np.ones(int(hit.sum()), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int64()), pa.array(m, pa.int64())], names=["doc", "at", "n"])

    def drain(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal rows, size
        part = pa.Table.from_batches(rows)
        keys = np.asarray(part["anchor"])
        stop = len(keys) if final else len(keys) - int((keys == keys[-1]).sum())
        if stop:
            yield block(part.slice(0, stop))
        rows = part.slice(stop).to_batches()
        size = sum(pc.sum(pc.binary_length(b["text"])).as_py() or 0 for b in rows)

    seen = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows.append(batch)
        seen = pc.sum(pc.binary_length(batch["text"])).as_py() or 0
        size += seen
        if size >= BLOCK_BYTES:
            yield from drain(False)
    if rows and sum(b.num_rows for b in rows):
        yield from drain(True)


def _contexts(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "at", "n")).alias("want"))
    rows = texts.join(lists.hint("shuffle_hash"), texts["doc_id"] == lists["doc"], "inner").select("doc", "text", "want")
    return rows.mapInArrow(lambda batches: fetched(batches, length), "anchor long, doc long, at long, n int, text binary")


def copied_stretches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """doc, and stretches: a list of (at, n), the positions at which later copies start."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    usable = texts.where(F.col("doc_id").isNotNull())  # the same rows that remove_copies() deals out: dealt once
    rows = usable.where(F.octet_length("text") >= length).mapInArrow(lambda batches: anchored(batches, length, anchor), FOUND)
    by_context = Window.partitionBy("anchor", "context").orderBy("doc", "at")
    met = rows.repartition("anchor").withColumn("lead", (F.rank().over(by_context) == 1) & (F.col("n") > 0))
    met = met.withColumn("kinds", F.sum(F.when(F.col("lead"), 1).otherwise(0)).over(Window.partitionBy("anchor")))
    found = staged(met.where(~F.col("lead") | (F.col("kinds") > 1)).drop("context"), "copied")
    known = found.where(~F.col("lead")).select("doc", "at", F.abs("n").cast("long").alias("n"))
    open_ = found.where("lead").distinct()
    few = _contexts(open_.where(F.col("kinds") <= hot_contexts), usable, length)
    few = few.repartition("anchor").sortWithinPartitions("anchor", "doc", "at").mapInArrow(lambda batches: resolved(batches, length), "doc long, at long, n long")
    single = _contexts(open_.where(F.col("kinds") > hot_contexts), usable, length)
    single = single.select("anchor", "doc", "at", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    single = single.select("anchor", F.xxhash64(F.expr(f"substring(text, k + 1, {length})")).alias("string"), "doc", (F.col("at") + F.col("k")).alias("at"))
    first = single.groupBy("anchor", "string").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    many = single.join(first, ["anchor", "string"]).where((F.col("first.doc") != F.col("doc")) | (F.col("first.at") != F.col("at"))).select("doc", "at", F.lit(1).cast("long").alias("n"))
    return known.unionByName(few).unionByName(many).groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("stretches"))


def rewritten(batches: Iterator[pa.RecordBatch], length: int, characters: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch):
            data, offsets = text_buffer(chunk["text"])
            lists = pc.fill_null(chunk["stretches"].is_valid(), False)
            cover = np.zeros(len(data) + 1, dtype=np.int32)
            if pc.any(lists).as_py():
                held = chunk["stretches"]
                flat = held.flatten()
                sizes = np.asarray(pc.fill_null(pc.list_value_length(held), 0)).astype(np.int64)
                row = np.repeat(np.arange(len(held)), sizes)
                start = np.minimum(offsets[row] + np.asarray(flat.field("at")), offsets[row + 1])
                stop = np.minimum(start + np.asarray(flat.field("n")) - 1 + length, offsets[row + 1])
                np.add.at(cover, start, 1)
                np.add.at(cover, stop, -1)
            gone = np.cumsum(cover[:-1]) > 0
            if characters and len(data) and gone.any():  # a character stays whole if one of its bytes stays
                head = np.flatnonzero((data & 0xC0) != 0x80)
                gone = np.repeat(np.logical_and.reduceat(gone, head), np.diff(np.append(head, len(data))))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            # a run of removed bytes never crosses from one text to the next: cut it at the bounds
            inner = offsets[1:-1]
            inner = inner[(inner > 0) & (inner < len(data))]
            cut = inner[gone[inner] & gone[inner - 1]] if len(data) else inner
            cut = np.unique(cut)
            starts, ends = np.sort(np.concatenate([edge[::2], cut])), np.sort(np.concatenate([edge[1::2], cut]))
            text = np.searchsorted(offsets, starts, side="right") - 1
            bounds = np.append(0, np.cumsum(np.bincount(text, minlength=chunk.num_rows))).astype(np.int32)
            keep = data[~gone]
            kept = np.append(0, np.cumsum(~gone))[offsets].astype(np.int32)
            base = offsets[text]
            yield pa.RecordBatch.from_arrays(
                [
                    chunk["row"],
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(starts - base, pa.int64())),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(ends - base, pa.int64())),
                    pa.Array.from_buffers(pa.binary(), chunk.num_rows, [None, pa.py_buffer(kept), pa.py_buffer(np.ascontiguousarray(keep))]),
                ],
                names=["row", "n_bytes", "starts", "ends", "kept"],
            )


def remove_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot_contexts: int = HOT_CONTEXTS, characters: bool = False) -> DataFrame:
    """row (a struct of the columns of ``docs`` but the text), n_bytes, starts and ends of the removed
    runs, and kept, the remaining bytes. ``characters``: characters that are removed in part stay."""
    spans = copied_stretches(docs, id_col=id_col, text_col=text_col, length=length, anchor=anchor, hot_contexts=hot_contexts)
    others = [c for c in docs.columns if c not in (text_col, id_col)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*others).alias("others")] if others else []))
    named = F.struct(F.col("doc_id").alias(id_col), *(F.col(f"others.`{c}`").alias(c) for c in others)).alias("row")
    known = rows.where(F.col("doc_id").isNotNull())
    rows = (
        known.join(spans.hint("shuffle_hash"), known["doc_id"] == spans["doc"], "left")
        .select(named, "text", "stretches")
        .unionByName(rows.where(F.col("doc_id").isNull()).select(named, "text", F.lit(None).cast("array<struct<at:bigint,n:bigint>>").alias("stretches")))
    )
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: rewritten(batches, length, characters), f"row {kind}, n_bytes long, starts array<long>, ends array<long>, kept binary")


def digests(rows: DataFrame) -> DataFrame:
    """The contract's columns of op3."""
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
