"""Exact Jaccard self-join of word n-gram sets that skips by set relations (operator 9).

A document's set is its distinct n-word shingles (64-bit hashes). Equal sets are one node, named by a
64-bit signature, so copies are never compared. Nodes are compared by prefix filtering: in one global
order of the shingles, two sets with similarity t share one of the first |x| - ceil(t |x|) + 1. The
order is by hash, but shingles in many sets come last; which these are is counted over all documents.

* Index-level skipping: a shingle's list is sorted by set size and cut into blocks; a pair of blocks
  whose sizes, or whose places of the shingle in the sets, rule out the overlap is skipped whole. A
  pair is made from the first shingle that both have: what lies before it in either is not shared.
* Answer-level skipping: each set is first compared with the leader of each of its lists, the set in
  which the shingle comes first. What links is one component, with the exact difference of each member
  from one head. From then on only sets of different components meet; what one member's sketch says about
  a set holds for all members, less what they differ from that member, and settles most of them at once.
  For what is left open the overlaps of a set with all members are derived from its overlap with the head
  by the shingles in which the members differ from it; a set asks a component once, not each member.
* A node has a sketch: the parity of its shingles in about as many bits as it has shingles. Two sketches
  differ in no more bits than the sets in shingles, so a pair whose sketches differ too much is none.

No pair is dropped: what the bounds leave open is verified on the whole sets. All pairs of a group of
similar sets are never made, only links that connect it. Rows of a long list are dealt out by pairs of
buckets, so that no task holds more than about two buckets of a list at once.

Defined results: null text, text without words: empty set, linked with nothing, its own component;
a text with fewer than n words is one shingle; a null id is kept as a row of its own with a null
component; rows that repeat an id are one document, whose texts are in one component but for empty ones;
a text of any length is one set, held whole by one worker; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmill.llm.components import component_labels
from linkmill.llm.pretoken import mixed, prefix_sums, span_hashes
from linkmill.llm.runtime import blobs, drop_staged, staged, text_buffer, text_chunks

WORDS = 4
PERCENT = 85
#: A shingle in this many sets, or in this share of all of them, comes last in the order.
HOT, HOT_SHARE = 8, 32_000
#: Rows of lists that a worker holds at once, as far as lists are shorter.
PART = 100_000
#: Members of a block of a list, and lists so short that they are gone through many at a time.
BLOCK, SHORT = 256, 32
#: Rows of a list that are one bucket.
BUCKET = 4096
#: Bytes of sketches that are compared at once.
SKETCHES = 32 << 20
#: Nodes whose documents are found by a broadcast of their ids (16 bytes each); beyond it by a shuffle.
BROADCAST_NODES = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending in each, and the texts' n + 1 bounds."""
    n, texts = len(data), len(offsets) - 1
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    dark = ~((data == 32) | ((data >= 9) & (data <= 13)))
    head = np.zeros(n + 1, dtype=bool)
    head[offsets] = True
    start, stop = dark.copy(), dark.copy()
    start[1:] &= ~dark[:-1] | head[1:n]
    stop[:-1] &= ~dark[1:] | head[1:n]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    word = span_hashes(prefix_sums(data), start, stop)
    count = np.diff(np.searchsorted(start, offsets))
    text = np.repeat(np.arange(texts), count)
    first = np.cumsum(count) - count
    span = np.minimum(words, count)[text]  # a short text is one shingle
    begin = np.arange(len(word)) - first[text] + span <= count[text]
    short = (count < words)[text]
    begin &= ~short | (np.arange(len(word)) == first[text])
    at = np.flatnonzero(begin)
    hashed = np.zeros(len(at), dtype=np.uint64)
    padded = np.append(word, np.zeros(words, np.uint64))
    for k in range(words):
        inside = k < span[at]
        hashed = np.where(inside, mixed(hashed * _MIX + padded[at + k] + np.uint64(k + 1)), hashed)
    bounds = np.append(0, np.cumsum(np.bincount(text[at], minlength=texts)))
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashed[s:e].sort()
    new = np.ones(len(hashed), dtype=bool)
    new[1:] = hashed[1:] != hashed[:-1]
    new[bounds[:-1][bounds[:-1] < len(hashed)]] = True
    return hashed[new], np.append(0, np.cumsum(new))[bounds]


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty one."""
    sums = np.append(np.uint64(0), np.cumsum(mixed(sets ^ _MIX), dtype=np.uint64))
    out = mixed(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * _MIX)
    return np.where(np.diff(bounds) > 0, out, np.uint64(0)).view(np.int64)


def sketch_words(size: np.ndarray) -> np.ndarray:
    """64-bit words of a sketch: a power of two with at least as many bits as the set has shingles."""
    return (2 ** np.ceil(np.log2(np.maximum(size, 64) / 64))).astype(np.int64)


def sketches(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parity of each set's shingles by their lowest bits, as bytes in a row, and the n + 1 bounds."""
    width = sketch_words(np.diff(bounds)) * 64
    ends = np.cumsum(width)
    bit = np.repeat(ends - width, np.diff(bounds)) + (sets & np.repeat((width - 1).astype(np.uint64), np.diff(bounds))).astype(np.int64)
    odd = (np.bincount(bit, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(bool)
    return np.packbits(odd, bitorder="little"), np.append(0, ends) // 8


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    return size - (size * percent + 99) // 100 + 1


def needed(x, y, percent: int):
    """The overlap from which 100 * overlap >= percent * (x + y - overlap)."""
    return (percent * (x + y) + 99 + percent) // (100 + percent)


def _firsts(names: np.ndarray) -> np.ndarray:
    """Which rows hold a name for the first time."""
    out = np.zeros(len(names), bool)
    out[np.unique(names, return_index=True)[1]] = True
    return out


def _named(batches: Iterator[pa.RecordBatch], words: int, share: float) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, node; for one row of each node of a chunk also its sketch and the halves of the
    hashes of its lowest shingles, in which frequent ones are looked for."""
    for batch in batches:
        for chunk in text_chunks(batch):
            sets, bounds = shingles(*text_buffer(chunk["text"]), words)
            size, node = np.diff(bounds), signatures(sets, bounds)
            one = _firsts(node) & (size > 0)
            use = np.repeat(one, size)
            drawn, drawn_bounds = sketches(sets[use], np.append(0, np.cumsum(size[one])))
            low = (np.arange(len(sets)) - np.repeat(bounds[:-1], size) < np.ceil(np.repeat(size, size) * share)) & use
            low_bounds = np.append(0, np.cumsum(low))[bounds] * 4
            at = np.append(0, np.cumsum(one))
            yield pa.RecordBatch.from_arrays(
                [chunk["doc_id"], pa.array(size, pa.int64()), pa.array(node, pa.int64()), blobs(drawn, drawn_bounds[at]), blobs((sets[low] >> np.uint64(32)).astype(np.uint32).view(np.uint8), low_bounds)],
                names=["doc_id", "n_shingles", "node", "sketch", "low"],
            )


def _scouted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The halves of hashes of many sets, counted."""
    for batch in batches:
        data, _ = text_buffer(batch["low"])
        half, times = np.unique(np.frombuffer(data.tobytes(), np.uint32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(half.view(np.int32), pa.int32()), pa.array(times, pa.int64())], names=["half", "times"])


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, percent: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """token, node, size and place of each set's prefix; a worker sends a node once per chunk."""
    for batch in batches:
        for chunk in text_chunks(batch):
            sets, bounds = shingles(*text_buffer(chunk["text"]), words)
            size, node = np.diff(bounds), signatures(sets, bounds)
            text = np.repeat(np.arange(len(size)), size)
            late = np.zeros(len(sets), bool)
            if len(hot) and len(sets):
                half = (sets >> np.uint64(32)).astype(np.uint32)
                late = hot[np.minimum(np.searchsorted(hot, half), len(hot) - 1)] == half
            # Shingles ascend in each set; frequent ones follow the others in the same order.
            before = np.append(0, np.cumsum(~late))
            early = before[:-1] - before[bounds[:-1]][text]
            place = np.where(late, np.arange(len(sets)) - bounds[:-1][text] - early + np.diff(before[bounds])[text], early)
            keep = (place < prefix_length(size, percent)[text]) & _firsts(node)[text]
            row = text[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets[keep].view(np.int64), pa.int64()), pa.array(node[row], pa.int64()), pa.array(size[row], pa.int32()), pa.array(place[keep], pa.int32())],
                names=["token", "node", "size", "place"],
            )


def _fits(size: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """May the sets of rows i and j (not smaller) reach the overlap from this shingle on, as the first that both have?"""
    return (100 * size[i] >= percent * size[j]) & (np.minimum(size[i] - place[i], size[j] - place[j]) >= needed(size[i], size[j], percent))


def list_pairs(size: np.ndarray, place: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one list (ascending sizes) that the bounds allow, block by block."""
    n, rest = len(size), size - place
    for a in range(0, n, BLOCK):
        a2 = min(a + BLOCK, n)
        for b in range(a, n, BLOCK):
            b2 = min(b + BLOCK, n)
            if 100 * size[a2 - 1] < percent * size[b]:
                break  # sizes only grow
            if min(rest[a:a2].max(), rest[b:b2].max()) < needed(size[a], size[b], percent):
                continue
            x, y = size[a:a2, None], size[None, b:b2]
            ok = (100 * x >= percent * y) & (np.minimum(rest[a:a2, None], rest[None, b:b2]) >= needed(x, y, percent))
            if a == b:
                ok &= np.arange(a, a2)[:, None] < np.arange(b, b2)[None, :]
            i, j = np.nonzero(ok)
            if len(i):
                yield i + a, j + b


def all_pairs(edge: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for many lists, which ``edge`` bounds: in short ones the k-th next rows of all lists at once."""
    count = np.diff(edge)
    end = np.repeat(edge[1:], count)
    at = np.flatnonzero(np.repeat(count <= SHORT, count))
    for k in range(1, SHORT):
        at = at[at + k < end[at]]
        if not len(at):
            break
        ok = _fits(size, place, at, at + k, percent)
        if ok.any():
            yield at[ok], at[ok] + k
    for s, e in zip(edge[:-1][count > SHORT].tolist(), edge[1:][count > SHORT].tolist(), strict=True):
        for i, j in list_pairs(size[s:e], place[s:e], percent):
            yield i + s, j + s


def _whole_lists(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole lists of rows sorted by ``keys``, and the bounds of the lists."""

    def edges(table: pa.Table) -> np.ndarray:
        new = np.ones(table.num_rows, bool)
        new[1:] = False
        for key in keys:
            column = np.asarray(table[key])
            new[1:] |= column[1:] != column[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    held: list[pa.RecordBatch] = []
    size, limit = 0, PART
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= limit:
            table = pa.Table.from_batches(held)
            edge = edges(table)
            if len(edge) > 2:
                yield table.slice(0, edge[-2]), edge[:-1]
            held = table.slice(edge[-2]).combine_chunks().to_batches()
            size = table.num_rows - int(edge[-2])
            limit = max(PART, 2 * size)
    if size:
        table = pa.Table.from_batches(held)
        yield table, edges(table)


def _lists(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, size, place and node that the bounds let link with another row of their list,
    the list's leader and the number of such rows."""
    for table, edge in _whole_lists(batches, ["token"]):
        token, node, size, place = (np.asarray(table[c]).astype(np.int64) for c in ("token", "node", "size", "place"))
        new = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))  # copies in other chunks
        edge = np.append(0, np.cumsum(new))[edge]
        token, node, size, place = token[new], node[new], size[new], place[new]
        of = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        linked = (np.diff(edge) > BUCKET)[of]  # in a long list nearly every row has a partner, so all are kept
        rest = np.flatnonzero(~linked)
        for i, j in all_pairs(np.append(np.flatnonzero(np.diff(of[rest], prepend=-1)), len(rest)), size[rest], place[rest], percent):
            linked[rest[i]] = linked[rest[j]] = True
        many = np.bincount(of[linked], minlength=len(edge) - 1)
        # The leader has the lowest place, among equals the largest set; the part has fewer than 2 ** 31 rows.
        key = np.where(linked, place, np.int64(1) << 31) << 31 | (len(token) - 1 - np.arange(len(token)))
        lead = len(token) - 1 - (np.minimum.reduceat(key, edge[:-1]) & ((1 << 31) - 1)) if len(token) else np.zeros(0, int)
        lead = lead[of[linked]]
        columns = [token[linked], node[linked], size[linked], place[linked], node[lead], size[lead], many[of[linked]]]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["token", "node", "size", "place", "leader", "leader_size", "many"])


class Sketches:
    """Sketches of a column of blobs."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        data, offsets = text_buffer(column)
        self.bits = np.frombuffer(data.tobytes(), np.uint64)
        self.start, self.width = offsets[:-1] // 8, np.diff(offsets) // 8

    def folded(self, rows: np.ndarray, width: int, times: int) -> np.ndarray:
        """Sketches of ``times`` times ``width`` words, folded to ``width`` words: parities add up."""
        found = self.bits[self.start[rows][:, None] + np.arange(width * times)]
        return np.bitwise_xor.reduce(found.reshape(len(rows), times, width), axis=1) if times > 1 else found

    def differing(self, i: np.ndarray, other: Sketches, j: np.ndarray) -> np.ndarray:
        """Bits in which sketches i differ from the other's sketches j: no more than the sets differ in."""
        out = np.zeros(len(i), np.int64)
        wide_i, wide_j = self.width[i], other.width[j]
        kind = wide_i << 32 | wide_j
        for k in np.unique(kind).tolist():
            a, b = k >> 32, k & 0xFFFFFFFF
            width, rows = min(a, b), np.flatnonzero(kind == k)
            step = max(1, SKETCHES // (8 * (a + b)))
            for s in range(0, len(rows), step):
                r = rows[s : s + step]
                x, y = self.folded(i[r], width, a // width), other.folded(j[r], width, b // width)
                out[r] = np.bitwise_count(x ^ y).sum(axis=1)
        return out


def most_different(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Shingles in which sets of x and y shingles may differ at most."""
    return x + y - 2 * needed(x, y, percent)


def _sketched(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs x, y that their sketches leave open."""
    for batch in batches:
        nx, ny = (np.asarray(batch[c]).astype(np.int64) for c in ("nx", "ny"))
        at = np.arange(batch.num_rows)
        ok = Sketches(batch["sketch_x"]).differing(at, Sketches(batch["sketch_y"]), at) <= most_different(nx, ny, percent)
        yield batch.filter(pa.array(ok)).select(["x", "y", "nx", "ny"])


def open_pairs(edge: np.ndarray, size: np.ndarray, place: np.ndarray, side: np.ndarray, label: np.ndarray, off: np.ndarray, drawn: Sketches, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different components, and of different sides where a list has two, that all bounds leave open.

    ``off``: in how many shingles a row's set differs from the head of its component, 0 without one.
    """
    # The representative of a component in a list is its row that differs least from the head.
    of = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    order = np.lexsort((off, label, of))
    first = np.append(True, (of[order][1:] != of[order][:-1]) | (label[order][1:] != label[order][:-1]))
    stands = np.empty(len(size), np.int64)
    stands[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    away = np.where(stands == np.arange(len(size)), 0, off + off[stands])  # by how much a row may differ from it
    for i, j in all_pairs(edge, size, place, percent):
        ok = (label[i] != label[j]) & ((side[i] != side[j]) | (side[i] == 2))
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        allowed = most_different(size[i], size[j], percent)
        # What the representatives differ in, less what each row may differ from its own.
        both, at = np.unique(stands[i] * len(size) + stands[j], return_inverse=True)
        apart = drawn.differing(both // len(size), drawn, both % len(size))[at]
        ok = apart - away[i] - away[j] <= allowed
        i, j, allowed = i[ok], j[ok], allowed[ok]
        ok = drawn.differing(i, drawn, j) <= allowed
        if ok.any():
            yield i[ok], j[ok]


def _crossed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """node, head: sets, and the components of which a set may link with them by all bounds; from rows sorted by
    token, part and size. Of two components the larger one is the one named; among equals that of the smaller head."""
    for table, edge in _whole_lists(batches, ["token", "part"]):
        node, size, place, side, label, off, many = (np.asarray(table[c]).astype(np.int64) for c in ("node", "size", "place", "side", "label", "off", "members"))
        found = []
        for i, j in open_pairs(edge, size, place, side, label, off, Sketches(table["sketch"]), percent):
            turn = (many[i] > many[j]) | ((many[i] == many[j]) & (label[i] < label[j]))
            one = np.unique(np.stack([node[np.where(turn, j, i)], label[np.where(turn, i, j)]], axis=1), axis=0)
            found.append(one)
        if found:
            one = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(one[:, 0], pa.int64()), pa.array(one[:, 1], pa.int64())], names=["node", "head"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """node, members of the texts whose set is the node; another text of the same id is none."""
    for batch in batches:
        for chunk in text_chunks(batch):
            sets, bounds = shingles(*text_buffer(chunk["text"]), words)
            right = signatures(sets, bounds) == np.asarray(chunk["node"])
            yield pa.RecordBatch.from_arrays([chunk["node"], blobs(sets.view(np.uint8), bounds * 8)], names=["node", "members"]).filter(pa.array(right))


def _tokens(column: pa.Array) -> list[np.ndarray]:
    data, bounds = text_buffer(column)
    tokens = np.frombuffer(data.tobytes(), np.uint64)
    return [tokens[s:e] for s, e in zip((bounds[:-1] // 8).tolist(), (bounds[1:] // 8).tolist(), strict=True)]


def _within(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which of ``few`` are among ``many``; both ascend."""
    if not len(many):
        return np.zeros(len(few), bool)
    return many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few


def links_at(both, x, y, percent: int):
    return 100 * both >= percent * (x + y - both)


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """u, v of the pairs that link."""
    for batch in batches:
        ok = []
        for a, b in zip(_tokens(batch["members_x"]), _tokens(batch["members_y"]), strict=True):
            both = int(_within(a, b).sum() if len(a) < len(b) else _within(b, a).sum())
            ok.append(links_at(both, len(a), len(b), percent))
        yield pa.RecordBatch.from_arrays([batch["x"], batch["y"]], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, head, size and what the node's set has more and less than the head's."""
    for batch in batches:
        more, less, size = [], [], []
        for h, y in zip(_tokens(batch["members_x"]), _tokens(batch["members_y"]), strict=True):
            more.append(y[~_within(y, h)].tobytes())
            less.append(h[~_within(h, y)].tobytes())
            size.append(len(y))
        off = [(len(a) + len(b)) // 8 for a, b in zip(more, less, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["y"], batch["x"], pa.array(size, pa.int32()), pa.array(off, pa.int32()), pa.array(more, pa.binary()), pa.array(less, pa.binary())], names=["node", "head", "size", "off", "more", "less"])


class Component:
    """A head's set and what members differ from it in, by which the overlaps of a set with all of them are
    derived from its overlap with the head."""

    def __init__(self, head: np.ndarray):
        self.head, self.size, self.more, self.less = head, [len(head)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        self.ready = False

    def add(self, size: int, more: np.ndarray, less: np.ndarray) -> None:
        self.size.append(size)
        self.more.append(more)
        self.less.append(less)

    def links(self, x: np.ndarray, percent: int) -> bool:
        """Does the set link with the head or a member?"""
        if not self.ready:
            sizes = [len(t) for t in self.more + self.less]
            member, sign = np.repeat(np.tile(np.arange(len(self.size)), 2), sizes), np.repeat([1, -1], [sum(sizes[: len(self.size)]), sum(sizes[len(self.size) :])])
            token = np.concatenate(self.more + self.less)
            order = np.argsort(token, kind="stable")
            self.token, self.member, self.sign = token[order], member[order], sign[order]
            self.sizes, self.ready = np.array(self.size), True
        both = np.full(len(self.sizes), int(_within(x, self.head).sum()))
        if len(self.token):
            hit = _within(self.token, x)
            both = both + np.bincount(self.member[hit], weights=self.sign[hit], minlength=len(self.sizes)).astype(np.int64)
        return bool(links_at(both, len(x), self.sizes, percent).any())


def _checked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """u, v: sets that link with a component, and its head. Rows sorted by head, part and kind: 0 the head, 1 members, 2 sets."""
    key, component = None, None
    for batch in batches:
        heads, parts, kinds, nodes, sizes = (np.asarray(batch[c]).tolist() for c in ("head", "part", "kind", "node", "size"))
        found = []
        for head, part, kind, node, size, more, less in zip(heads, parts, kinds, nodes, sizes, _tokens(batch["more"]), _tokens(batch["less"]), strict=True):
            if key != (head, part):
                key, component = (head, part), None
            if kind == 0:
                component = Component(more)
            elif kind == 1:
                component.add(size, more, less)
            elif component.links(more, percent):
                found.append((node, head))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])


PAIR = "x long, y long, nx int, ny int"


class JaccardJoin:
    """One join. texts: doc_id, text."""

    def __init__(self, texts: DataFrame, words: int, percent: int):
        self.texts, self.words, self.percent = texts.where("doc_id is not null"), words, percent
        share = min(1.0, (100 - percent) / 100 + 0.1)  # a little more than the prefixes
        self.named = staged(texts.mapInArrow(lambda b: _named(b, words, share), "doc_id long, n_shingles long, node long, sketch binary, low binary"), "sets")

    def frequent(self) -> np.ndarray:
        """Halves of the hashes of frequent shingles, ascending. By HOT_SHARE there are at most a few thousand
        times the mean set size of them, 4 bytes each, however many documents there are."""
        least = max(HOT, self.named.count() // HOT_SHARE)
        found = self.named.select("low").where("low <> X''").mapInArrow(_scouted, "half int, times long")
        found = found.groupBy("half").agg(F.sum("times").alias("times")).where(F.col("times") >= least).select("half")
        return np.sort(np.asarray(found.toArrow()["half"]).astype(np.int32).view(np.uint32))

    def lists(self) -> DataFrame:
        """token, node, size, place, leader, leader_size and many of what may link with another row of its list."""
        words, percent = self.words, self.percent
        sent = self.texts.sparkSession.sparkContext.broadcast(self.frequent())
        rows = self.texts.mapInArrow(lambda b: _prefixes(b, words, percent, sent.value), "token long, node long, size int, place int")
        rows = rows.repartition("token").sortWithinPartitions("token", "size", "place", "node")
        return staged(rows.mapInArrow(lambda b: _lists(b, percent), "token long, node long, size int, place int, leader long, leader_size int, many long"), "lists")

    def sketches_of(self, nodes: DataFrame) -> DataFrame:
        """node, sketch of all nodes in ``nodes``."""
        rows = self.named.where("sketch <> X''").select("node", "sketch").join(nodes, "node", "left_semi")
        return staged(rows.dropDuplicates(["node"]), "sketches")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node, members of all nodes in ``nodes``."""
        ids = self.named.select("doc_id", "node").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        ids = staged(ids.where("doc_id is not null"), "nodes")
        small = ids.count() <= BROADCAST_NODES
        words = self.words
        rows = self.texts.join(F.broadcast(ids) if small else ids, "doc_id").select("node", "text").mapInArrow(lambda b: _sets(b, words), "node long, members binary")
        out = staged(rows.dropDuplicates(["node"]), "members")
        drop_staged(ids)
        return out

    def paired(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """x, y and the members of both."""
        for s in ("x", "y"):
            pairs = pairs.join(sets.select(F.col("node").alias(s), F.col("members").alias(f"members_{s}")), s)
        return pairs.select("x", "y", "members_x", "members_y")

    def leading(self, lists: DataFrame, drawn: DataFrame) -> DataFrame:
        """Pairs of a leader and a row of its list that the sizes and the sketches leave open."""
        percent = self.percent
        pairs = lists.where("node <> leader").select(F.col("leader").alias("x"), F.col("node").alias("y"), F.col("leader_size").alias("nx"), F.col("size").alias("ny")).distinct()
        pairs = pairs.where(F.lit(100) * F.least("nx", "ny") >= F.lit(percent) * F.greatest("nx", "ny"))
        for s in ("x", "y"):
            pairs = pairs.join(drawn.select(F.col("node").alias(s), F.col("sketch").alias(f"sketch_{s}")), s)
        return staged(pairs.mapInArrow(lambda b: _sketched(b, percent), PAIR), "led")

    def crossing(self, lists: DataFrame, drawn: DataFrame, member: DataFrame) -> DataFrame:
        """node, head: what is left open between sets and components. member: node, head, off."""
        percent = self.percent
        heads = member.groupBy("head").agg(F.count(F.lit(1)).alias("members"))
        known = member.join(heads, "head").select("node", "head", "off", "members").unionByName(heads.select(F.col("head").alias("node"), "head", F.lit(0).alias("off"), "members"))
        rows = lists.join(known, "node", "left").join(drawn, "node")
        rows = rows.withColumns({"label": F.coalesce("head", "node"), "off": F.coalesce("off", F.lit(0)), "members": F.coalesce("members", F.lit(0))})
        # A list of several buckets is dealt out by pairs of them: a bucket with itself has one side, 2.
        rows = rows.withColumn("buckets", F.ceil(F.col("many") / BUCKET).cast("int"))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("node"), F.col("buckets")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
        rows = rows.withColumn("part", F.least("bucket", "other") * F.col("buckets") + F.greatest("bucket", "other"))
        rows = rows.withColumn("side", F.when(F.col("bucket") == F.col("other"), 2).when(F.col("bucket") < F.col("other"), 0).otherwise(1))
        rows = rows.select("token", "part", "node", "size", "place", "side", "label", "off", "members", "sketch")
        rows = rows.repartition("token", "part").sortWithinPartitions("token", "part", "size", "node")
        return staged(rows.mapInArrow(lambda b: _crossed(b, percent), "node long, head long").distinct(), "crossed")

    def checked(self, open_: DataFrame, member: DataFrame, sets: DataFrame) -> DataFrame:
        """u, v: the sets of ``open_`` that link with their component, and its head. Sets and members of a component
        are dealt out by buckets of both."""
        percent = self.percent
        heads = open_.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("gx"))
        counted = member.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("gm"))
        heads = staged(heads.join(counted, "head", "left").na.fill(1, ["gm"]), "heads")

        def all_of(n: str):
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        def rows(df: DataFrame, kind: int, more: str, less) -> DataFrame:
            part = (F.col("m") * F.col("gx") + F.col("x")).alias("part")
            return df.select("head", part, F.lit(kind).alias("kind"), "node", "size", F.col(more).alias("more"), less.alias("less"))

        def bucket(n: str):
            return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")

        none, few = F.lit(b""), F.lit(0).alias("size")
        first = heads.join(sets.withColumnRenamed("node", "head"), "head").withColumn("m", all_of("gm")).withColumn("x", all_of("gx")).select("*", F.col("head").alias("node"), few)
        following = member.join(heads, "head").withColumn("m", bucket("gm")).withColumn("x", all_of("gx"))
        asked = open_.join(heads, "head").join(sets, "node").withColumn("x", bucket("gx")).withColumn("m", all_of("gm")).select("*", few)
        dealt = rows(first, 0, "members", none).unionByName(rows(following, 1, "more", F.col("less"))).unionByName(rows(asked, 2, "members", none))
        dealt = dealt.repartition("head", "part").sortWithinPartitions("head", "part", "kind", "node")
        out = staged(dealt.mapInArrow(lambda b: _checked(b, percent), "u long, v long"), "links")
        drop_staged(heads)
        return out

    def repeated(self) -> DataFrame:
        """u, v: the nodes of ids that have several texts."""
        rows = self.named.select("doc_id", "node").where("node <> 0 and doc_id is not null")
        several = rows.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v <> last").drop("last")
        return rows.join(several, "doc_id").where("node <> v").select(F.col("node").alias("u"), "v")

    def links(self) -> DataFrame:
        """node, label: the components of all links, for the nodes that are not their own label."""
        percent = self.percent
        lists = self.lists()
        drawn = self.sketches_of(lists.select("node"))
        led = self.leading(lists, drawn)
        sets = self.sets(led.select(F.explode(F.array("x", "y")).alias("node")).distinct())
        first = staged(self.paired(led, sets).mapInArrow(lambda b: _linked(b, percent), "u long, v long"), "links")
        labels = staged(component_labels(first), "labels")
        member = self.paired(labels.select(F.col("label").alias("x"), F.col("node").alias("y")), sets)
        member = staged(member.mapInArrow(_member, "node long, head long, size int, off int, more binary, less binary"), "member")
        open_ = self.crossing(lists, drawn, member.select("node", "head", "off"))
        open_sets = self.sets(open_.select(F.explode(F.array("node", "head")).alias("node")).distinct())
        more = self.checked(open_, member, open_sets)
        out = staged(component_labels(first.unionByName(more).unionByName(self.repeated())), "labels")
        for done in (lists, drawn, led, sets, first, labels, member, open_, open_sets, more):
            drop_staged(done)
        return out


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable by links, the document's own included."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    join = JaccardJoin(texts, words, percent)
    labels = join.links()
    named = join.named.select("doc_id", "n_shingles", "node")
    # Only nodes of several documents or of a component need more than the document's own id.
    low = named.where("node <> 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("many"))
    low = low.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = low.groupBy("label").agg(F.min("low").alias("component"), F.sum("many").alias("many")).where("many > 1").drop("many")
    found = low.select("node", "label").join(least, "label").select("node", "component")
    rows = named.join(found, "node", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
