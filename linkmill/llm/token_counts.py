"""Counts of greedy word pieces by a linear longest-match automaton (operator 7).

A word's pieces are found from its start: the longest vocabulary entry, then the longest continuation,
and so on; a word that cannot be covered is one unknown token. The automaton (Song et al., 2021) does
that in one pass: a trie of all entries with a failure link for each node, along which matching goes
on when the next character has no edge, and the number of pieces that taking the link has settled.
Only these counts are kept, so no piece is ever built. A worker remembers the counts of words.

With ``fallback`` the whole model takes part: where no entry begins a word, the lone word mark is a piece
of its own and entries that continue words follow it, and a character that no entry covers counts as its
UTF-8 bytes. A word is unknown then only if the model lacks these pieces.

Defined results: null or empty text has no words and no tokens; texts are read whole, without a limit
on word length; null ids and repeated rows are counted like others; other columns take no part.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmill.llm.runtime import text_chunks

#: Words whose counts a worker remembers.
WORDS = 400_000
#: What an unknown word adds to a text's sum besides its one token.
UNKNOWN = 1 << 40
START, INNER, NONE = 0, 1, -1


class Automaton:
    """starts: entries that may begin a word; inners: entries that may continue one.

    mark: pieces of a lone word mark, 0 if it is none; spelled: characters outside the entries count as their bytes.
    """

    def __init__(self, starts: Iterable[str], inners: Iterable[str], mark: int = 0, spelled: bool = False):
        self.edge: list[dict[str, int]] = [{}, {}]
        entry = [False, False]
        for root, words in ((START, starts), (INNER, inners)):
            for word in words:
                at = root
                for c in word:
                    to = self.edge[at].get(c)
                    if to is None:
                        to = self.edge[at][c] = len(self.edge)
                        self.edge.append({})
                        entry.append(False)
                    at = to
                if word:
                    entry[at] = True
        self.link, self.popped = [NONE] * len(self.edge), [0] * len(self.edge)
        self.spelled = spelled
        if mark:
            self.link[START], self.popped[START] = INNER, mark
        queue = deque((START, INNER))
        while queue:
            parent = queue.popleft()
            for c, node in self.edge[parent].items():
                queue.append(node)
                if entry[node]:
                    self.link[node], self.popped[node] = INNER, 1
                    continue
                at, popped = self.link[parent], self.popped[parent]
                while at != NONE and c not in self.edge[at]:
                    at, popped = self.link[at], popped + self.popped[at]
                if at != NONE:
                    self.link[node], self.popped[node] = self.edge[at][c], popped
                elif spelled and (mark or parent != START):
                    self.link[node], self.popped[node] = INNER, popped + len(c.encode())

    def count(self, word: str) -> int:
        """Pieces of a word, or 0 if it cannot be covered."""
        at, pieces = START, 0
        edge, link, popped = self.edge, self.link, self.popped
        for c in word:
            while (to := edge[at].get(c)) is None:
                if link[at] == NONE:
                    if at != INNER or not self.spelled:
                        return 0
                    pieces, to = pieces + len(c.encode()), INNER
                    break
                pieces += popped[at]
                at = link[at]
            at = to
        while at != INNER:
            if link[at] == NONE:
                return 0
            pieces += popped[at]
            at = link[at]
        return pieces


class Counts(dict):
    """What each word (its UTF-8 bytes) adds to a text's sum."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        found = self.automaton.count(word.decode()) or UNKNOWN + 1
        if len(self) >= WORDS:
            self.clear()
        self[word] = found
        return found


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Starts and inners of a sentencepiece model: a leading word mark makes a start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [p[1:] for p in plain if p[0] == "▁" and len(p) > 1], [p for p in plain if "▁" not in p]


def whole_vocabulary(path: str) -> tuple[list[str], list[str], int, bool]:
    """The arguments of an automaton of all pieces; those with a word mark also match a mark that stands in a text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    starts, inners = vocabulary(path)
    lone = not model.is_unknown(model.piece_to_id("▁"))
    spelled = sum(model.is_byte(i) for i in range(model.get_piece_size())) == 256
    return starts, [*inners, *(f"▁{p}" for p in starts), *["▁"] * lone], 1 if lone else len("▁".encode()) * spelled, spelled


@functools.lru_cache(maxsize=2)
def counts(path: str, fallback: bool = False) -> Counts:
    return Counts(Automaton(*(whole_vocabulary if fallback else vocabulary)(path)))


def _counted(batches: Iterator[pa.RecordBatch], path: str, fallback: bool) -> Iterator[pa.RecordBatch]:
    known = counts(path, fallback)
    get = known.__getitem__
    for batch in batches:
        for chunk in text_chunks(batch):
            words, sums = [], []
            for text in chunk["text"].to_pylist():
                found = (text or "").encode().split()  # at the six ASCII white-space characters
                words.append(len(found))
                sums.append(sum(map(get, found)))
            yield pa.RecordBatch.from_arrays(
                [chunk["doc_id"], pa.array(words, pa.int64()), pa.array([s % UNKNOWN for s in sums], pa.int64()), pa.array([s // UNKNOWN for s in sums], pa.int64())],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"],
            )


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", fallback: bool = False) -> DataFrame:
    """doc_id, n_words, n_tokens (unknown words are one each) and n_unknown of every whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _counted(batches, model_path, fallback), "doc_id long, n_words long, n_tokens long, n_unknown long")
