import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkmill.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


def check(spark, docs, window=2048, **options):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in docs}
    rows = P.digests(P.pack_documents(spark.createDataFrame(docs, SCHEMA).repartition(2), PATH, window=window, **options)).collect()
    got, sequences = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == got.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length > 0 and zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)) == r.ids_crc32
        got[r.doc_id] = r.start + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == {d: len(i) for d, i in ids.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0
    return rows


@pytest.mark.parametrize("segment", [1 << 22, 500])
def test_every_id_once_and_no_padding(spark, segment):
    rnd = np.random.default_rng(1)
    docs = [(i, " ".join(["word"] * int(rnd.integers(0, 90)))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "long text <|endoftext|> " * 900)]
    check(spark, docs, window=64, segment_tokens=segment)
    check(spark, docs)


def test_empty_and_repeated_rows(spark):
    assert P.pack_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []
    rows = P.pack_documents(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], SCHEMA), PATH).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 6 and sum(r.length for r in rows if r.doc_id is None) == 2


def test_level_minimises_squares():
    packer = P.LevelPacker(10)
    for size in (3, 3, 3, 4):
        packer.place([0, 0, np.zeros(size, np.uint32), size])
    before = packer.count.copy()

    def cost(level, size):
        n = before.copy()
        if level:
            n[level] -= 1
        if level + size < 10:
            n[level + size] += 1
        return int((n[1:10] ** 2).sum())

    options = [0, *[h for h in range(1, 10) if before[h] and h + 4 <= 10]]
    best = min(cost(h, 4) for h in options)
    packer.place([0, 0, np.zeros(4, np.uint32), 4])
    assert int((packer.count[1:10] ** 2).sum()) == best
