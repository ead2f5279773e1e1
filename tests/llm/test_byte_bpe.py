import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from linkmill.llm import byte_bpe as B
from linkmill.llm.pretoken import token_starts
from linkmill.llm.runtime import text_buffer

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string"
TEXTS = ["", None, "Hello, it's a 'test' of \n\n  white   space \t", "漢字 and 😀 é́", "aaaaaaaaaa hahahahaha ----====  ", "x" * 5000, "'s've 'll  'd", "<|endoftext|>", " ", "  "]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_bytes_equal_the_library(spark):
    docs = list(enumerate(TEXTS)) + [(None, "a"), (0, "")]
    rows = B.round_trip(spark.createDataFrame(docs, SCHEMA), RANKS).collect()
    known = reference()
    assert len(rows) == len(docs)
    want = sorted((-1 if d is None else d, struct.pack(f"<{len(i)}I", *i), (t or "").encode()) for d, t in docs for i in [known.encode_ordinary(t or "")])
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows) == want
    apart = B.decode_ids(B.encode_texts(spark.createDataFrame(docs, SCHEMA), RANKS), RANKS).collect()
    assert sorted(hashlib.sha256(r.decoded).hexdigest() for r in apart) == sorted(hashlib.sha256(r.decoded).hexdigest() for r in rows)
    assert B.round_trip(spark.createDataFrame([], SCHEMA), RANKS).collect() == []


def test_periodic_words_and_classes():
    known, rnd, bpe = reference(), random.Random(1), B.ByteBpe(RANKS)
    bits = ["a", "aa", "-", "--", "=", "h", "ha", " ", "  ", "\n", "na", "é", "0", "<", "'", "s", "re", " ", "　", "²", "\x85", "漢"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    ids, bounds = bpe.codes.texts(*text_buffer(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == known.encode_ordinary(t), ascii(t)
    for k in range(1, 40):
        assert B.merge_by_rank(b"a" * k, bpe.ranks) == known.encode_ordinary("a" * k)


def test_offsets_cover_characters(spark):
    text = "a漢字😀é"
    rows = B.token_offsets(B.encode_texts(spark.createDataFrame([(1, text)], SCHEMA), RANKS), RANKS).collect()
    ends, starts, stops = rows[0].byte_ends, rows[0].char_starts, rows[0].char_ends
    raw, begin = text.encode(), 0
    assert ends[-1] == len(raw)
    for e, s, c in zip(ends, starts, stops, strict=True):
        assert text[s:c].encode().find(raw[begin:e]) >= 0
        begin = e


def test_unknown_ids_decode_to_nothing():
    bpe = B.ByteBpe(RANKS)
    data, ends = bpe.decode(np.array([10**9], dtype=np.uint32), np.array([0, 1]))
    assert len(data) == 0 and ends.tolist() == [0, 0]


def test_token_starts_of_nothing():
    assert len(token_starts(np.zeros(0, np.uint8), np.array([0, 0]))) == 0


def test_a_word_of_a_megabyte_takes_seconds():
    import time

    rnd, bpe = random.Random(2), B.ByteBpe(RANKS)
    word = "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(340_000))
    began = time.perf_counter()
    ids, _ = bpe.words([word])
    assert time.perf_counter() - began < 60
    data, _ = bpe.decode(ids, np.array([0, len(ids)]))
    assert data.tobytes().decode() == word
    short = word[:3000]
    assert bpe.words([short])[0].tolist() == reference().encode_ordinary(short)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, ids string, n_tokens int")
    assert [(r.doc_id, bytes(r.decoded)) for r in B.round_trip(df, RANKS).collect()] == [(1, b"a b")]
