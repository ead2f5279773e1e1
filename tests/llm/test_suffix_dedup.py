import hashlib
import random

import numpy as np
import pytest

from linkmill.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string"


def brute(docs, length):
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda x: x[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for p in range(len(raw) - length + 1):
            piece = raw[p : p + length]
            if piece in seen:
                gone[p : p + length] = True
            seen.add(piece)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        out.append((doc, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def answers(spark, docs, **options):
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in S.digests(S.remove_copies(df, **options)).collect())


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "é", "漢字", "x", "of", "the", "\n", "gamma-delta"]
    passages = [" ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(40)) for _ in range(4)]
    docs = []
    for i in range(n):
        text = " ".join(rnd.choice(words) + str(rnd.randint(0, 9999)) for _ in range(rnd.randint(0, 60)))
        for _ in range(rnd.randint(0, 2)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            at = rnd.randint(0, len(text))
            text = text[:at] + p[a : a + rnd.randint(20, len(p))] + text[at:]
        docs.append((i, text))
    docs += [(n, docs[3][1]), (n + 1, docs[3][1] + "tail"), (n + 2, ""), (n + 3, None), (n + 4, "ab" * 400), (n + 5, "a" * 350), (n + 6, "x" + "a" * 120)]
    return docs


@pytest.mark.parametrize("options", [{}, {"hot_contexts": 1}, {"length": 40, "anchor": 8}])
def test_equals_brute_force(spark, options):
    docs = corpus(1)
    assert answers(spark, docs, **options) == brute(docs, options.get("length", 100))


def test_small_blocks(spark, monkeypatch):
    docs = corpus(2)
    monkeypatch.setattr(S, "BLOCK_BYTES", 500)
    assert answers(spark, docs) == brute(docs, 100)


def test_empty_null_and_repeated_rows(spark):
    assert answers(spark, []) == []
    text = "".join(f"{i} " for i in range(100))
    docs = [(1, text), (1, text), (2, text), (None, text)]
    got = answers(spark, [d for d in docs if d[0] is not None])
    assert [(d, r) for d, _, r, _, _ in got] == [(1, 0), (1, 0), (2, len(text))]
    df = spark.createDataFrame(docs, SCHEMA)
    kept = [r for r in S.digests(S.remove_copies(df)).collect() if r.doc_id is None]
    assert [r.n_removed for r in kept] == [0]


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a" * 300, "s", 5), (2, "b", None, 6)], "doc_id long, text string, anchor string, n int")
    rows = {r.row.doc_id: r for r in S.remove_copies(df).collect()}
    assert rows[1].row.anchor == "s" and rows[1].row.n == 5 and rows[2].kept == b"b"


def test_characters_stay_whole(spark):
    text = "é" * 200
    rows = S.remove_copies(spark.createDataFrame([(1, "x" + text), (2, text[:150])], SCHEMA), characters=True).collect()
    for r in rows:
        bytes(r.kept).decode()


def test_nearest_smaller():
    rnd = random.Random(5)
    for _ in range(30):
        x = np.array([rnd.randint(0, 9) for _ in range(rnd.randint(1, 30))])
        before, behind = S.nearest_smaller(x)
        for i in range(len(x)):
            assert before[i] == max([j for j in range(i) if x[j] < x[i]], default=-1)
            assert behind[i] == min([j for j in range(i + 1, len(x)) if x[j] < x[i]], default=len(x))


def test_a_long_text_is_read_in_pieces(monkeypatch):
    rnd = np.random.default_rng(7)
    part = rnd.integers(97, 105, 400).astype(np.uint8)
    data = np.concatenate([part, rnd.integers(97, 123, 700).astype(np.uint8), part, part])
    bounds = np.array([0, len(data)])

    def places(found):
        anchor, _, _, at, n = found
        return sorted((int(a) + k, int(h)) for h, a, m in zip(anchor, at, n, strict=True) for k in range(m))

    whole = places(S.contexts_of(data, bounds, 100, 32))
    monkeypatch.setattr(S, "PIECE", 333)
    assert places(S.pieces_of(data, bounds, 100, 32)) == whole and len(whole) == len(data) - 99


def test_a_very_long_text(spark):
    rnd = random.Random(3)
    long = " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(10**6)) for _ in range(1_300_000))  # beyond one piece
    docs = [(2, long), (1, long[9_000_000:9_000_500]), (3, "z" + long[8_388_500:8_388_800])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in S.digests(S.remove_copies(spark.createDataFrame(docs, SCHEMA))).collect()}
    assert len(long) > S.PIECE and got == {1: (500, 0, 0), 2: (len(long), 500, 1), 3: (301, 300, 1)}
