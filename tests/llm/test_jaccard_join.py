import random
import re

import numpy as np
import pytest

from linkmill.llm import components as C
from linkmill.llm import jaccard_join as J

SCHEMA = "doc_id long, text string"


def brute(docs, words=4, percent=85):
    sets = {}
    for doc, text in docs:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = len(found)
        sets[doc] = {tuple(found[i : i + words]) for i in range(max(1, n - words + 1))} if n else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in sets.items())


def answers(spark, docs):
    return sorted(tuple(r) for r in J.jaccard_components(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect())


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Of", "THE", "é"]
    docs, texts = [], []
    for _ in range(25):
        texts.append([rnd.choice(vocab) for _ in range(rnd.randint(1, 80))])
    passage = [rnd.choice(vocab) for _ in range(30)]
    for _ in range(160):
        t = list(rnd.choice(texts))
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(len(t))] = rnd.choice(vocab)
        if rnd.random() < 0.2:
            t += passage
        if rnd.random() < 0.2:
            t = t[: max(1, int(len(t) * 0.9))]
        texts.append(t)
    for i, t in enumerate(texts):
        docs.append((i, rnd.choice([" ", "\n", "\t "]).join(t)))
    n = len(docs)
    return docs + [(n, ""), (n + 1, None), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 5, docs[0][1])]


@pytest.mark.parametrize("seed,hot,bucket,short", [(1, 16, 4096, 32), (2, 3, 5, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, hot, bucket, short):
    monkeypatch.setattr(J, "HOT", hot)
    monkeypatch.setattr(J, "BUCKET", bucket)
    monkeypatch.setattr(J, "SHORT", short)
    docs = corpus(seed)
    assert answers(spark, docs) == brute(docs)


@pytest.mark.parametrize("words,percent", [(5, 80), (2, 60), (1, 100)])
def test_other_limits(spark, words, percent):
    docs = corpus(5)
    got = J.jaccard_components(spark.createDataFrame(docs, SCHEMA), words=words, percent=percent).collect()
    assert sorted(tuple(r) for r in got) == brute(docs, words, percent)


def test_empty_and_null_rows(spark):
    assert answers(spark, []) == []
    text = "a b c d e f"
    got = J.jaccard_components(spark.createDataFrame([(None, text), (3, text), (2, text), (2, text)], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 3, None), (2, 3, 2), (2, 3, 2), (3, 3, 2)]


@pytest.mark.parametrize("block", [1_000_000, 7])
def test_components_of_chains_and_hubs(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    links = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(links, "u long, v long").repartition(7)
    got = {r.node: r.label for r in C.component_labels(df).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, **{k: 100 for k in range(101, 140)}}


def test_pairs_of_lists_follow_the_bounds(monkeypatch):
    monkeypatch.setattr(J, "SHORT", 8)
    monkeypatch.setattr(J, "BLOCK", 7)
    rnd = np.random.default_rng(3)
    edge = np.array([0, 1, 6, 9, 49, 60])
    size = np.concatenate([np.sort(rnd.integers(1, 40, n)) for n in np.diff(edge)])
    place = np.minimum(rnd.integers(0, 8, 60), size - 1)
    got = [(int(i), int(j)) for a, b in J.all_pairs(edge, size, place, 85) for i, j in zip(a, b, strict=True)]
    of = np.searchsorted(edge, np.arange(60), side="right")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if of[i] == of[j] and 100 * size[i] >= 85 * size[j] and min(size[i] - place[i], size[j] - place[j]) >= J.needed(size[i], size[j], 85)}
    assert set(got) == want and len(got) == len(want)


def test_sketches_differ_in_no_more_bits_than_the_sets():
    rnd = np.random.default_rng(4)
    pool = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = [np.unique(rnd.choice(pool, n)) for n in (1, 5, 63, 64, 65, 130, 500, 2000, 2100)]
    sets.append(np.unique(np.append(sets[-1][5:], pool[:9])))
    bounds = np.append(0, np.cumsum([len(s) for s in sets]))
    data, at = J.sketches(np.concatenate(sets), bounds)
    drawn = J.Sketches(J.blobs(data, at))
    i, j = np.triu_indices(len(sets), 1)
    apart = [len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    got = drawn.differing(i, drawn, j)
    assert (got <= apart).all() and got[-1] == apart[-1] and got.max() > 200


@pytest.mark.parametrize("bucket", [4096, 7])
def test_group_of_sets_that_link_in_part(spark, monkeypatch, bucket):
    monkeypatch.setattr(J, "BUCKET", bucket)
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for i in range(120):
        t = list(base)
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(60)] = f"x{rnd.randint(0, 3)}"
        docs.append((i, " ".join(t)))
    assert answers(spark, docs) == brute(docs)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (2, 3, 0, 1), (3, 1, 0, 2)])
def test_an_id_with_several_texts_joins_their_components(spark, order):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, "less " + b)]
    got = J.jaccard_components(spark.createDataFrame([rows[k] for k in order] + [(1, ""), (4, "c " + b[3:100])], SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_clashing_columns_and_a_long_text(spark):
    rnd = random.Random(2)
    long = " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(500)) for _ in range(300_000))
    docs = [(5, long, "n", 1, "l"), (6, long + " more", "n", 2, "m"), (7, "x " * 30, None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, node string, size int, label string")
    assert sorted((r.doc_id, r.component_id) for r in J.jaccard_components(df).collect()) == [(5, 5), (6, 5), (7, 7)]
