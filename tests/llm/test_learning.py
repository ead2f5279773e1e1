import random

import numpy as np

from linkmill.llm import cotraining as C
from linkmill.llm import toxicity as X
from linkmill.llm.linear import Rows, calibration, fit, predict, sigmoid

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 7 == 0
        words = [rnd.choice(vocab) for _ in range(rnd.randint(20, 60))]
        if bad:
            words = [w.upper() + "!!" for w in words]
        elif toxic:
            words[rnd.randrange(len(words))] = rnd.choice(["nasty", "vile"])
        text = " ".join(words)
        docs.append((i, text, rnd.choice(["en", "fr", None]), f"s{i % 3}", len(text), "x"))
        if i % 2:
            labels.append((i, int(not bad), int(toxic and not bad)))
    return docs, labels


def test_co_training_on_held_out_documents(spark):
    docs, labels = corpus()
    extra = [(1000, None, None, None, None, "x"), (1001, "", "en", "s1", 0, "x"), (None, "abc def", "en", "s1", 7, "x"), (1, docs[1][1], "en", "s1", 3, "x")]
    rows = C.classified(spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels + [(2, None, None), (3, 0, 0)], LABELS), sample=150, grow=40).collect()
    assert len(rows) == len(docs) + len(extra) and rows[0].row.kept == "x"
    verdict = {r.row.doc_id: r.kept for r in rows if r.row.doc_id is not None and r.row.doc_id < 400}
    held_out = [i for i in range(400) if i % 2 == 0]
    assert np.mean([verdict[i] == (i % 5 != 0) for i in held_out]) > 0.97
    assert all(0 <= p <= 1 for r in rows for p in (r.p_text, r.p_meta, r.p_quality))


def test_rounds_choose_among_all_unlabelled_documents(spark):
    rng = np.random.default_rng(5)
    n = 900
    ids = np.arange(n)
    shape = np.round(rng.random((n, len(C.SHAPES))), 2)
    codes = rng.integers(0, 6, (n, 3)).astype(np.int32)
    y = ((shape[:, 1] + codes[:, 0] / 6 + 0.3 * rng.random(n)) > 1.1).astype(np.int64)
    pool, known = ids[ids % 3 > 0], ids[ids % 3 == 0]
    asked = []

    def plainly(plan):
        out = {slot: (pool[r], shape[pool][r], codes[pool][r]) for slot, r, _ in plan.candidates(pool, shape[pool], codes[pool])}
        asked.append(sum(len(v[0]) for v in out.values()))
        return out

    rows = [(int(i), shape[i].tolist(), codes[i].tolist()) for i in pool]
    frame = spark.createDataFrame(rows, "id long, shape array<double>, meta array<int>").repartition(5)
    options = {"grow": 30, "confident": 0.8}
    one = C.CoTrained(known, shape[known], codes[known], y[known], plainly, **options)
    two = C.CoTrained(known, shape[known], codes[known], y[known], C.nominator(frame, ["a", "b"], 30), **options)
    assert len(asked) == C.ROUNDS and min(asked) > 30
    for a, b in zip(one.thetas, two.thetas, strict=True):
        assert np.allclose(a, b)
    none = C.CoTrained(known, shape[known], codes[known], y[known], lambda plan: {}, **options)
    assert not np.allclose(none.thetas[1], one.thetas[1])


def test_chain_on_held_out_documents(spark):
    docs, labels = corpus()
    rows = X.toxicity(spark.createDataFrame(docs + [(None, None, None, None, None, "x")], DOCS), spark.createDataFrame(labels + [(1, 0, 1)], LABELS), width=1 << 12).collect()
    assert len(rows) == len(docs) + 1
    got = {r.doc_id: r.is_toxic for r in rows}
    held_out = [i for i in range(400) if i % 2 == 0]
    assert np.mean([got[i] == (i % 7 == 0 and i % 5 != 0) for i in held_out]) > 0.97


def test_without_labels_and_without_rows(spark):
    docs, _ = corpus(20)
    none = spark.createDataFrame([], LABELS)
    df = spark.createDataFrame(docs, DOCS)
    assert {r.p_quality for r in C.classified(df, none).collect()} == {0.5}
    assert {r.p_toxic for r in X.toxicity(df, none).collect()} == {0.5}
    assert C.classified(df.limit(0), none).collect() == [] and X.toxicity(df.limit(0), none).collect() == []


def test_out_of_fold_probabilities_feed_later_links():
    rng = np.random.default_rng(0)
    first = rng.integers(0, 2, 600)
    word = np.where(first == 1, 1, 2) * (rng.random(600) < 0.95)
    x = Rows(np.arange(601), word.astype(np.int32), np.ones(600), 8)
    chain = X.Chain.fitted(x, np.arange(600), np.stack([first, first], axis=1))
    assert len(chain.links[1][1]) == 1 and chain.links[1][1][0] > 0
    assert np.mean((chain.probabilities(x)[:, 1] > 0.5) == first) > 0.95


def test_regression_and_calibration():
    rng = np.random.default_rng(1)
    y = (rng.random(500) < 0.3).astype(float)
    x = Rows(np.arange(501), (y + (rng.random(500) < 0.1)).astype(np.int32), np.ones(500), 3)
    p = sigmoid(predict(x, fit(x, y)))
    assert np.mean((p > 0.5) == y) > 0.85
    a, b = calibration(np.where(y > 0, 2.0, -2.0), y)
    assert a > 0 and abs(sigmoid(np.array(2 * a + b)) - 1) < 0.1
