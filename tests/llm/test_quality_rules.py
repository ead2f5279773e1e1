import math
import random
import re

from pyspark.sql import functions as F

from linkmill.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def corpus():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(30)] + ["#", "a|b", "é", "\xa0x"]
    docs = [(i, "".join(rnd.choice(vocab) + rnd.choice([" ", "\n", "\t\r ", " \x0b"]) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "a b c d e f a b c d e"), (103, "a a a a a a a a a a a a"), (104, "x\n\nx\n \nx"), (None, "one two"), (100, "\n")]
    return [(d, t, "z") for d, t in docs]


def test_counts_equal_brute_force(spark):
    docs = corpus()
    rows = Q.digests(Q.judged(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS), buckets=64)).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((-1 if d is None else d, *base(t)) for d, t, _ in docs)
    assert not any(r.kept and r.base_failed for r in rows)


def buckets_of(words, buckets):
    """The buckets of a text in one array, by lambdas."""
    hashes = Q.word_hashes(words)
    return F.transform(F.concat(hashes, Q.joined(hashes, hashes, 1)), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def test_ratio_equals_brute_force(spark):
    docs = [(d, t, s) for d, t, s in corpus() if d is not None and d < 100]
    good = {1, 5, 9}
    df = spark.createDataFrame(docs, SCHEMA)
    rows = Q.judged(df, spark.createDataFrame([(d, 1, 0) for d in good], LABELS), buckets=32, threshold=0.0).collect()
    hashed = {r.doc_id: r.b for r in Q.held(df.select("doc_id", Q.words_of(F.col("text")).alias("w")), "b", buckets_of(F.col("w"), 32)).collect()}
    raw, target = [0] * 32, [0] * 32
    for d, found in hashed.items():
        for b in found:
            raw[b] += 1
            target[b] += d in good
    ratio = [math.log((t + Q.SMOOTHING) / (r * sum(target) / sum(raw) + Q.SMOOTHING)) for t, r in zip(target, raw, strict=True)]
    for r in rows:
        found = hashed[r.row.doc_id]
        want = sum(ratio[b] for b in found) / len(found) if found else 0.0
        assert abs(r.score - want) < 1e-8 and r.kept == (not r.base_failed and round(want, 9) >= 0) and r.row.score == "z"


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert Q.judged(spark.createDataFrame([], SCHEMA), none).collect() == []
    rows = Q.judged(spark.createDataFrame(corpus(), SCHEMA), none, buckets=64).collect()
    assert all(r.score == 0.0 and r.kept != r.base_failed for r in rows)


def test_target_counts_all_labelled_documents(spark):
    n = 20_100
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.format_string("t%d u%d", "id", "id").alias("text"))
    docs = docs.union(spark.createDataFrame([(None, "no id"), (7, "t7 u7")], "doc_id long, text string"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    found = Q.held(docs.select("doc_id", Q.words_of(F.col("text")).alias("w")), "b", buckets_of(F.col("w"), 8)).select("doc_id", "b").collect()
    raw, target = [0] * 8, [0] * 8
    for r in found:
        for b in r.b:
            raw[b] += 1
            target[b] += r.doc_id is not None
    assert sum(target) == 3 * (n + 1)
    ratio = [math.log((t + Q.SMOOTHING) / (x * sum(target) / sum(raw) + Q.SMOOTHING)) for t, x in zip(target, raw, strict=True)]
    rows = Q.judged(docs, labels, buckets=8).select(F.col("row.doc_id").alias("doc_id"), "score").collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, sum(ratio[b] for b in r.b) / len(r.b)) for r in found)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in rows)
    assert all(a == b and abs(x - y) < 1e-8 for (a, x), (b, y) in zip(got, want, strict=True))


def test_marked_ids(spark, monkeypatch):
    rnd = random.Random(5)
    ids = [*range(-200, 200), -(1 << 63), (1 << 63) - 1, 1 << 40, None, None, 3, 3]
    good = {i for i in ids if i is not None and rnd.random() < 0.5} | {3, -(1 << 63), 999}
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in (*good, *good, None)], LABELS)
    want = sorted((str(i), 1 if i in good else 0) for i in ids)
    for sent in (Q.SENT, 0):
        monkeypatch.setattr(Q, "SENT", sent)
        assert sorted((str(r.doc_id), r.good or 0) for r in Q.marked(docs, labels).collect()) == want
