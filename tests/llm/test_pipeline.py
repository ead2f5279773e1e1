import random

import corpus_pipeline as P
from test_jaccard_join import brute as classes
from test_suffix_dedup import brute as passages

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(6)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    passage = " ".join(rnd.choice(vocab) for _ in range(60))
    docs, labels = [], []
    for i in range(150):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(30, 90))]
        if i % 5 == 0:
            words = [w.upper() + "!!" for w in words]
        if i % 11 == 1:
            words[5:5] = passage.split()
        docs.append([i, " ".join(words), "en", f"s{i % 3}", 0])
        if i % 2:
            labels.append((i, int(i % 5 != 0), 0))
    for i, of in ((200, 1), (201, 1), (202, 2)):
        docs.append([i, docs[of][1].replace(docs[of][1].split()[9], "changed", 1 if i == 201 else 0), "en", "s0", 0])
    for d in docs:
        d[4] = len(d[1])
    return [tuple(d) for d in docs], labels


def test_stages(spark, tmp_path):
    docs, labels = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    df = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, df, folder)
        if k < len(P.STAGES) - 1:
            assert out.columns == df.columns
        out.write.parquet(f"{folder}/{name}")
        df = spark.read.parquet(f"{folder}/{name}")
        seen[name] = df.collect()
    good = {r.doc_id for r in seen["quality_classifier"]}
    assert sum(d[0] in good for d in docs if d[0] % 5 and d[0] < 150) > 110 and sum(d[0] in good for d in docs if d[0] % 5 == 0 and d[0] < 150) < 4
    ruled = [(r.doc_id, r.text) for r in seen["quality_rules"]]
    low = {d: c for d, _, c in classes(ruled, P.WORDS, P.PERCENT)}
    assert {r.doc_id for r in seen["jaccard_join"]} == {d for d, c in low.items() if c == d}
    kept = [(r.doc_id, r.text) for r in seen["jaccard_join"]]
    want = {d: n - gone for d, n, gone, _, _ in passages(kept, 100)}
    assert {r.doc_id: len(r.text.encode()) for r in seen["suffix_dedup"]} == want
    assert all(r.n_chars == len(r.text) for r in seen["suffix_dedup"])
    pieces = {}
    for r in seen["packing"]:
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
        total = r.doc_tokens
        assert r.length <= 2048 and total >= r.length
    assert set(pieces) == set(want)
    assert P.queries()["pipeline"](spark, folder).count() == len(seen["packing"])
