import random

import public_tokenizers

from linkmill.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(word, starts, inners):
    at, n = 0, 0
    while at < len(word):
        held = inners if at else starts
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in held), 0)
        if not size:
            return 0
        at, n = at + size, n + 1
    return n


def test_automaton_equals_greedy_matching():
    rnd = random.Random(2)
    for _ in range(300):
        starts, inners = ({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 8))} for _ in range(2))
        automaton = T.Automaton(starts, inners)
        for _ in range(40):
            word = "".join(rnd.choice("abcd" if rnd.random() < 0.1 else "abc") for _ in range(rnd.randint(1, 12)))
            assert automaton.count(word) == brute(word, starts, inners), (word, starts, inners)


def test_counts_of_texts(spark):
    starts, inners = map(set, T.vocabulary(PATH))
    texts = ["", None, "Hello world of pieces", "naïve été\tÜber\n漢字\x1c", "x" * 4000, "\xa0 \x0b a"]
    docs = [(i, t, 9) for i, t in enumerate(texts)] + [(None, "a a", 1), (1, "b", 1), (1, "b", 1)]
    rows = T.token_counts(spark.createDataFrame(docs, "doc_id long, text string, n_tokens int"), PATH).collect()

    def want(text):
        words = [w.decode() for w in (text or "").encode().split()]
        found = [brute(w, starts, inners) for w in words]
        return len(words), sum(f or 1 for f in found), sum(f == 0 for f in found)

    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in rows) == sorted((-1 if d is None else d, *want(t)) for d, t, _ in docs)
    assert T.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(T, "WORDS", 2)
    known = T.Counts(T.Automaton({"a", "b"}, {"a", "c"}))
    assert [known[w] for w in (b"a", b"b", b"ac", b"a", b"ca")] == [1, 1, 2, 1, T.UNKNOWN + 1]


def whole_brute(word, pieces):
    """Greedy longest match over the marked word; characters without a piece are their bytes."""
    word, at, n = "▁" + word, 0, 0
    while at < len(word):
        size = next((k for k in range(min(len(word) - at, 40), 0, -1) if word[at : at + k] in pieces), 0)
        at, n = at + (size or 1), n + (1 if size else len(word[at].encode()))
    return n


def test_fallback_automaton_equals_greedy_matching():
    rnd = random.Random(3)
    for _ in range(300):
        starts, inners = ({"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 8))} for _ in range(2))
        marked = {"▁" + p for p in starts}
        for lone in ({"▁"}, set()):
            pieces = inners | marked | lone
            automaton = T.Automaton(starts, inners | marked | lone, 1 if lone else 3, True)
            for _ in range(40):
                word = "".join(rnd.choice("abéd▁" if rnd.random() < 0.1 else "abé") for _ in range(rnd.randint(1, 12)))
                assert automaton.count(word) == whole_brute(word, pieces), (word, pieces)


def test_query_counts_all_pieces_of_the_model(spark, tmp_path):
    import sentencepiece

    from linkmill.llm.registry import op7_token_counts

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    texts = ["2024-11-26", "1234567890123", "ñmente", "漢字\x1c", "\U0001f9ff" * 50, "a▁mente ▁", "Hello world", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.n_unknown) for r in op7_token_counts(spark, str(tmp_path)).collect()}
    assert got == {i: (sum(whole_brute(w, pieces) for w in (t or "").split(" ") if w), 0) for i, t in enumerate(texts)}
    assert got[0] == (11, 0) and got[0][0] == len(model.encode(texts[0]))
