from linkmill.llm import preferences as P

SCHEMA = "conv_id long, turn long, role string, text string, prompt string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def brute(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1

    def show(part):
        out, spans = "", []
        for role, text in part:
            out += f"<|{role}|>\n"
            if role == "assistant":
                spans.append((len(out), len(out) + len(text) + 8))
            out += text + "<|end|>\n"
        return out, spans

    return (n, show(a[:n])[0], *show(a[n:]), *show(b[n:]))


def test_pairs_equal_brute_force(spark):
    sides = {
        1: ([("user", "hé"), ("assistant", "yes"), ("user", "ok")], [("user", "hé"), ("assistant", "no")]),
        2: ([("user", "a")], [("user", "a")]),
        3: ([("system", "s")], [("system", "s"), ("assistant", "more")]),
        4: ([("user", "a")], [("assistant", "a")]),
    }
    tables = [turns(spark, [(c, k, r, t) for c, s in sides.items() for k, (r, t) in enumerate(s[i])]) for i in (0, 1)]
    rows = {r.conv_id: r for r in P.preference_pairs(*tables).collect()}
    assert set(rows) == set(sides)
    for c, (a, b) in sides.items():
        r = rows[c]
        assert (r.n_prompt_turns, r.prompt, r.chosen, [tuple(s) for s in r.chosen_spans], r.rejected, [tuple(s) for s in r.rejected_spans]) == brute(a, b)


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, 1, "assistant", "A. B."), (None, 0, "user", "x"), (2, 0, "user", "no answer"), (3, None, "user", "q"), (3, 0, "assistant", "one")]
    got = {r.conv_id: r for r in P.digests(P.preference_pairs(*P.shortened_answers(turns(spark, rows)))).collect()}
    assert set(got) == {1, 3}
    assert got[1].n_prompt_turns == 2 and got[1].rejected == "<|assistant|>\nA<|end|>\n" and got[1].chosen_mask == "14:27"
    assert got[3].n_prompt_turns == 2 and got[3].chosen == got[3].rejected == ""
    assert P.preference_pairs(*P.shortened_answers(turns(spark, []))).collect() == []


def test_of_repeated_last_answers_one_is_cut(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "A. B."), (1, 1, "assistant", "A. B."), (1, 2, "user", "after")]
    got = P.digests(P.preference_pairs(*P.shortened_answers(turns(spark, rows)))).collect()
    assert [(r.n_prompt_turns, r.chosen, r.rejected) for r in got] == [(2, "<|assistant|>\nA. B.<|end|>\n", "<|assistant|>\nA<|end|>\n")]


def test_sql_agrees_on_ties_repeated_rows_and_long_texts(spark):
    import duckdb

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "A. B."), (1, 1, "assistant", "A. B."), (2, None, None, None), (2, 0, "assistant", "x" * 300_000 + ". y"), (3, 0, "assistant", ""), (4, 0, "user", "u"), (None, 0, "assistant", "n")]
    conversations = turns(spark, rows).toPandas()
    conversations["conv_id"] = conversations["conv_id"].astype("Int64")
    conversations["turn"] = conversations["turn"].astype("Int64")
    want = duckdb.sql(P.SQL).fetchall()
    got = P.digests(P.preference_pairs(*P.shortened_answers(turns(spark, rows)))).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 3
