import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkmill.functions import similarity as S
from linkmill.functions import text as T
from linkmill.operators import assignment as A
from linkmill.operators import blocking as B
from linkmill.operators import evaluation as E
from linkmill.operators import features as X
from linkmill.operators import learning as L
from linkmill.operators import records as R
from linkmill.operators import rules
from linkmill.plans import record_queries as Q
from linkmill.plans.fixtures import SQL
from linkmill.sources import files

PAIR = "s1_id string, cand_id string"


def test_metric_golden(spark):
    truth = spark.createDataFrame([("A", "S2-47"), ("A", "S3-812"), ("C", "S3-9")], PAIR)
    pred = spark.createDataFrame([("A", "S2-47"), ("A", "S2-193"), ("A", "S3-812"), ("D", "S2-1"), ("A", "S2-47")], PAIR)
    ids = spark.createDataFrame([(x,) for x in "ABCD"], "s1_id string")
    got = {r.s1_id: round(r.f05, 6) for r in E.per_entity_f05(truth, pred, ids).collect()}
    assert got == {"A": 0.714286, "B": 1.0, "C": 0.0, "D": 0.0}
    assert round(E.macro_f05(truth, pred, ids).first()[0], 6) == 0.428571


@pytest.mark.parametrize("p", [(0.72, 0.51, 0.13), (0.9, 0.8, 0.2), (0.2, 0.1, 0.05)])
def test_exact_utility_equals_enumeration(p):
    got = A.exact_utility(np.array(p))
    for k in range(len(p) + 1):
        want = 0.0
        for world in itertools.product([0, 1], repeat=len(p)):
            weight = np.prod([q if w else 1 - q for q, w in zip(p, world, strict=True)])
            n, tp = sum(world), sum(world[:k])
            f = 1.0 if n == k == 0 else 0.0 if n == 0 or k == 0 else 1.25 * tp / (0.25 * n + k)
            want += weight * f
        assert abs(got[k] - want) < 1e-9


def utility_by_counts(p, most):
    """Expected F0.5 of the prefixes by the distributions of the true candidates inside and outside."""
    def counts(q):
        out = np.ones(1)
        for x in q:
            out = np.convolve(out, [1 - x, x])
        return out

    found = [counts(p)[0]]
    for k in range(1, min(most, len(p)) + 1):
        inside, outside = counts(p[:k]), counts(p[k:])
        found.append(sum(a * b * 1.25 * i / (0.25 * (i + j) + k) for i, a in enumerate(inside) for j, b in enumerate(outside) if i))
    return found


def test_exact_selection_counts_all_candidates(spark):
    rnd = random.Random(6)
    lists = {"a": [0.6] * 13, "b": [0.15] * 40, "c": [rnd.random() for _ in range(30)], "d": [0.9, 0.2], "e": [0.01] * 900 + [0.5]}
    rows = [(s, f"c{k:04d}", x) for s, ps in lists.items() for k, x in enumerate(ps)]
    got = {r.s1_id: (r.m, r.utility) for r in A.exact_ef05(spark.createDataFrame(rows, PAIR + ", p double")).collect()}
    for s, ps in lists.items():
        want = utility_by_counts(sorted(ps, reverse=True), 12)
        assert got[s][0] == int(np.argmax(want)) and abs(got[s][1] - max(want)) < 2e-9, s


def test_address_goldens(spark):
    cases = [
        ("4421 1A Amethyst Court, High Point, NC", "4421 1a amethyst ct high point nc", "4421", "1"),
        ("4421 12A Amethyst Court, High Point, NC", "4421 12a amethyst ct high point nc", "4421", "12"),
        ("Flat No A-5/101, Clifton Apartment, Faridabad, Haryana", "flat no a 5 101 clifton apt faridabad haryana", "5", "101"),
        ("30-25-4/1, Vadlapudi, Andhra Pradesh", "30 25 4 1 vadlapudi andhra pradesh", "30", "25"),
        ("##801 eleventh 11th 0520", "801 11 11 520", "801", "11"),
        ("28 rue général chanzy", "28 rue general chanzy", "28", "general"),
        ("<NULL>", "", "", ""),
    ]
    rows = R.normalize_addresses(spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, business_address string")).orderBy("k").collect()
    assert [(r.a_norm, r.a_num, r.a_street) for r in rows] == [c[1:] for c in cases]
    assert rows[-1].a_empty


def test_names(spark):
    rows = spark.createDataFrame([("Foo f/k/a Bar & Sons Ltd",), ("ACME (ID: 12) #7 Société",), ("www.shop.com",), ("राम Ltd",)], "business_name string")
    got = R.normalize_names(rows).collect()
    assert (got[0].n_core, got[0].n_alias, got[0].n_toks, got[0].has_alias) == ("bar and sons ltd", "foo", ["bar", "sons"], True)
    assert (got[1].n_core, got[1].n_nospace) == ("acme societe", "acmesociete")
    assert got[2].is_domain and got[3].is_native and got[3].n_core == "राम ltd"
    assert T.latin_folding()[0].count("é") == 1


def test_scorers():
    rnd = random.Random(1)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            last = 0
            for j, d in enumerate(b, 1):
                row[j], last = (last + 1 if c == d else max(row[j], row[j - 1])), row[j]
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rnd.choice("abc d") for _ in range(rnd.randint(0, 9))) for _ in range(2))
        assert S.lcs_length(a, b) == lcs(a, b)
    assert S.ratio("ab", "ab") == 1 and S.ratio("", "a") == 0
    assert S.token_set_ratio("a b", "b a c") == 1 and S.token_set_ratio("", "a") == 0
    assert S.token_sort_ratio("b a", "a b") == 1 and S.partial_ratio("bc", "abcd") == 1
    assert abs(S.jaro_winkler("martha", "marhta") - 0.961111) < 1e-6


def test_keys_and_reverse_candidates(spark):
    raw = [("S1-1", "Blue Lake Foods", "12 Main Street", "US"), ("S2-2", "Blue Lake Foods Inc", "12 Main St", "US"), ("S3-3", "Other", "12 Main St", "FR"), ("S2-4", "Lake Blue Foods", "", "US")]
    q, t = R.load_country(spark.createDataFrame(raw, files.RECORDS))
    keys = {(r.ktype, r.key) for r in B.record_keys(q).collect()}
    assert {("A", "12|main"), ("N", "lake"), ("P", "bluelakefo"), ("S", "blue foods lake"), ("B", "12 main"), ("NB", "blue lake"), ("AN", "12|foods")} <= keys
    cands = B.generate_candidates(q, t).collect()
    assert {(r.q, r.t) for r in cands} == {("S1-1", "S2-2"), ("S1-1", "S2-4")}
    best = next(r for r in cands if r.brank == 1)
    assert best.t == "S2-2" and best.sim_n == 1.0 and best.sim_a == 1.0


def test_selection_ties_and_owners(spark):
    rows = spark.createDataFrame([("a", "x", 0.9), ("b", "x", 0.9), ("a", "y", 0.2), ("b", "z", 0.01)], PAIR + ", p double")
    owned = A.one_owner(rows)
    assert {(r.s1_id, r.cand_id) for r in owned.collect()} == {("a", "x"), ("a", "y"), ("b", "z")}
    assert {(r.s1_id, r.cand_id) for r in A.select_ef05(owned).collect()} == {("a", "x")}
    q = {r.s1_id: r.q for r in A.exclusive_owner(rows, "p", "q").where("cand_id = 'x'").collect()}
    assert abs(q["a"] - 9 / 19) < 1e-9 and q["a"] == q["b"]


def test_label_shift_is_recovered(spark):
    rnd = np.random.default_rng(0)
    y = rnd.random(20000) < 0.1
    p = np.where(y, rnd.beta(8, 2, 20000), rnd.beta(1, 9, 20000)).round(3)
    # calibrate by bins, then drop half of the positives
    df = spark.createDataFrame([(1, float(a), int(b)) for a, b in zip(p, y, strict=True)], "g int, p double, y int")
    rate = {r.b: r.r for r in df.groupBy(F.floor(F.col("p") * 20).alias("b")).agg(F.avg("y").alias("r")).collect()}
    keep = [(1, float(rate[int(a * 20)])) for k, (a, b) in enumerate(zip(p, y, strict=True)) if not b or k % 2]
    start = spark.createDataFrame([(1, float(y.mean()))], "g int, pi double")
    got = L.em_prior(spark.createDataFrame(keep, "g int, p double"), ["g"], start, 60).first().prior
    want = (y & (np.arange(20000) % 2 == 1)).sum() / len(keep)
    assert abs(got - want) < 0.01


def test_lists_and_files(spark, tmp_path):
    lists = spark.createDataFrame([("S1-1", "S2-1,S3-2"), ("S1-2", "")], files.TRUTH)
    files.write_list_tsv(lists, str(tmp_path / "out"))
    lines = files.read_list_lines(spark, str(tmp_path / "out"))
    head = tuple(files.TRUTH.fieldNames())
    assert files.file_violations(lines, head).collect() == []
    assert {tuple(r) for r in files.read_list_pairs(lines, head).collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-2")}
    bad = spark.createDataFrame([("source1_entity_id,matched_entity_ids",), ("S1-1",)], "value string")
    assert {r.rule for r in files.file_violations(bad, head).collect()} == {"comma_separated", "malformed_row"}
    assert [r.rule for r in files.file_violations(bad.limit(0), head).collect()] == ["empty_file"]
    path = tmp_path / "r.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"quoted\t\tUS\n')
    rows = files.read_tsv(spark, str(path), files.RECORDS)
    assert rows.collect()[0] == ("S1-1", '"quoted', "", "US")
    files.write_parquet(rows, str(tmp_path / "p"))
    assert files.load_records(spark, str(tmp_path / "p"), "US").count() == 1
    with pytest.raises(ValueError):
        files.write_parquet(rows.drop("country"), str(tmp_path / "q"))


def test_second_best_modes(spark):
    rows = spark.createDataFrame([("a", "x", 3.0), ("b", "x", 2.0), ("c", "x", 1.0)], PAIR + ", rscore double")
    for legacy, want in ((True, [1.0, 0.0, -1.0]), (False, [1.0, -1.0, -2.0])):
        assert [r.margin_cand2 for r in X.context_features(rows, legacy).orderBy("s1_id").collect()] == want


def test_scorer_contract(spark):
    rows = spark.createDataFrame([("a", "b", "red fox", "red fox"), ("a", "c", "red fox", "dog")], PAIR + ", a_txt string, b_txt string")
    got = {r.cand_id: r.ce for r in L.pair_scorer(rows, L.token_scorer).collect()}
    assert got == {"b": 4.0, "c": -4.0}


def test_queries_without_sql_cover_all_candidates(spark):
    import __spark_entry__ as entry

    queries, d = entry.queries(), "/root/testdata/sf0.001"
    keys = lambda df: sorted(map(tuple, df.select(*df.columns[:2]).collect()))
    every = keys(queries["generate_candidates"](spark, d))
    for name in ("sim_ratio", "sim_partial", "sim_tsort", "sim_tset", "string_features", "pair_scorer"):
        assert name not in entry.oracle_sql() and keys(queries[name](spark, d)) == every, name
    assert keys(queries["pair_similarity"](spark, d)) == keys(queries["rerank_score"](spark, d))
    assert keys(Q.rule_pairs(spark, d)) == every


def test_partial_ratio_of_equally_long_strings_takes_the_better_direction():
    assert abs(S.partial_ratio("bcba", "acbb") - 2 / 3) < 1e-9 and S.partial_ratio("bcba", "acbb") == S.partial_ratio("acbb", "bcba")
    assert S.partial_ratio("ab", "xaby") == 1.0 and S.partial_ratio("", "a") == 0.0


def test_legal_forms_and_empty_addresses(spark):
    names = ["Dupont S.A.R.L", "E.I. Martin & Cie", "s a s u 3 sa", "s.a.s. s a", "sarlu nord", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(T.legal_forms_spaced(F.col("n")).alias("f")).collect()
    assert [r.f for r in rows[:5]] == [["sarl"], ["cie", "ei"], ["sa", "sasu"], ["sa", "sas"], []]
    given = [None, "", " NULL ", "<null>", "None", "na", "-", "n/a", "1 rue"]
    rows = spark.createDataFrame([(a,) for a in given], "a string").select(T.address_missing(F.col("a")).alias("e")).collect()
    assert [r.e for r in rows] == [True] * 5 + [False] * 4


def test_a_namesake_of_another_country_does_not_forbid_a_filler(spark):
    records = [("S1-1", "alpha works", "5 long street", "A"), ("S2-1", "alpha works group", "5 long street", "A"), ("S1-2", "alpha works group", "5 other road", "B")]
    frame = spark.createDataFrame(records, "entity_id string, business_name string, business_address string, country string")
    pairs = spark.createDataFrame([("S1-1", "S2-1", "A")], "s1_id string, cand_id string, country string")
    found = rules.filler_swap(pairs, frame, {"A": ["group"], "B": ["group"]}, [])
    assert [tuple(r) for r in found.collect()] == [("S1-1", "S2-1")]
    same = frame.withColumn("country", F.lit("A"))
    assert rules.filler_swap(pairs, same, {"A": ["group"]}, []).collect() == []


def test_cells_of_sibling_pairs(spark):
    rows = [("a", "x", ["n"], ["n"], "5", "5", 0.95), ("a", "y", ["n"], ["n", "sa"], "5", "9", 0.5), ("a", "z", ["n"], ["n", "b"], "5", None, 0.5), ("b", "w", ["n"], ["n"], "5", "5", 0.95)]
    frame = spark.createDataFrame(rows, "s1_id string, cand_id string, q_ntoks array<string>, t_ntoks array<string>, q_num string, t_num string, p double")
    got = {r.cand_id: r.cell for r in X.sibling_pairs(frame, ["sa"]).collect()}
    assert got == {"x": "none|same|free", "y": "legal|near|anch", "z": "word|missing|anch", "w": "none|same|free"}


def test_one_pass_evaluation_equals_one_by_one(spark):
    rnd = random.Random(4)
    pairs = [(f"e{rnd.randrange(30)}", f"r{rnd.randrange(50)}", round(rnd.random(), 3)) for _ in range(200)]
    pairs = list({p[:2]: p for p in pairs}.values())
    truth = [p[:2] for p in pairs if rnd.random() < 0.4] + [("e1", "gone"), ("none", "r1")]
    frame = spark.createDataFrame(pairs, "s1_id string, cand_id string, p double")
    true = spark.createDataFrame(truth, "s1_id string, cand_id string")
    ids = spark.createDataFrame([(f"e{k}",) for k in range(35)], "s1_id string")
    got = {r.selection: r.macro_f05 for r in E.evaluate(true, frame, ids).collect()}
    owned = A.one_owner(frame)
    want = {"ef05": A.select_ef05(owned)} | {f"thr_{t}": A.select_threshold(owned, t) for t in (0.3, 0.4, 0.5, 0.6)}
    assert set(got) == set(want)
    for name, selected in want.items():
        assert abs(got[name] - E.macro_f05(true, selected, ids).first().macro_f05) < 1e-12


RECORD = "entity_id string, business_name string, business_address string, country string"


def test_rescue_adds_what_one_entity_alone_has(spark):
    records = spark.createDataFrame(
        [
            ("S1-1", "Bread House SAS", "12 rue Victor Hugo Lyon", "France"),
            ("S1-2", "Milk House", "3 place Bellecour Lyon", "France"),
            ("S1-3", "Milk House", "3 place Bellecour Lyon", "France"),
            ("S1-4", "Wine House", "9 quai Gambetta Nantes", "France"),
            ("S2-1", "BREAD HOUSE", "12 Victor Hugo Lyon", "France"),  # one entity, not owned: added
            ("S2-2", "Milk House", "3 Bellecour Lyon", "France"),  # two entities
            ("S2-3", "Bread House", "77 Gambetta Nantes", "France"),  # another address
            ("S2-4", "Bread House", "12 rue Victor Hugo Lyon", "US"),  # another country
            ("S3-1", "Bread House", "12 rue Victor Hugo Lyon", "France"),  # owned already
            ("S3-2", "Wine House", "9 quai Gambetta Nantes", "France"),  # its entity has no pairs
        ],
        RECORD,
    )
    pairs = spark.createDataFrame([("S1-1", "S3-1", 0.95), ("S1-1", "S2-1", 0.01), ("S1-2", "S2-2", 0.02), ("S1-3", "S2-2", 0.02)], PAIR + ", p double")
    chosen, added = rules.rescue(pairs, records)
    assert [tuple(r) for r in chosen.collect()] == [("S1-1", "S3-1")]
    assert [tuple(r) for r in added.collect()] == [("S1-1", "S2-1")]


def test_swaps_of_both_kinds(spark):
    rows = [("S1-1", "Alpha Bread Club", "12 Hugo Road Lyon", "US"), ("S1-2", "Beta Bread", "5 Main Lyon", "US"), ("S1-3", "Gamma Music", "7 Main Lyon", "US"), ("S1-4", "Delta Music", "8 Main Lyon", "US")]
    rows += [("S2-1", "Alpha Music Club", "12 Hugo Road Lyon", "US"), ("S2-2", "Beta Center", "5 Main Lyon", "US"), ("S2-3", "Gamma Musik", "7 Main Lyon", "US"), ("S2-4", "Beta Center", "6 Main Lyon", "US")]
    records = spark.createDataFrame(rows, RECORD)
    pairs = spark.createDataFrame([("S1-1", "S2-1", 0.6), ("S1-2", "S2-2", 0.1), ("S1-3", "S2-3", 0.5), ("S1-2", "S2-4", 0.3)], PAIR + ", p double").withColumn("country", F.lit("US"))
    kinds = rules.swap_kinds(pairs.drop("p"), records, least=2)
    assert sorted(tuple(r) for r in kinds.collect()) == [("S1-1", "S2-1", "noun"), ("S1-2", "S2-2", "noise")]
    got = {(r.s1_id, r.cand_id): r.p for r in rules.apply_swaps(pairs, kinds).collect()}
    assert got == {("S1-1", "S2-1"): 0.003, ("S1-2", "S2-2"): 0.92, ("S1-3", "S2-3"): 0.5, ("S1-2", "S2-4"): 0.3}
    only = {(r.s1_id, r.cand_id): r.p for r in rules.apply_swaps(pairs, kinds, ("noise",)).collect()}
    assert only[("S1-1", "S2-1")] == 0.6 and only[("S1-2", "S2-2")] == 0.92


def learnable(spark, n=240):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        y = rng.random() < 0.5
        rows.append((f"S1-{k // 4}", f"S2-{k}", int(y), y + rng.gauss(0, 0.4), rng.random()))
    return spark.createDataFrame(rows, PAIR + ", y int, f1 double, f2 double").persist()


def test_training_steps(spark):
    x, small = learnable(spark), {"maxIter": 3, "maxDepth": 2, "seed": 1}
    first, _ = L.oof(x, ["f1", "f2"], "gbt", 2, **small)
    attributes = spark.createDataFrame([(f"S{s}-{k}", str(k % 3), f"n{k % 5}") for s in (1, 2) for k in range(240)], "entity_id string, a_num string, n_core string")
    second, models = L.stage_two(x, first, ["f1", "f2"], attributes, "gbt", 2, **small)
    assert second.count() == x.count() and len(models) == 2 and set(L.CLUSTER) <= set(second.columns)
    assert L.auc_rank(second).first()[0] > 0.85
    before, after = L.self_training(x, x.drop("y"), ["f1", "f2"], "lr", high=0.8, low=0.2, maxIter=10)
    assert L.auc_rank(L.label_join(after, x.where("y = 1"))).first()[0] > 0.85 and before.count() == after.count() == x.count()
    losses = {r.run: r.loss for r in L.ablation(x, ["f1", "f2"], {"signal": ["f1"]}, [0.5], "lr", maxIter=10).collect()}
    assert set(losses) == {"all", "without signal", "share 0.5"} and losses["without signal"] > losses["all"] + 0.2
    weights, auc = L.adversarial(x.where("f1 < 0.8"), x.where("f1 > 0.2").withColumn("s1_id", F.concat(F.lit("T"), "s1_id")), ["f1"], "lr", 2, maxIter=10)
    assert abs(weights.agg(F.avg("w")).first()[0] - 1) < 1e-9 and auc.first()[0] > 0.6


def test_rerank_score_rounds_like_the_sql_engine(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(n / 4, a / 5, k / 1000) for n in range(5) for a in range(6) for k in range(1, 1000, 2)]
    df = spark.createDataFrame(rows, "sim_n double, sim_a double, bscore double").withColumns({"t_native": F.lit(False), "t_aempty": F.lit(False)})
    got = [r.rscore for r in df.select(B.rerank_score().alias("rscore")).collect()]
    sql = "SELECT round(x.n + x.a + 0.05 * least(x.b, 10.0), 4) FROM (SELECT unnest(?::STRUCT(n DOUBLE, a DOUBLE, b DOUBLE)[]) AS x)"
    assert got == [r[0] for r in duckdb.execute(sql, [[dict(zip("nab", r, strict=True)) for r in rows]]).fetchall()]


def test_jaro_winkler_is_that_of_the_sql_engine():
    duckdb = pytest.importorskip("duckdb")
    for a, b in itertools.product(["", "a", "martha", "marhta", "dwayne", "abcdabcd"], repeat=2):
        assert abs(S.jaro_winkler(a, b) - duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]) < 1e-9, (a, b)


def test_scores_of_a_batch_equal_those_one_by_one():
    rnd = random.Random(2)
    for most in (4, 30, 150):
        a, b = (["".join(rnd.choice("abcé d") for _ in range(rnd.randint(0, most))) for _ in range(120)] for _ in range(2))
        b[::5] = [x[1:] + "q" for x in a[::5]]
        for kind, one in S.SCORERS.items():
            assert S.distinct_scores(kind, a, b).tolist() == [one(x, y) for x, y in zip(a, b, strict=True)], (kind, most)


def test_partial_ratio_takes_stretches_at_the_end_whose_last_letter_is_foreign():
    assert S.partial_ratio("dd bad ", "ccccaa") == 2 / 9


def test_sides_are_normalised_once_and_texts_not_split_whole(spark):
    d = "/root/testdata/sf0.001"
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (Q.candidates(spark, d), Q.records(spark, d).select("business_name"))]
    assert "InMemoryRelation" in plans[0] and ", 14)" in plans[1]


def test_trigram_route_over_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "Q_BLOCK", 3)
    monkeypatch.setattr(B, "T_BLOCK", 4)
    rnd = random.Random(4)
    names = {f"S{1 + k % 3}-{k}": ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))), rnd.choice(["en", "fr", None])) for k in range(60)}
    rows = spark.createDataFrame([(k, *v) for k, v in names.items()], "entity_id string, n_nospace string, country string")
    q, t = R.split_sides(rows)
    grams = {k: {n[i : i + 3] for i in range(len(n) - 2)} for k, (n, _) in names.items()}
    df = {(c, g): sum(g in grams[k] and names[k][1] == c and k[:2] != "S1" for k in names) for c in ("en", "fr") for v in grams.values() for g in v}
    want = set()
    for x in names:
        c = names[x][1]
        near = [(-round(sum(1 / np.log2(df[c, g] + 1) for g in both if df[c, g] <= 9), 4), y) for y in names if x[:2] == "S1" != y[:2] and c and names[y][1] == c and (both := grams[x] & grams[y])]
        want |= {(x, y, -s) for s, y in sorted(n for n in near if n[0])[:2]}
    assert want and {(r.q, r.t, r.score) for r in B.trigram_route(q, t, 9, 2).collect()} == want


def test_relative_gap_of_long_numbers_rounds_like_the_sql_engine(spark, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    nums = [("76", "4084813917494277"), ("59", "4440927036883001"), ("78", "4870111250876269"), ("3", "4084813917494277"), ("8", "9"), ("640000", "640003"), ("12", "5"), ("7", ""), ("1", "9007199254740993")]
    rows = [(f"S1-{k}", f"S2-{k}", *n) for k, n in enumerate(nums)]
    monkeypatch.setattr(Q, "text_pairs", lambda spark, d: spark.createDataFrame(rows, "s1_id string, cand_id string, q_a_num string, t_a_num string"))
    got = {r.s1_id: r.num_reldiff for r in Q.number_relation(spark, "").collect()}
    for s1_id, _, q, t in rows:
        sql = "SELECT round(abs(?::BIGINT - ?::BIGINT) / ?::BIGINT::DOUBLE, 6)"
        assert got[s1_id] == (duckdb.execute(sql, [q, t, q]).fetchone()[0] if q and t else None), (q, t)


def test_sibling_route_shuffles_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(B, "NAME_BLOCK", 4, raising=False)
    names = {f"S2-{k}": ("en" if k % 5 else "de", "abc"[k % 3] if k < 40 else "" if k < 44 else f"one{k}") for k in range(48)}
    t = spark.createDataFrame([(e, c, n) for e, (c, n) in names.items()], "entity_id string, country string, n_nospace string")
    cands = [(names[x][0], f"S1-{q}", x) for q in range(6) for x in (f"S2-{5 * q}", f"S2-{q + 1}", f"S2-{q + 4}", f"S2-{q + 40}")]
    got = B.sibling_route(spark.createDataFrame(cands, "country string, q string, t string"), t)
    known = {(q, x) for _, q, x in cands}
    want = {(c, q, y) for c, q, x in cands for y, (land, n) in names.items() if n and (land, n) == names[x] and (q, y) not in known}
    rows = [(r.country, r.q, r.t) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = next(i for i, x in enumerate(plan) if "Generate explode" in x or "LeftAnti" in x or "Aggregate" in x)
    assert "Generate explode" in plan[made]


def test_compound_features_return_what_number_tokens_and_units_say(spark, tmp_path):
    name, streets = "alpha beta gamma delta epsilon zeta", ["flat 7 on 5/101 lake road", "flat 7 on 5/101 lake road", "flat 8 on 5-102 lake road", "door 7 x 9 lake road"]
    rows = [(k, f"{name} {x}", "en") for k, x in zip((0, 1, 2, 97 + 1), streets, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = Q.compound_features(spark, str(tmp_path))
    got = {r.cand_id: tuple(r)[2:] for r in out.where("s1_id = 'S1-0'").collect()}
    # Number tokens: S1-0 1 5/101 7; S2-1 2 5/101 7; S3-2 3 5-102 8; S3-98 2 7 9.
    assert got == {"S2-1": (0.5, 1, 1, 1, 0, 1, 0, 0, 0), "S3-2": (0.0, 3, 3, 0, 1, 0, 1, 0, 0), "S3-98": (0.2, 2, 2, 0, 0, 1, 0, 0, 0)}
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = c.sql(SQL["compound_features"])
        assert want.columns == out.columns and sorted(want.fetchall()) == sorted(map(tuple, out.collect()))
