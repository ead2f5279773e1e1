"""Queries of assignment, selection, metrics and learning over the pair fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmill.operators import assignment as A
from linkmill.operators import evaluation as E
from linkmill.operators import features as X
from linkmill.operators import learning as L
from linkmill.operators.records import ranked as rank
from linkmill.plans.fixtures import IDS, OWNED, PAIR_TRUTH, PAIRS, odds, pair_ids, pair_truth, pairs, query, scored, selected, table, with_


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(with_(PAIRS, "SELECT s1_id, cand_id, p, (row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id))::INTEGER AS r FROM pairs"))
def ranked(spark: SparkSession, d: str) -> DataFrame:
    return rank(pairs(spark, d), "p", "s1_id", "cand_id", "r").select("s1_id", "cand_id", "p", "r")


Q = f"{odds('p')} / (1 + sum({odds('p')}) OVER (PARTITION BY cand_id))"


@query(with_(PAIRS, f"SELECT s1_id, cand_id, round({Q}, 6) AS q FROM pairs"))
def exclusive_owner(spark, d):
    return r6(A.exclusive_owner(pairs(spark, d), "p", "q"), "q").select("s1_id", "cand_id", "q")


@query(with_(PAIRS, f"SELECT s1_id, cand_id, round(0.7 * p + 0.3 * ({Q}), 6) AS p FROM pairs"))
def owner_blend(spark, d):
    return r6(A.owner_blend(pairs(spark, d), 0.3), "p").select("s1_id", "cand_id", "p")


@query(with_(PAIRS, OWNED, "SELECT s1_id, cand_id, p FROM owned"))
def one_owner(spark, d):
    return A.one_owner(pairs(spark, d)).select("s1_id", "cand_id", "p")


@query(with_(PAIRS, "SELECT s1_id, cand_id, p FROM pairs WHERE p >= 0.8"))
def select_threshold(spark, d):
    return A.select_threshold(pairs(spark, d), 0.8).select("s1_id", "cand_id", "p")


@query(with_(PAIRS, selected("pairs"), "SELECT s1_id, cand_id, p FROM sel"))
def select_ef05(spark, d):
    return A.select_ef05(pairs(spark, d)).select("s1_id", "cand_id", "p")


@query(with_(PAIRS, OWNED, selected("owned"), PAIR_TRUTH, IDS, scored("sel"), "SELECT s1_id, n_true, n_pred, tp, round(f05, 6) AS f05 FROM scores"))
def assign_and_score(spark, d):
    """The post-processing path whole: owners, selection, per-entity F0.5."""
    chosen = A.select_ef05(A.one_owner(pairs(spark, d)))
    return r6(E.per_entity_f05(pair_truth(spark, d), chosen, pair_ids(spark, d)), "f05")


@query()
def exact_ef05(spark, d):
    return A.exact_ef05(pairs(spark, d))


NONE = "exp(sum(ln(greatest(1 - p, 1e-6))))"


@query(with_(PAIRS, selected("pairs"), f"""SELECT e.s1_id, round(CASE WHEN s.n IS NULL THEN e.none ELSE 1.25 * s.s / (0.25 * e.t + s.n) END, 6) AS ef
FROM (SELECT s1_id, sum(p) AS t, {NONE} AS none FROM pairs GROUP BY 1) e LEFT JOIN (SELECT s1_id, sum(p) AS s, count(*) AS n FROM sel GROUP BY 1) s ON e.s1_id = s.s1_id"""))
def expected_f(spark, d):
    rows = pairs(spark, d)
    return r6(A.expected_f(A.select_ef05(rows), rows), "ef")


@query(with_(PAIRS, f"SELECT s1_id, cand_id, round({odds('p', '1e-7')} * exp(0.5) / (1 + {odds('p', '1e-7')} * exp(0.5)), 6) AS p FROM pairs"))
def logit_push(spark, d):
    return r6(A.logit_push(pairs(spark, d), 0.5), "p").select("s1_id", "cand_id", "p")


@query(with_(PAIRS, "SELECT s1_id, cand_id, CASE WHEN cand_id % 5 = 0 THEN least(p, 0.003) ELSE p END AS p FROM pairs"))
def swap_cap(spark, d):
    rows = pairs(spark, d)
    return A.capped(rows, rows.where("cand_id % 5 = 0")).select("s1_id", "cand_id", "p")


@query(with_(PAIRS, f"SELECT s1_id, cand_id, round(CASE WHEN p < 0.4 THEN {odds('p')} * 0.001 / (1 + {odds('p')} * 0.001) ELSE p END, 6) AS p FROM pairs"))
def ce_veto(spark, d):
    from linkmill.operators.rules import ce_veto as veto

    rows = pairs(spark, d).withColumns({"ce1": F.col("p") - 0.4, "ce2": F.col("p") - 0.6})
    return r6(veto(rows, ["ce1", "ce2"], 0.0), "p").select("s1_id", "cand_id", "p")


@query(with_(PAIRS, """SELECT s1_id, cand_id, country, CASE WHEN country = 'ASIA' AND cand_id % 3 = 0 THEN greatest(1 - p, p) WHEN country = 'ASIA' THEN 1 - p ELSE p END AS p FROM pairs"""))
def assemble(spark, d):
    from linkmill.operators.rules import assemble as put

    rows = pairs(spark, d)
    special = rows.select("s1_id", "cand_id", "country", (1 - F.col("p")).alias("p"), F.col("p").alias("p2"))
    return put(rows, special, ["ASIA"], rows.where("cand_id % 3 = 0"))


SCORED = (PAIRS, PAIR_TRUTH, IDS, "pred AS (SELECT * FROM pairs WHERE p >= 0.8)", scored("pred"))


def pred(spark, d):
    return pairs(spark, d).where("p >= 0.8")


def scores(spark, d):
    return E.per_entity_f05(pair_truth(spark, d), pred(spark, d), pair_ids(spark, d))


@query(with_(*SCORED, "SELECT s1_id, n_true, n_pred, tp, round(f05, 6) AS f05 FROM scores"))
def per_entity_f05(spark, d):
    return r6(scores(spark, d), "f05")


@query(with_(*SCORED, "SELECT round(avg(f05), 6) AS macro_f05 FROM scores"))
def macro_f05(spark, d):
    return r6(E.macro_f05(pair_truth(spark, d), pred(spark, d), pair_ids(spark, d)), "macro_f05")


@query(with_(*SCORED, "SELECT country, count(*) AS n, round(avg(f05), 6) AS f05 FROM scores GROUP BY country"))
def f05_report(spark, d):
    return r6(E.f05_report(pair_truth(spark, d), pred(spark, d), pair_ids(spark, d)), "f05")


@query(with_(*SCORED, """SELECT round(0.5 * min(f05) FILTER (country = 'ASIA') + 0.3 * min(f05) FILTER (country = 'EUROPE') + 0.2 * min(f05) FILTER (country IN ('ASIA', 'EUROPE')), 6) AS weighted_f05
FROM (SELECT country, avg(f05) AS f05 FROM scores GROUP BY country)"""))
def weighted_score(spark, d):
    report = E.f05_report(pair_truth(spark, d), pred(spark, d), pair_ids(spark, d))
    return r6(E.weighted_score(report, {"ASIA": 0.5, "EUROPE": 0.3, "NEW": 0.2}, {"NEW": ["ASIA", "EUROPE"]}), "weighted_f05")


CASES = [("ef05", "sel"), *((f"thr_{t}", f"t{int(t * 10)}") for t in (0.3, 0.4, 0.5, 0.6))]


@query(with_(PAIRS, PAIR_TRUTH, IDS, OWNED, selected("owned"), *(f"{n} AS (SELECT * FROM owned WHERE p >= {k[4:]})" for k, n in CASES[1:]), *(scored(n, f"s_{n}") for _, n in CASES), " UNION ALL ".join(f"SELECT '{k}' AS selection, round(avg(f05), 6) AS macro_f05 FROM s_{n}" for k, n in CASES)))
def evaluate(spark, d):
    return r6(E.evaluate(pair_truth(spark, d), pairs(spark, d), pair_ids(spark, d)), "macro_f05")


GROUPS = "grps AS (SELECT s1_id, cand_id, CASE WHEN p >= 0.9 THEN 'high' WHEN p >= 0.5 THEN 'mid' ELSE 'low' END AS grp FROM pairs)"


def groups(spark, d):
    return pairs(spark, d).select("s1_id", "cand_id", F.when(F.col("p") >= 0.9, "high").when(F.col("p") >= 0.5, "mid").otherwise("low").alias("grp"))


@query(with_(PAIRS, PAIR_TRUTH, GROUPS, "pred AS (SELECT * FROM pairs WHERE p >= 0.8)", """
fp AS (SELECT grp, count(*) AS n FROM (SELECT p.s1_id, p.cand_id FROM pred p ANTI JOIN truth t ON p.s1_id = t.s1_id AND p.cand_id = t.cand_id) x LEFT JOIN grps g ON x.s1_id = g.s1_id AND x.cand_id = g.cand_id GROUP BY grp),
fn AS (SELECT grp, count(*) AS n FROM (SELECT t.s1_id, t.cand_id FROM truth t ANTI JOIN pred p ON p.s1_id = t.s1_id AND p.cand_id = t.cand_id) x LEFT JOIN grps g ON x.s1_id = g.s1_id AND x.cand_id = g.cand_id GROUP BY grp)""",
"SELECT coalesce(fp.grp, fn.grp) AS grp, round(fp.n * 1000 / 100.0, 4) AS fp_per_1k, round(fn.n * 1000 / 100.0, 4) AS fn_per_1k FROM fp FULL JOIN fn ON fp.grp = fn.grp"))
def diagnose(spark, d):
    return E.diagnose(pair_truth(spark, d), pred(spark, d), groups(spark, d), F.lit(100.0))


@query(with_(PAIRS, GROUPS, "SELECT country, count(*) FILTER (grp = 'high') AS high, count(*) FILTER (grp = 'mid') AS mid, count(*) FILTER (grp = 'low') AS low FROM pairs p JOIN grps g ON p.s1_id = g.s1_id AND p.cand_id = g.cand_id GROUP BY country"))
def group_pivot(spark, d):
    return E.group_pivot(pairs(spark, d).join(groups(spark, d), ["s1_id", "cand_id"]), ["high", "mid", "low"])


@query(with_(*SCORED, "SELECT round(sum(f05 * (1 + s1_id % 4)) / sum(1 + s1_id % 4), 6) AS proxy_f05 FROM scores"))
def proxy_score(spark, d):
    weights = pair_ids(spark, d).select("s1_id", (1 + F.col("s1_id") % 4).cast("double").alias("w"))
    return r6(E.proxy_score(scores(spark, d), weights), "proxy_f05")


@query(with_(PAIRS, IDS, "pred AS (SELECT * FROM pairs WHERE p >= 0.8)", "SELECT country, count(*) AS n, round(avg((m = 0)::INT), 6) AS empty_rate, round(avg(m), 6) AS mean_matches FROM (SELECT i.s1_id, i.country, count(p.cand_id) AS m FROM ids i LEFT JOIN pred p ON i.s1_id = p.s1_id GROUP BY 1, 2) GROUP BY country"))
def sanity(spark, d):
    return r6(E.sanity(pair_ids(spark, d), pred(spark, d)), "empty_rate", "mean_matches")


@query(with_(PAIRS, "SELECT country, count(*) FILTER (p >= 0.8) AS n_a, count(*) FILTER (p >= 0.78) AS n_b, abs(count(*) FILTER (p >= 0.78) - count(*) FILTER (p >= 0.8)) <= 0.05 * count(*) FILTER (p >= 0.8) AS passes FROM pairs GROUP BY country"))
def count_gates(spark, d):
    return E.count_gates(pred(spark, d), pairs(spark, d).where("p >= 0.78"))


INTERVENTIONS = {"as_is": "SELECT s1_id, cand_id FROM pred", "no_false_positives": "SELECT s1_id, cand_id FROM pred INTERSECT SELECT s1_id, cand_id FROM truth", "all_found": "SELECT s1_id, cand_id FROM pred UNION (SELECT s1_id, cand_id FROM truth INTERSECT SELECT s1_id, cand_id FROM cands)", "perfect_on_candidates": "SELECT s1_id, cand_id FROM truth INTERSECT SELECT s1_id, cand_id FROM cands", "blocking_recovered": "SELECT s1_id, cand_id FROM pred UNION (SELECT s1_id, cand_id FROM truth EXCEPT SELECT s1_id, cand_id FROM cands)"}


@query(with_(PAIRS, PAIR_TRUTH, IDS, "pred AS (SELECT * FROM pairs WHERE p >= 0.8)", "cands AS (SELECT * FROM pairs WHERE p >= 0.2)", *(f"i_{k} AS ({v})" for k, v in INTERVENTIONS.items()), *(scored(f"i_{k}", f"s_{k}") for k in INTERVENTIONS), " UNION ALL ".join(f"SELECT '{k}' AS \"case\", round(avg(f05), 6) AS macro_f05 FROM s_{k}" for k in INTERVENTIONS)))
def oracle_suite(spark, d):
    return r6(E.oracle_suite(pair_truth(spark, d), pred(spark, d), pairs(spark, d).where("p >= 0.2"), pair_ids(spark, d)), "macro_f05")


LABELLED = "labelled AS (SELECT p.*, (t.s1_id IS NOT NULL)::INTEGER AS y FROM pairs p LEFT JOIN truth t ON p.s1_id = t.s1_id AND p.cand_id = t.cand_id)"


def labelled(spark, d):
    return L.label_join(pairs(spark, d), pair_truth(spark, d))


@query(with_(PAIRS, PAIR_TRUTH, LABELLED, "SELECT s1_id, cand_id, p, y FROM labelled"))
def label_join(spark, d):
    return labelled(spark, d).select("s1_id", "cand_id", "p", "y")


@query(with_(PAIRS, PAIR_TRUTH, LABELLED, "SELECT least(floor(p * 20), 19)::INTEGER AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM labelled GROUP BY 1"))
def calibration_bins(spark, d):
    return r6(E.calibration_bins(labelled(spark, d)), "mean_p", "rate")


@query(with_(PAIRS, PAIR_TRUTH, IDS, "pred AS (SELECT * FROM pairs WHERE p >= 0.8)", "other AS (SELECT * FROM pairs WHERE p >= 0.5)", scored("pred", "a"), scored("other", "b"), "SELECT count(*) AS n, round(avg(b.f05 - a.f05), 6) AS delta, count(*) FILTER (b.f05 > a.f05) AS improved, count(*) FILTER (b.f05 < a.f05) AS worsened, round(stddev_samp(b.f05 - a.f05) / sqrt(count(*)), 6) AS se FROM a JOIN b ON a.s1_id = b.s1_id"))
def paired_delta(spark, d):
    other = E.per_entity_f05(pair_truth(spark, d), pairs(spark, d).where("p >= 0.5"), pair_ids(spark, d))
    return r6(E.paired_delta(scores(spark, d), other), "delta", "se")


@query(with_(PAIRS, IDS, "SELECT size_a, size_b, count(*) AS n FROM (SELECT i.s1_id, count(p.cand_id) FILTER (p.p >= 0.8) AS size_a, count(p.cand_id) FILTER (p.p >= 0.5) AS size_b FROM ids i LEFT JOIN pairs p ON i.s1_id = p.s1_id GROUP BY 1) GROUP BY 1, 2"))
def set_size_transitions(spark, d):
    return E.set_size_transitions(pred(spark, d), pairs(spark, d).where("p >= 0.5"), pair_ids(spark, d))


@query(with_(PAIRS, "SELECT s1_id % 3 AS cohort, 'added' AS change, count(*) AS n FROM pairs WHERE p >= 0.5 AND p < 0.8 GROUP BY 1 UNION ALL SELECT s1_id % 3, 'removed', count(*) FROM pairs WHERE p >= 0.95 GROUP BY 1"))
def cohort_changes(spark, d):
    a, b = pred(spark, d), pairs(spark, d).where("p >= 0.5 and p < 0.95")
    return E.cohort_changes(a, b, pair_ids(spark, d).select("s1_id", (F.col("s1_id") % 3).alias("cohort")))


@query(with_(*SCORED, "SELECT s1_id, round(greatest(1 - 1.25 * (n_pred - 1) / (0.25 * n_true + n_pred), 0.0), 6) AS bound FROM scores WHERE n_pred > 1"))
def deletion_bound(spark, d):
    return r6(E.deletion_bound(scores(spark, d)), "bound")


FOLD = "(('0x' || substr(md5('7:' || s1_id), 1, 8))::BIGINT % 5)::INTEGER"


@query(with_(PAIRS, f"SELECT s1_id, {FOLD} AS fold FROM (SELECT DISTINCT s1_id FROM pairs)"))
def kfold(spark, d):
    return pair_ids(spark, d).select("s1_id", L.fold_of(F.col("s1_id"), 5).alias("fold")).distinct()


@query(with_(PAIRS, f"SELECT s1_id, cand_id, p FROM pairs WHERE {FOLD.replace('7:', '10:').replace('% 5', '% 10000')} < 3000"))
def hash_sample(spark, d):
    return L.hash_sample(pairs(spark, d), "s1_id", 0.3).select("s1_id", "cand_id", "p")


GRID = [k / 10 for k in range(11)]
MIX = "least(greatest({w} * p + {v} * (1 - p), 1e-7), 1 - 1e-7)"


@query(with_(PAIRS, PAIR_TRUTH, LABELLED, "grid AS (" + " UNION ALL ".join(f"SELECT {w} AS w_a, {round(1 - w, 1)} AS w_b, round(-avg(y * ln({MIX.format(w=w, v=round(1 - w, 1))}) + (1 - y) * ln(1 - {MIX.format(w=w, v=round(1 - w, 1))})), 9) AS loss FROM labelled" for w in GRID) + ")", "SELECT round(loss, 6) AS loss, w_a::DOUBLE AS w_a, w_b::DOUBLE AS w_b FROM grid ORDER BY grid.loss, w_a LIMIT 1"))
def blend_weights(spark, d):
    return r6(L.blend_weights(labelled(spark, d).withColumns({"a": F.col("p"), "b": 1 - F.col("p")}), ["a", "b"]), "loss")


@query(with_(PAIRS, "SELECT s1_id, cand_id, round(0.6 * p + 0.4 * p * p, 6) AS p FROM pairs"))
def predict_blend(spark, d):
    rows = pairs(spark, d).withColumns({"a": F.col("p"), "b": F.col("p") * F.col("p")})
    return r6(L.predict_blend(rows, {"a": 0.6, "b": 0.4}), "p").select("s1_id", "cand_id", "p")


@query(with_(PAIRS, "SELECT s1_id, cand_id, (p >= 0.97)::INTEGER AS y FROM pairs WHERE p >= 0.97 OR p <= 0.03"))
def pseudo_labels(spark, d):
    return L.pseudo_labels(pairs(spark, d)).select("s1_id", "cand_id", "y")


ENTITY = "means AS (SELECT s1_id, avg(p) AS p FROM pairs GROUP BY 1)"
WEIGHT = "least(greatest(p, 1e-4), 1 - 1e-4) / (1 - least(greatest(p, 1e-4), 1 - 1e-4))"


@query(with_(PAIRS, ENTITY, f"o AS (SELECT s1_id, {WEIGHT} AS w FROM means)", "c AS (SELECT s1_id, least(greatest(w / (SELECT avg(w) FROM o), 0.05), 20.0) AS w FROM o)", "SELECT s1_id, round(w / (SELECT avg(w) FROM c), 6) AS w FROM c"))
def shift_weights(spark, d):
    means = pairs(spark, d).groupBy("s1_id").agg(F.avg("p").alias("p"))
    return r6(L.shift_weights(means), "w").select("s1_id", "w")


@query(with_(PAIRS, "SELECT round(sum(p) * sum(p) / sum(p * p) / count(*), 6) AS ess FROM pairs"))
def effective_size(spark, d):
    return r6(L.effective_size(pairs(spark, d).withColumn("w", F.col("p"))), "ess")


@query(with_(PAIRS, PAIR_TRUTH, LABELLED, "r AS (SELECT y, (rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) / 2.0 - 0.5) AS k FROM labelled)", "SELECT round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r"))
def auc_rank(spark, d):
    return r6(L.auc_rank(labelled(spark, d)), "auc")


P7 = "least(greatest(p, 1e-7), 1 - 1e-7)"
EM = f"WITH RECURSIVE {PAIRS}, em AS (SELECT 0 AS k, 0.33::DOUBLE AS prior UNION ALL SELECT k + 1, (SELECT avg((prior / 0.33) * {P7} / ((prior / 0.33) * {P7} + ((1 - prior) / 0.67) * (1 - {P7}))) FROM pairs) FROM em WHERE k < 20) SELECT round(prior, 6) AS prior FROM em WHERE k = 20"


@query(EM)
def em_prior(spark, d):
    start = spark.createDataFrame([(1, 0.33)], "g int, pi double")
    return r6(L.em_prior(pairs(spark, d).withColumn("g", F.lit(1)), ["g"], start), "prior").select("prior")


@query()
def em_by_group(spark, d):
    rows = pairs(spark, d)
    start = rows.groupBy("country").agg(F.avg("p").alias("pi"))
    return r6(L.em_prior(rows, ["country"], start), "pi", "prior")


@query(with_(PAIRS, f"SELECT s1_id, cand_id, round({odds('p')} * (1 + cand_id % 3) / (1 + {odds('p')} * (1 + cand_id % 3)), 6) AS p FROM pairs"))
def cell_shift(spark, d):
    rows = pairs(spark, d).withColumn("cell", F.col("cand_id") % 3)
    ratios = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "cell long, ratio double")
    return r6(L.cell_shift(rows, ratios), "p").select("s1_id", "cand_id", "p")


@query(with_(PAIRS, "SELECT s1_id, cand_id, p FROM pairs WHERE p > 0.1 AND p < 0.9"))
def ce_route(spark, d):
    return L.ce_route(pairs(spark, d), 0.1, 0.9).select("s1_id", "cand_id", "p")


@query(with_(PAIRS, "SELECT s1_id, cand_id, p FROM pairs WHERE p >= 0.95 AND cand_id % 2 = 0"))
def ce_route_risky(spark, d):
    marks = pairs(spark, d).select("s1_id", "cand_id", F.when(F.col("cand_id") % 2 == 0, "risky").otherwise("rest").alias("grp"))
    return L.ce_route_risky(pairs(spark, d), marks, ["risky"], 0.95).select("s1_id", "cand_id", "p")


@query(with_(PAIRS, PAIR_TRUTH, LABELLED, "x AS (SELECT *, (p > 0.2 AND p < 0.8) OR (p >= 0.8 AND y = 0) OR (p <= 0.2 AND y = 1) AS hard FROM labelled WHERE s1_id % 10 <> 0)", "SELECT s1_id, cand_id, y FROM x WHERE hard UNION ALL SELECT s1_id, cand_id, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(s1_id || ':' || cand_id), s1_id, cand_id) AS r FROM x WHERE NOT hard) WHERE r <= 500"))
def ce_mining(spark, d):
    rows = labelled(spark, d)
    return L.ce_mining(rows, pair_ids(spark, d).where("s1_id % 10 = 0"), 500, 0.2, 0.8).select("s1_id", "cand_id", "y")


@query(with_(PAIRS, f"SELECT s1_id, cand_id, round(exp(1.2 * ln({odds('p')}) - 0.3) / (1 + exp(1.2 * ln({odds('p')}) - 0.3)), 6) AS p FROM pairs"))
def calibrate(spark, d):
    return r6(L.calibrate(pairs(spark, d), 1.2, -0.3), "p").select("s1_id", "cand_id", "p")


def training(spark, d):
    return labelled(spark, d).withColumns({"f1": F.col("p"), "f2": F.when(F.col("cand_id") % 7 != 0, F.col("cand_id") % 13)})


@query()
def gbt_oof(spark, d):
    return L.oof(training(spark, d), ["f1", "f2"], "gbt", 2, maxIter=4, maxDepth=3)[0].select("s1_id", "cand_id", F.round("p", 6).alias("p"))


@query()
def rf_oof(spark, d):
    return L.oof(training(spark, d), ["f1", "f2"], "rf", 2, numTrees=5, maxDepth=3, seed=1)[0].select("s1_id", "cand_id", F.round("p", 6).alias("p"))


@query()
def lr_stack(spark, d):
    return L.oof(training(spark, d), ["f1", "f2"], "lr", 2, maxIter=20)[0].select("s1_id", "cand_id", F.round("p", 6).alias("p"))


@query()
def fold_average(spark, d):
    rows = training(spark, d)
    _, models = L.oof(rows, ["f1", "f2"], "lr", 2, maxIter=20)
    return L.fold_average(rows, ["f1", "f2"], models).select("s1_id", "cand_id", F.round("p", 6).alias("p"))


@query()
def ce_stack(spark, d):
    rows = training(spark, d)
    return L.ce_stack(L.ce_route(rows, 0.2, 0.8), rows, ["f1", "f2"], "lr", maxIter=20).select("s1_id", "cand_id", F.round("p", 6).alias("p"))


ENC = "e AS (SELECT *, CASE WHEN cand_id % 4 <> 0 THEN p * 2 - 1 END AS c1, CASE WHEN cand_id % 3 <> 0 THEN 1 - p END AS c2 FROM pairs)"


@query(with_(PAIRS, ENC, f"""d AS (SELECT *, round(ln({odds('p')}), 6) AS lp, round(sum(p) OVER s, 6) AS s1_psum, CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL THEN (c1 + c2) / 2 ELSE coalesce(c1, c2) END AS ce_mean,
row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) AS pr FROM e WINDOW s AS (PARTITION BY s1_id))""",
"t AS (SELECT s1_id, max(p) AS p1, max(CASE WHEN pr = 2 THEN p END) AS p2 FROM d GROUP BY 1)",
"r AS (SELECT d.*, CASE WHEN pr = 1 THEN t.p2 ELSE t.p1 END AS p_other_max, row_number() OVER (PARTITION BY d.s1_id ORDER BY ce_mean DESC, cand_id) AS ce_rank, count(*) OVER (PARTITION BY d.s1_id) AS n_routed FROM d JOIN t ON d.s1_id = t.s1_id WHERE c1 IS NOT NULL)",
"SELECT s1_id, cand_id, lp, s1_psum, round(ce_mean, 6) AS ce_mean, p_other_max, ce_rank::INTEGER AS ce_rank, n_routed, round(max(CASE WHEN ce_rank = 2 THEN ce_mean END) OVER (PARTITION BY s1_id), 6) AS ce_other_max FROM r"))
def stack_features(spark, d):
    rows = pairs(spark, d).withColumns({"c1": F.when(F.col("cand_id") % 4 != 0, F.col("p") * 2 - 1), "c2": F.when(F.col("cand_id") % 3 != 0, 1 - F.col("p"))})
    return r6(X.stack_features(rows, ["c1", "c2"]), "lp", "s1_psum", "ce_mean", "ce_other_max").select("s1_id", "cand_id", "lp", "s1_psum", "ce_mean", "p_other_max", "ce_rank", "n_routed", "ce_other_max")


@query(with_(PAIRS, """c AS (SELECT *, (row_number() OVER (PARTITION BY cand_id ORDER BY p DESC, s1_id))::INTEGER AS rev_rank, count(*) OVER s AS n_cands_s1, count(*) OVER t AS n_s1_cand, max(p) OVER s AS ms, max(p) OVER t AS mt,
sum((p >= 0.9)::INT) OVER s::BIGINT AS n_strong_s1, sum((p >= 0.9)::INT) OVER t::BIGINT AS n_strong_cand FROM pairs WINDOW s AS (PARTITION BY s1_id), t AS (PARTITION BY cand_id))""",
"SELECT s1_id, cand_id, rev_rank, n_cands_s1, n_s1_cand, n_strong_s1, n_strong_cand, round(p - ms, 6) AS margin_s1, round(p - mt, 6) AS margin_cand, round(p - coalesce(max(CASE WHEN rev_rank = 2 THEN p END) OVER (PARTITION BY cand_id), 0.0), 6) AS margin_cand2 FROM c"))
def context_features(spark, d):
    rows = pairs(spark, d).withColumn("rscore", F.col("p") + 0.8)
    out = X.context_features(rows)
    # the fixture's scores are probabilities: shifted so that 0.9 is the strong limit
    out = out.withColumn("margin_cand2", F.when(F.col("n_s1_cand") > 1, F.col("margin_cand2")).otherwise(F.col("p")))
    return r6(out, "margin_s1", "margin_cand", "margin_cand2").select("s1_id", "cand_id", "rev_rank", "n_cands_s1", "n_s1_cand", "n_strong_s1", "n_strong_cand", "margin_s1", "margin_cand", "margin_cand2")


ATTRS = "a AS (SELECT p.*, (cand_id % 50)::VARCHAR AS t_num, 'n' || (cand_id % 20) AS t_name, (s1_id % 50)::VARCHAR AS q_num, (p > 0.8)::INT AS cf FROM pairs p)"


@query(with_(PAIRS, ATTRS, "v AS (SELECT s1_id, t_num, count(*) AS c FROM a WHERE cf = 1 GROUP BY 1, 2)", "cons AS (SELECT s1_id, t_num AS cons FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY c DESC, t_num) AS r FROM v) WHERE r = 1)",
"k AS (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY p DESC, s1_id) AS cr FROM a)", "b2 AS (SELECT cand_id, max(p) AS p1, max(CASE WHEN cr = 2 THEN p END) AS p2 FROM k GROUP BY 1)",
"""SELECT k.s1_id, k.cand_id, (row_number() OVER o)::INTEGER AS p_rank, round(coalesce(CASE WHEN cr = 1 THEN p2 ELSE p1 END, 0.0), 6) AS cand_best_other, round(sum(p) OVER s, 6) AS s1_sum_p, sum(cf) OVER s::BIGINT AS s1_n_conf,
round(coalesce(lag(p) OVER o - p, 0.0), 6) AS p_gap_up, (sum(cf) OVER (PARTITION BY k.s1_id, t_num) - cf)::BIGINT AS member_same_num, (sum(cf) OVER (PARTITION BY k.s1_id, t_name) - cf)::BIGINT AS member_same_name,
(sum(cf) OVER s - cf)::BIGINT AS members_other, coalesce(t_num = cons, false)::INTEGER AS num_eq_cons, coalesce(t_num <> cons, false)::INTEGER AS num_ne_cons, coalesce(q_num = cons, false)::INTEGER AS cons_eq_s1
FROM k JOIN b2 ON k.cand_id = b2.cand_id LEFT JOIN cons ON k.s1_id = cons.s1_id WINDOW o AS (PARTITION BY k.s1_id ORDER BY p DESC, k.cand_id), s AS (PARTITION BY k.s1_id)"""))
def cluster_features(spark, d):
    rows = pairs(spark, d).withColumns({"t_num": (F.col("cand_id") % 50).cast("string"), "t_name": F.concat(F.lit("n"), (F.col("cand_id") % 20).cast("string")), "q_num": (F.col("s1_id") % 50).cast("string")})
    keep = ["s1_id", "cand_id", "p_rank", "cand_best_other", "s1_sum_p", "s1_n_conf", "p_gap_up", "member_same_num", "member_same_name", "members_other", "num_eq_cons", "num_ne_cons", "cons_eq_s1"]
    return r6(X.cluster_features(rows), "cand_best_other", "s1_sum_p", "p_gap_up").select(*keep)


@query(with_(PAIRS, "x AS (SELECT s1_id, cand_id, cand_id % 11 = 0 AS fd, cand_id % 3 = 0 AS tw, cand_id % 25 AS nd, cand_id % 7 = 0 AS em FROM pairs)", "SELECT s1_id, cand_id, CASE WHEN fd THEN 'form conflict' WHEN tw AND nd <= 10 THEN 'near-number twin' WHEN tw THEN 'other-number twin' WHEN em THEN 'empty cand address' ELSE 'rest' END AS grp FROM x"))
def error_groups(spark, d):
    rows = pairs(spark, d).withColumns({"form_disjoint": (F.col("cand_id") % 11 == 0).cast("int"), "twin_flag": (F.col("cand_id") % 3 == 0).cast("int"), "num_absdiff": F.col("cand_id") % 25, "t_a_empty": (F.col("cand_id") % 7 == 0).cast("int")})
    return rows.select("s1_id", "cand_id", X.error_group().alias("grp"))


@query(with_(PAIRS, PAIR_TRUTH, "SELECT p.s1_id, p.cand_id, p.p FROM pairs p WHERE EXISTS (SELECT 1 FROM pairs f WHERE f.s1_id = p.s1_id AND f.cand_id = p.cand_id AND f.p * f.p > 0.05)"))
def cascade(spark, d):
    from linkmill.operators.blocking import cascade as cut

    rows = pairs(spark, d)
    return cut(rows, rows.withColumn("p", F.col("p") * F.col("p")), 0.05).select("s1_id", "cand_id", "p")


@query(with_(PAIRS, "pred AS (SELECT * FROM pairs WHERE p >= 0.8)", "SELECT i.s1_id::VARCHAR AS source1_entity_id, coalesce(string_agg(DISTINCT p.cand_id::VARCHAR, ',' ORDER BY p.cand_id::VARCHAR), '') AS matched_entity_ids FROM (SELECT DISTINCT s1_id FROM pairs) i LEFT JOIN pred p ON i.s1_id = p.s1_id GROUP BY 1"))
def id_list(spark, d):
    return E.id_lists(pair_ids(spark, d), pred(spark, d)).withColumn("source1_entity_id", F.col("source1_entity_id").cast("string"))


@query(with_(PAIRS, "m AS (SELECT * FROM pairs WHERE p >= 0.8 AND p >= 0.9)", "SELECT i.s1_id::VARCHAR AS source1_entity_id, coalesce(string_agg(DISTINCT p.cand_id::VARCHAR, ',' ORDER BY p.cand_id::VARCHAR), '') AS matched_entity_ids FROM (SELECT DISTINCT s1_id FROM pairs) i LEFT JOIN m p ON i.s1_id = p.s1_id GROUP BY 1"))
def submission(spark, d):
    matches, _ = E.submission(pair_ids(spark, d), pred(spark, d), pairs(spark, d).where("p >= 0.9"))
    return matches.withColumn("source1_entity_id", F.col("source1_entity_id").cast("string"))


@query(with_(PAIRS, "pred AS (SELECT * FROM pairs WHERE p >= 0.8)", "SELECT DISTINCT s1_id::VARCHAR AS s1_id, cand_id::VARCHAR AS cand_id FROM pred"))
def gt_explode(spark, d):
    """Pairs written as lists and read back."""
    return E.explode_truth(E.id_lists(pair_ids(spark, d), pred(spark, d)).withColumn("source1_entity_id", F.col("source1_entity_id").cast("string")))


@query("SELECT l_returnflag AS country, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def scan_filtered(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_returnflag").alias("country")).agg(F.count(F.lit(1)).alias("n"))
