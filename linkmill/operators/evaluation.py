"""Metrics, diagnostics and validation (E01-E18, V01-V10, I05, I06, I10). Pairs: s1_id, cand_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["s1_id", "cand_id"]


def explode_truth(lists: DataFrame, id_col: str = "source1_entity_id", list_col: str = "matched_entity_ids") -> DataFrame:
    """Comma lists to pairs; blanks are dropped."""
    return lists.select(F.col(id_col).alias("s1_id"), F.explode(F.split(F.coalesce(list_col, F.lit("")), ",")).alias("cand_id")).withColumn("cand_id", F.trim("cand_id")).where("cand_id <> ''")


def id_lists(ids: DataFrame, pairs: DataFrame, list_col: str = "matched_entity_ids") -> DataFrame:
    """One row per entity with its distinct sorted ids, or an empty list."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("cand_id").cast("string"))), ",").alias(list_col))
    return ids.select("s1_id").distinct().join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(list_col, F.lit("")).alias(list_col))


def submission(ids: DataFrame, matches: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lists; only matches that are candidates count."""
    inside = matches.select(*KEY).join(candidates.select(*KEY), KEY, "left_semi")
    return id_lists(ids, inside), id_lists(ids, candidates, "candidate_entity_ids")


def per_entity_f05(truth: DataFrame, pred: DataFrame, ids: DataFrame) -> DataFrame:
    """One union and one aggregation instead of three joins."""
    both = truth.select(*KEY, F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(pred.select(*KEY, F.lit(0).alias("t"), F.lit(1).alias("p")))
    each = both.groupBy(*KEY).agg(F.max("t").alias("t"), F.max("p").alias("p"))
    sums = each.groupBy("s1_id").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.col("t") * F.col("p")).alias("tp"))
    x = ids.select("s1_id").distinct().join(sums, "s1_id", "left").na.fill(0, ["n_true", "n_pred", "tp"])
    return x.withColumn("f05", f05(F.col("n_true"), F.col("n_pred"), F.col("tp")))


def macro_f05(truth: DataFrame, pred: DataFrame, ids: DataFrame) -> DataFrame:
    """E02."""
    return per_entity_f05(truth, pred, ids).agg(F.avg("f05").alias("macro_f05"))


def f05_report(truth: DataFrame, pred: DataFrame, ids: DataFrame) -> DataFrame:
    """Per country. ids: s1_id, country."""
    x = per_entity_f05(truth, pred, ids).join(ids.select("s1_id", "country").distinct(), "s1_id")
    return x.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.avg("f05").alias("f05"))


def weighted_score(report: DataFrame, weights: dict[str, float], proxy: dict[str, list[str]] | None = None) -> DataFrame:
    """Weighted mean; a country without labels stands for the smallest of its proxies."""
    proxy = proxy or {}

    def score(c: str) -> Column:
        return F.min(F.when(F.col("country").isin(proxy.get(c, [c])), F.col("f05")))

    return report.agg(sum((F.lit(w) * score(c) for c, w in weights.items()), F.lit(0.0)).alias("weighted_f05"))


def f05(n_true: Column, n_pred: Column, tp: Column) -> Column:
    """Of one entity."""
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when((n_true == 0) | (n_pred == 0), 0.0).otherwise(1.25 * tp / (0.25 * n_true + n_pred))


def evaluate(truth: DataFrame, pairs: DataFrame, ids: DataFrame, thresholds=(0.3, 0.4, 0.5, 0.6)) -> DataFrame:
    """Macro F0.5 of the expected-F selection and of four thresholds after assigning owners.

    One pass: owners are assigned once, every pair is flagged for each selection, and one aggregate by entity
    counts all of them. truth has each pair once.
    """
    from linkmill.operators.assignment import flag_ef05, one_owner

    owned = flag_ef05(one_owner(pairs), "_s0")
    names = ["ef05", *(f"thr_{t}" for t in thresholds)]
    chosen = [F.col("_s0"), *(F.col("p") >= t for t in thresholds)]
    marks = [f"_c{k}" for k in range(len(names))]
    flagged = owned.select(*KEY, F.lit(0).alias("_t"), *(c.cast("int").alias(m) for c, m in zip(chosen, marks, strict=True)))
    true = truth.select(*KEY, F.lit(1).alias("_t"), *(F.lit(0).alias(m) for m in marks))
    each = flagged.unionByName(true).groupBy(*KEY).agg(F.max("_t").alias("_t"), *(F.max(m).alias(m) for m in marks))
    sums = each.groupBy("s1_id").agg(F.sum("_t").alias("_n"), *(F.sum(m).alias(f"{m}p") for m in marks), *(F.sum(F.col("_t") * F.col(m)).alias(f"{m}t") for m in marks))
    x = ids.select("s1_id").distinct().join(sums, "s1_id", "left").na.fill(0)
    means = x.agg(*(F.avg(f05(F.col("_n"), F.col(f"{m}p"), F.col(f"{m}t"))).alias(m) for m in marks))
    return means.select(F.inline(F.array(*(F.struct(F.lit(n).alias("selection"), F.col(m).alias("macro_f05")) for n, m in zip(names, marks, strict=True)))))


def diagnose(truth: DataFrame, selected: DataFrame, groups: DataFrame, n: Column) -> DataFrame:
    """False positives and negatives per 1000 entities by group. groups: s1_id, cand_id, grp."""
    fp = selected.join(truth.select(*KEY), KEY, "left_anti").join(groups, KEY, "left").groupBy("grp").agg(F.count(F.lit(1)).alias("fp"))
    fn = truth.join(selected.select(*KEY), KEY, "left_anti").join(groups, KEY, "left").groupBy("grp").agg(F.count(F.lit(1)).alias("fn"))
    return fp.join(fn, "grp", "full").select("grp", F.round(F.col("fp") * 1000 / n, 4).alias("fp_per_1k"), F.round(F.col("fn") * 1000 / n, 4).alias("fn_per_1k"))


def group_pivot(selected: DataFrame, groups: list[str]) -> DataFrame:
    """Selected pairs by country and group, groups as columns."""
    return selected.groupBy("country").pivot("grp", groups).agg(F.count(F.lit(1))).na.fill(0)


def proxy_score(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean of f05 weighted per entity."""
    x = scores.join(weights, "s1_id")
    return x.agg((F.sum(F.col("f05") * F.col("w")) / F.sum("w")).alias("proxy_f05"))


def sanity(ids: DataFrame, selected: DataFrame) -> DataFrame:
    """Per country the entities, the share without a match, and the mean number of matches."""
    n = selected.groupBy("s1_id").agg(F.count(F.lit(1)).alias("m"))
    x = ids.select("s1_id", "country").distinct().join(n, "s1_id", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return x.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("m") == 0).cast("double")).alias("empty_rate"), F.avg("m").alias("mean_matches"))


def count_gates(a: DataFrame, b: DataFrame, limit: float = 0.05) -> DataFrame:
    """Do two selections' counts per country differ by no more than a share?"""
    x = a.groupBy("country").agg(F.count(F.lit(1)).alias("n_a")).join(b.groupBy("country").agg(F.count(F.lit(1)).alias("n_b")), "country", "full").na.fill(0)
    return x.withColumn("passes", F.abs(F.col("n_b") - F.col("n_a")) <= limit * F.col("n_a"))


def oracle_suite(truth: DataFrame, selected: DataFrame, candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """Macro F0.5 as it is and after single interventions."""
    t, s, c = (x.select(*KEY).distinct() for x in (truth, selected, candidates))
    good = s.join(t, KEY, "left_semi")
    cases = {"as_is": s, "no_false_positives": good, "all_found": s.unionByName(t.join(c, KEY, "left_semi")).distinct(), "perfect_on_candidates": t.join(c, KEY, "left_semi"), "blocking_recovered": s.unionByName(t.join(c, KEY, "left_anti")).distinct()}
    out = None
    for name, pred in cases.items():
        row = macro_f05(t, pred, ids).select(F.lit(name).alias("case"), "macro_f05")
        out = row if out is None else out.unionByName(row)
    return out


def calibration_bins(pairs: DataFrame, bins: int = 20) -> DataFrame:
    """E11. pairs: p, y."""
    return pairs.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))


def paired_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two models' per-entity scores: mean difference, its standard error, improved and worsened."""
    d = F.col("b") - F.col("a")
    x = a.select("s1_id", F.col("f05").alias("a")).join(b.select("s1_id", F.col("f05").alias("b")), "s1_id")
    return x.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("delta"), F.sum((d > 0).cast("long")).alias("improved"), F.sum((d < 0).cast("long")).alias("worsened"), (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))).alias("se"))


def set_size_transitions(a: DataFrame, b: DataFrame, ids: DataFrame) -> DataFrame:
    """How many entities go from so many matches to so many."""
    x = ids.select("s1_id").distinct()
    for name, side in (("size_a", a), ("size_b", b)):
        x = x.join(side.select(*KEY).distinct().groupBy("s1_id").agg(F.count(F.lit(1)).alias(name)), "s1_id", "left")
    return x.na.fill(0).groupBy("size_a", "size_b").agg(F.count(F.lit(1)).alias("n"))


def cohort_changes(a: DataFrame, b: DataFrame, cohort: DataFrame) -> DataFrame:
    """Pairs added and removed from a to b, per cohort. cohort: s1_id, cohort."""
    a, b = a.select(*KEY).distinct(), b.select(*KEY).distinct()
    moved = b.join(a, KEY, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, KEY, "left_anti").withColumn("change", F.lit("removed")))
    return moved.join(cohort, "s1_id", "left").groupBy("cohort", "change").agg(F.count(F.lit(1)).alias("n"))


def ambiguity(records: DataFrame, by: list[str]) -> DataFrame:
    """Records that look alike: how many, how many owners, how many without one. records: by..., owner."""
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("owner").alias("owners"), F.sum(F.col("owner").isNull().cast("long")).alias("distractors"))


def name_multiplicity(records: DataFrame, col: str = "n_core") -> DataFrame:
    """Per country the median and the largest number of records with one name."""
    x = records.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("country", col)))
    return x.groupBy("country").agg(F.median("k").alias("median_k"), F.max("k").alias("max_k"))


def deletion_bound(scores: DataFrame, m: int = 1) -> DataFrame:
    """What deleting m wrong pairs can gain an entity at most. scores: s1_id, n_true, n_pred."""
    loss = 1 - 1.25 * (F.col("n_pred") - m) / (0.25 * F.col("n_true") + F.col("n_pred"))
    return scores.where(F.col("n_pred") > m).select("s1_id", F.greatest(loss, F.lit(0.0)).alias("bound"))


def added_tokens(pairs: DataFrame, least: int = 1) -> DataFrame:
    """Words that records add: how often, and how often the pair is true. pairs: q_toks, t_toks, y."""
    words = pairs.select(F.explode(F.array_except("t_toks", "q_toks")).alias("word"), "y")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("true_n")).where(F.col("n") >= least)


def validate(lists: DataFrame, ids: DataFrame, list_col: str = "matched_entity_ids", known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """V05-V10 on a read list table: rule, severity, id, detail; empty if it is valid.

    known: all record ids (opt-in). candidates: s1_id, cand_id; matches outside them are warnings.
    """
    rows = lists.select(F.col("source1_entity_id").alias("s1_id"), F.col(list_col).alias("ids"))
    pairs = rows.select("s1_id", F.explode(F.split(F.coalesce("ids", F.lit("")), ",")).alias("cand_id")).withColumn("cand_id", F.trim("cand_id")).where("cand_id <> ''")

    def found(df: DataFrame, rule: str, id_: str, detail: str | None = None, severity: str = "error") -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(id_).alias("id"), (F.col(detail) if detail else F.lit("")).alias("detail"))

    want = ids.select("s1_id").distinct()
    parts = [
        found(rows.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate_row", "s1_id"),
        found(pairs.groupBy("s1_id", "cand_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate_id", "s1_id", "cand_id"),
        found(pairs.where(F.col("cand_id").startswith("S1-")), "own_source_id", "s1_id", "cand_id"),
        found(pairs.where(~F.col("cand_id").rlike("^S[123]-")), "wrong_prefix", "s1_id", "cand_id"),
        found(want.join(rows, "s1_id", "left_anti"), "missing_row", "s1_id"),
        found(rows.join(want, "s1_id", "left_anti").select("s1_id").distinct(), "extra_row", "s1_id"),
    ]
    if known is not None:
        parts.append(found(pairs.where(F.col("cand_id").rlike("^S[23]-")).join(known.select(F.col("entity_id").alias("cand_id")), "cand_id", "left_anti"), "unknown_id", "s1_id", "cand_id"))
    if candidates is not None:
        parts.append(found(pairs.join(candidates.select(*KEY), KEY, "left_anti"), "not_a_candidate", "s1_id", "cand_id", "warning"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
