"""Owner probabilities, assignment and set selection (P01-P10, P16-P19). Pairs: s1_id, cand_id, p."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkmill.operators.records import ranked

CLIP = 1e-6


def clipped(p: Column, eps: float = CLIP) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def odds(p: Column, eps: float = CLIP) -> Column:
    return clipped(p, eps) / (1 - clipped(p, eps))


def exclusive_owner(pairs: DataFrame, col: str = "p", out: str | None = None) -> DataFrame:
    """Odds over one (no owner) plus the odds of all claimants of the record."""
    o = odds(F.col(col))
    return pairs.withColumn(out or col, o / (1 + F.sum(o).over(Window.partitionBy("cand_id"))))


def owner_blend(pairs: DataFrame, share: float, col: str = "p") -> DataFrame:
    """P03."""
    return exclusive_owner(pairs, col, "_q").withColumn(col, (1 - share) * F.col(col) + share * F.col("_q")).drop("_q")


def one_owner(pairs: DataFrame, col: str = "p") -> DataFrame:
    """Each record only for its best entity, ties to the smallest id."""
    return ranked(pairs, col, "cand_id", "s1_id", "_r").where("_r = 1").drop("_r")


def select_threshold(pairs: DataFrame, threshold: float, col: str = "p") -> DataFrame:
    """P05."""
    return pairs.where(F.col(col) >= threshold)


def flag_ef05(pairs: DataFrame, out: str, col: str = "p", recall_ceiling: float = 0.985, most: int = 12) -> DataFrame:
    """Which pairs belong to the prefix by falling probability with the best expected F0.5, if that beats the empty set."""
    whole = Window.partitionBy("s1_id")
    order = whole.orderBy(F.desc(col), F.asc("cand_id"))
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = pairs.withColumns({"_m": F.row_number().over(order), "_cs": F.sum(col).over(run), "_all": F.sum(col).over(whole), "_none": F.exp(F.sum(F.ln(F.least(F.greatest(1 - F.col(col), F.lit(CLIP)), F.lit(1.0)))).over(whole))})
    ef = F.when(F.col("_m") <= most, 1.25 * F.col("_cs") / (0.25 * F.col("_all") / recall_ceiling + F.col("_m"))).otherwise(F.lit(-1.0))
    df = df.withColumn("_ef", F.round(ef, 12))  # the sums depend on the order of rows; ties must not
    df = df.withColumns({"_best": F.max("_ef").over(whole), "_at": F.min_by("_m", F.struct(-F.col("_ef"), F.col("_m"))).over(whole)})
    return df.withColumn(out, (F.col("_best") > F.col("_none")) & (F.col("_m") <= F.col("_at"))).drop("_m", "_cs", "_all", "_none", "_ef", "_best", "_at")


def select_ef05(pairs: DataFrame, col: str = "p", recall_ceiling: float = 0.985, most: int = 12) -> DataFrame:
    """The pairs of that prefix."""
    return flag_ef05(pairs, "_kept", col, recall_ceiling, most).where("_kept").drop("_kept")


@functools.lru_cache(maxsize=256)
def quadrature(degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights on the unit interval for a polynomial of this degree.

    For high degrees fewer than the exact number do: with m nodes x ** d is off by about exp(-4 m ** 2 / d).
    """
    at, weight = np.polynomial.legendre.leggauss(min(degree // 2 + 1, 32 + math.isqrt(16 * degree)))
    return (at + 1) / 2, weight / 2


def exact_utility(p: np.ndarray, most: int | None = None) -> np.ndarray:
    """Expected F0.5 of each prefix of up to ``most`` independent candidates (of all by default), the empty one first.

    1 / (T / 4 + k) is the integral of 4 u ** (T + 4 k - 1) over the unit interval, and the expectation
    of u ** T factors over all candidates; Gauss-Legendre nodes integrate the polynomial.
    """
    n = len(p)
    most = n if most is None else min(most, n)
    x, weight = quadrature(n + 4 * most)
    product = np.ones_like(x)
    for k in range(0, n, 1024):
        part = p[k : k + 1024, None]
        product *= np.prod(1 - part + part * x, axis=0)
    out = np.empty(most + 1)
    out[0] = np.prod(1 - p)
    chosen = np.zeros_like(x)
    for k in range(1, most + 1):
        q = p[k - 1]
        chosen += q * x / (1 - q + q * x)
        out[k] = 5 * (weight * x ** (4 * k - 1) * product * chosen).sum()
    return out


def exact_ef05(pairs: DataFrame, col: str = "p", most: int = 12) -> DataFrame:
    """P07 as a selection: s1_id, m (how many candidates to take), utility. At most ``most`` are taken; the number of true ones is that of all."""
    order = ranked(pairs, col, "s1_id", "cand_id", "_r")
    lists = order.groupBy("s1_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(col).alias("p")))), lambda x: x["p"]).alias("ps"))

    @F.pandas_udf("struct<m:int,utility:double>")
    def best(ps: pd.Series) -> pd.DataFrame:
        found = [exact_utility(np.asarray(x, dtype=float), most) for x in ps]
        return pd.DataFrame({"m": [int(np.argmax(u)) for u in found], "utility": [float(u.max()) for u in found]})

    return lists.withColumn("b", best("ps")).select("s1_id", "b.m", F.round("b.utility", 9).alias("utility"))


def expected_f(selected: DataFrame, pairs: DataFrame, col: str = "p") -> DataFrame:
    """s1_id, ef: the expected F0.5 of a selection by the probabilities of all pairs."""
    every = pairs.groupBy("s1_id").agg(F.sum(col).alias("t"), F.exp(F.sum(F.ln(F.greatest(1 - F.col(col), F.lit(CLIP))))).alias("none"))
    some = selected.groupBy("s1_id").agg(F.sum(col).alias("s"), F.count(F.lit(1)).alias("n"))
    ef = F.when(F.col("n").isNull(), F.col("none")).otherwise(1.25 * F.col("s") / (0.25 * F.col("t") + F.col("n")))
    return every.join(some, "s1_id", "left").select("s1_id", ef.alias("ef"))


def logit_push(pairs: DataFrame, shift: float, col: str = "p") -> DataFrame:
    """P10."""
    o = odds(F.col(col), 1e-7) * F.exp(F.lit(shift))
    return pairs.withColumn(col, o / (1 + o))


def odds_factor(pairs: DataFrame, hits: Column, factor: float, col: str = "p") -> DataFrame:
    """Multiply the odds where a rule holds."""
    o = odds(F.col(col)) * factor
    return pairs.withColumn(col, F.when(hits, o / (1 + o)).otherwise(F.col(col)))


def capped(pairs: DataFrame, hits: DataFrame, cap: float = 0.003, col: str = "p") -> DataFrame:
    """At most ``cap`` for the pairs in ``hits``."""
    marked = pairs.join(hits.select("s1_id", "cand_id", F.lit(True).alias("_hit")).distinct(), ["s1_id", "cand_id"], "left")
    return marked.withColumn(col, F.when(F.col("_hit"), F.least(F.col(col), F.lit(cap))).otherwise(F.col(col))).drop("_hit")


def baseline(pairs: DataFrame, threshold: float, col: str = "rscore") -> DataFrame:
    """P19."""
    return select_threshold(one_owner(pairs, col), threshold, col)
