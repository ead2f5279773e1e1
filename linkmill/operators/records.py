"""Normalised records and transliteration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkmill.functions import text as T


def normalize_names(df: DataFrame, col: str = "business_name") -> DataFrame:
    """N07-N09."""
    base = T.base_clean(F.col(col))
    df = df.withColumns({"_junk": T.without_junk(base), "is_native": T.is_native(F.col(col)), "is_domain": T.is_domain(base)})
    df = df.withColumn("has_alias", T.has_alias(F.col("_junk")))
    core = F.when(F.col("has_alias"), T.alias_part(F.col("_junk"), 2)).otherwise(F.col("_junk"))
    alias = F.when(F.col("has_alias"), T.alias_part(F.col("_junk"), 1)).otherwise(F.lit(""))
    df = df.withColumns({"n_full": T.tokens_text(F.col("_junk")), "n_core": T.tokens_text(core), "n_alias": T.tokens_text(alias)})
    df = df.withColumn("n_toks", T.informative(F.col("n_core")))
    return df.withColumn("n_nospace", F.array_join("n_toks", "")).drop("_junk")


def normalize_addresses(df: DataFrame, col: str = "business_address") -> DataFrame:
    """N10-N13."""
    df = df.withColumn("a_toks", T.address_tokens(F.col(col)))
    df = df.withColumns({"a_norm": F.array_join("a_toks", " "), "a_empty": F.size("a_toks") == 0})
    return df.withColumns({"a_num": T.number_street(F.col("a_norm"), 1), "a_street": T.number_street(F.col("a_norm"), 2)})


def normalize_records(df: DataFrame) -> DataFrame:
    """N14."""
    return normalize_addresses(normalize_names(df))


def mapped(c: Column, known: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.coalesce(F.try_element_at(known, t), t)), " ")


def transliterate(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Native tokens by the dictionary (native, latin), and what follows from them. The
    dictionary becomes one map value, so it has to be of bounded size; it is keyed by vocabulary, not rows."""
    whole = mapping.agg(F.map_from_entries(F.collect_list(F.struct("native", "latin"))).alias("m"))
    df = df.withColumns({"was_native": F.col("is_native"), "_m": F.coalesce(whole.scalar(), F.create_map().cast("map<string,string>"))})
    df = df.withColumns({c: mapped(F.col(c), F.col("_m")) for c in ("n_core", "n_full", "a_norm")}).drop("_m")
    df = df.withColumns({"is_native": T.is_native(F.col("n_core")), "n_toks": T.informative(F.col("n_core")), "a_toks": F.filter(F.split("a_norm", " "), lambda t: t != "")})
    return df.withColumn("n_nospace", F.array_join("n_toks", ""))


def best_token(pairs: DataFrame, min_share: float = 0.5, min_count: int = 2) -> DataFrame:
    """Rows (r, native, latin); the dominant latin token of each native one."""
    counts = pairs.groupBy("native", "latin").agg(F.count_distinct("r").alias("n"))
    total = pairs.groupBy("native").agg(F.count_distinct("r").alias("tot"))
    good = counts.join(total, "native").where((F.col("n") >= min_count) & (F.col("n") / F.col("tot") >= min_share))
    return good.groupBy("native").agg(F.min_by("latin", F.struct(-F.col("n"), F.col("latin"))).alias("latin"))


def learn_map(pairs: DataFrame) -> DataFrame:
    """(r, s_name, t_name, s_addr, t_addr) of matched pairs to (native, latin); names go first."""

    def toks(c: str) -> Column:
        return F.filter(F.split(c, " "), lambda t: t != "")

    names = pairs.where(T.is_native(F.col("t_name"))).select("r", toks("s_name").alias("l"), toks("t_name").alias("n")).where(F.size("l") == F.size("n"))
    names = names.select("r", F.explode(F.arrays_zip("l", "n")).alias("z")).select("r", F.col("z.n").alias("native"), F.col("z.l").alias("latin"))
    names = best_token(names.where(T.is_native(F.col("native")) & ~T.is_native(F.col("latin"))))
    places = pairs.where(T.is_native(F.col("t_addr"))).select("r", F.array_distinct(toks("s_addr")).alias("l"), F.explode(F.filter(toks("t_addr"), T.is_native)).alias("native"))
    places = places.select("r", "native", F.explode("l").alias("latin")).where(~F.col("latin").rlike(r"\d") & (F.char_length("latin") >= 2))
    return names.unionByName(best_token(places, 0.8).join(names, "native", "left_anti"))


def map_coverage(names: DataFrame, mapping: DataFrame, col: str = "n_full") -> DataFrame:
    """Share of native token occurrences that the map covers."""
    toks = names.select(F.explode(F.split(col, " ")).alias("native")).where(T.is_native(F.col("native")))
    return toks.join(mapping.select("native", F.lit(1.0).alias("hit")), "native", "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("coverage"))


def load_country(records: DataFrame, country: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The normalised reference side and the normalised source sides; the source shows in the id."""
    rows = records if country is None else records.where(F.col("country") == country)
    return split_sides(normalize_records(rows))


def split_sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col("entity_id").startswith("S1-")), rows.where(~F.col("entity_id").startswith("S1-"))


def ranked(df: DataFrame, score: str, group: str | list[str], tie: str, name: str) -> DataFrame:
    """Rank by falling score, ties by rising ``tie``."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn(name, F.row_number().over(w))


def rounded(c: Column, digits: int) -> Column:
    """A double that is not negative, scaled, rounded half up and scaled back, as C does it and SQL engines with it.
    Spark's own round takes the shortest decimal instead, and so settles sums close to a half otherwise. From 2 ** 52 on,
    a double has no fraction: there the scaling alone counts, and floor would leave the range of a long."""
    scaled = c * F.lit(float(10**digits))
    whole = F.floor(scaled)
    up = F.when(scaled < 2.0**52, whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)).otherwise(scaled)
    return up / F.lit(float(10**digits))
