"""Records and pairs derived from the driver's tables, in Spark and in SQL; and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmill.functions import text as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def mapped(values: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in values.items()) + "}"


# --- records -----------------------------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, business_name, business_address, country, text; from documents. Of the words only the first twelve are
    asked for: the text is not split behind them (one piece may be empty, one is the rest)."""
    docs = table(spark, sf_dir, "documents").withColumn("w", F.array_remove(F.split("text", "[ \t\n]+", 14), ""))
    return docs.select(
        F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.array_join(F.slice("w", 1, 6), " ").alias("business_name"),
        F.concat((1 + F.col("doc_id") % 97).cast("string"), F.lit(" "), F.array_join(F.slice("w", 7, 6), " ")).alias("business_address"),
        F.col("lang").alias("country"),
        "text",
    )


def record_truth(rows: DataFrame) -> DataFrame:
    """Records of the sources with the smallest reference id whose text is equal: s1_id, cand_id."""
    owner = rows.where(F.col("entity_id").startswith("S1-")).groupBy("text").agg(F.min("entity_id").alias("s1_id"))
    return rows.where(~F.col("entity_id").startswith("S1-")).join(owner, "text").select("s1_id", F.col("entity_id").alias("cand_id"))


def sql_base(x: str) -> str:
    return f"lower(strip_accents({x}))"


def sql_tokens(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))"


def sql_junk(x: str) -> str:
    for pattern, by in ((r"\(\s*id\s*:?\s*\d+\s*\)", " "), (r"#\s*\d+", " "), (r"\bwww\.", " "), (T.DOMAIN, " "), ("&", " and ")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def sql_address_tokens(x: str) -> str:
    words = mapped(T.ADDRESS_WORDS | {w: str(k) for k, w in enumerate(T.ORDINALS, 1)})
    base = rf"regexp_replace(regexp_replace({sql_base(x)}, '<\s*null\s*>|\bnull\b|\bnone\b|\bn/a\b', ' ', 'g'), '#+', ' ', 'g')"
    clean = r"regexp_replace(regexp_replace(t, '^0+(\d)', '\1'), '^(\d+)(st|nd|rd|th)$', '\1')"
    return f"list_filter(list_transform(string_split({sql_tokens(base)}, ' '), lambda t: coalesce({words}[{clean}], {clean})), lambda t: t <> '')"


ALIAS = T.alias_pattern()
NUMBER_STREET = r"\b(\d+[a-z]?)\s+(?:(?:" + "|".join(T.BETWEEN) + r")\s+)*([a-z]{3,}|\d+)"
RECORDS = r"""records AS (
  SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, array_to_string(w[1:6], ' ') AS business_name,
    (1 + doc_id % 97) || ' ' || array_to_string(w[7:12], ' ') AS business_address, lang AS country, text
  FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n]+'), lambda x: x <> '') AS w FROM documents))"""
NORMAL = f"""{RECORDS},
junk AS (SELECT *, {sql_junk(sql_base("business_name"))} AS junk, {sql_address_tokens("business_address")} AS a_toks FROM records),
parts AS (SELECT *, regexp_matches(junk, '{ALIAS}') AS has_alias FROM junk),
cores AS (SELECT *, {sql_tokens("junk")} AS n_full,
  {sql_tokens(f"CASE WHEN has_alias THEN regexp_extract(junk, '{ALIAS}', 2) ELSE junk END")} AS n_core,
  {sql_tokens(f"CASE WHEN has_alias THEN regexp_extract(junk, '{ALIAS}', 1) ELSE '' END")} AS n_alias,
  array_to_string(a_toks, ' ') AS a_norm, len(a_toks) = 0 AS a_empty FROM parts),
normal AS (SELECT *, list_filter(string_split(n_core, ' '), lambda t: t <> '' AND NOT list_contains({listed(T.NAME_STOP)}, t)) AS n_toks,
  regexp_extract(a_norm, '{NUMBER_STREET}', 1) AS a_num, regexp_extract(a_norm, '{NUMBER_STREET}', 2) AS a_street FROM cores),
recs AS (SELECT *, array_to_string(n_toks, '') AS n_nospace FROM normal)"""
TRUTH = f"""truth AS (SELECT o.s1_id, r.entity_id AS cand_id FROM records r JOIN
  (SELECT text, min(entity_id) AS s1_id FROM records WHERE entity_id LIKE 'S1-%' GROUP BY text) o ON r.text = o.text WHERE r.entity_id NOT LIKE 'S1-%')"""

# --- pairs -------------------------------------------------------------------------------------


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1_id, cand_id, p, country; from lineitem."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    where = c.join(F.broadcast(n.join(r, n["n_regionkey"] == r["r_regionkey"])), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("country"))
    where = o.join(where, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("s1_id"), "country")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("s1_id"), F.col("l_partkey").alias("cand_id")).agg(F.round(F.max("l_quantity") / 51.0, 6).alias("p"))
    return rows.join(where, "s1_id").select("s1_id", "cand_id", "p", "country")


def pair_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("s1_id"), F.col("l_partkey").alias("cand_id")).distinct()


def pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("s1_id", "country").distinct()


PAIRS = """pairs AS (SELECT l.s1_id, l.cand_id, l.p, r_name AS country FROM
  (SELECT l_orderkey AS s1_id, l_partkey AS cand_id, round(max(l_quantity) / 51.0, 6) AS p FROM lineitem GROUP BY 1, 2) l
  JOIN orders ON o_orderkey = l.s1_id JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""
PAIR_TRUTH = "truth AS (SELECT DISTINCT l_orderkey AS s1_id, l_partkey AS cand_id FROM lineitem WHERE l_returnflag = 'R')"
IDS = "ids AS (SELECT DISTINCT s1_id, country FROM pairs)"


def odds(p: str, eps: str = "1e-6") -> str:
    q = f"least(greatest({p}, {eps}), 1 - {eps})"
    return f"({q} / (1 - {q}))"


OWNED = "owned AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY p DESC, s1_id) AS r FROM pairs) WHERE r = 1)"


def selected(source: str, name: str = "sel") -> str:
    """The expected-F0.5 selection of a relation."""
    return f"""{name}_a AS (SELECT *, row_number() OVER o AS m, sum(p) OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id ROWS UNBOUNDED PRECEDING) AS cs,
  sum(p) OVER w AS al, exp(sum(ln(least(greatest(1 - p, 1e-6), 1.0))) OVER w) AS e0 FROM {source}
  WINDOW o AS (PARTITION BY s1_id ORDER BY p DESC, cand_id), w AS (PARTITION BY s1_id)),
{name}_b AS (SELECT *, round(CASE WHEN m <= 12 THEN 1.25 * cs / (0.25 * al / 0.985 + m) ELSE -1.0 END, 12) AS ef FROM {name}_a),
{name}_c AS (SELECT *, max(ef) OVER (PARTITION BY s1_id) AS best FROM {name}_b),
{name}_d AS (SELECT *, min(CASE WHEN ef = best THEN m END) OVER (PARTITION BY s1_id) AS take FROM {name}_c),
{name} AS (SELECT s1_id, cand_id, p, country FROM {name}_d WHERE best > e0 AND m <= take)"""


def scored(pred: str, name: str = "scores") -> str:
    return f"""{name} AS (SELECT i.s1_id, i.country, coalesce(t.n, 0) AS n_true, coalesce(q.n, 0) AS n_pred, coalesce(b.n, 0) AS tp,
  CASE WHEN t.n IS NULL AND q.n IS NULL THEN 1.0 WHEN t.n IS NULL OR q.n IS NULL THEN 0.0 ELSE 1.25 * coalesce(b.n, 0) / (0.25 * t.n + q.n) END::DOUBLE AS f05
  FROM ids i LEFT JOIN (SELECT s1_id, count(DISTINCT cand_id) AS n FROM truth GROUP BY 1) t ON i.s1_id = t.s1_id
  LEFT JOIN (SELECT s1_id, count(DISTINCT cand_id) AS n FROM {pred} GROUP BY 1) q ON i.s1_id = q.s1_id
  LEFT JOIN (SELECT p.s1_id, count(DISTINCT p.cand_id) AS n FROM {pred} p JOIN truth u ON p.s1_id = u.s1_id AND p.cand_id = u.cand_id GROUP BY 1) b ON i.s1_id = b.s1_id)"""


def with_(*parts: str) -> str:
    *ctes, body = parts
    return "WITH " + ",\n".join(ctes) + "\n" + body
