"""Text tables, Parquet tables and list files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORDS = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def raw_path(root: str, split: str, name: str) -> str:
    """I01."""
    return f"{root}/{split}_{name}.tsv"


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All strings, nothing inferred, quotes are ordinary characters, empty is not null."""
    rows = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", True).option("mode", "PERMISSIVE").csv(path)
    return rows.na.fill("")


def write_parquet(df: DataFrame, path: str, schema: T.StructType = RECORDS, by: tuple[str, ...] = ("country",), mode: str = "errorifexists") -> None:
    """The columns must be those of the schema. mode 'ignore' keeps a table that is there."""
    if df.columns != schema.fieldNames():
        raise ValueError(f"columns {df.columns}, expected {schema.fieldNames()}")
    df.write.mode(mode).partitionBy(*by).parquet(path)


def load_records(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """The predicate on the partition column prunes folders."""
    rows = spark.read.parquet(path)
    rows = rows if country is None else rows.where(F.col("country") == country)
    return rows.select(*RECORDS.fieldNames())


def write_list_tsv(lists: DataFrame, path: str) -> None:
    """Header and rows as plain text, one folder, rows sorted by id; nothing is quoted."""
    a, b = lists.columns
    body = lists.orderBy(a).select(F.concat_ws("\t", a, F.coalesce(b, F.lit(""))).alias("value"))
    head = lists.sparkSession.createDataFrame([(f"{a}\t{b}",)], "value string")
    head.coalesce(1).write.mode("overwrite").text(f"{path}/0-header")
    body.write.mode("overwrite").text(f"{path}/1-rows")


def read_list_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list file or of what write_list_tsv() has written."""
    return spark.read.option("recursiveFileLookup", True).text(path)


def file_violations(lines: DataFrame, header: tuple[str, str]) -> DataFrame:
    """An empty file, a wrong header, rows that are not two cells: rule, detail."""
    want = "\t".join(header)
    is_head = F.lower(F.trim("value")) == want.lower()
    counts = lines.agg(F.count(F.lit(1)).alias("n"), F.sum(is_head.cast("int")).alias("heads"), F.max(F.lower("value").startswith(header[0].lower() + ",")).alias("commas"))
    empty = counts.where("n = 0").select(F.lit("empty_file").alias("rule"), F.lit("").alias("detail"))
    wrong = counts.where("n > 0 and heads <> 1").select(F.when(F.col("commas"), "comma_separated").otherwise("wrong_header").alias("rule"), F.lit("").alias("detail"))
    odd = lines.where(~is_head & (F.size(F.split("value", "\t")) != 2)).select(F.lit("malformed_row").alias("rule"), F.col("value").alias("detail"))
    return empty.unionByName(wrong).unionByName(odd)


def read_list_pairs(lines: DataFrame, header: tuple[str, str]) -> DataFrame:
    """A list file back to pairs."""
    from linkmill.operators.evaluation import explode_truth

    cells = F.split("value", "\t")
    rows = lines.where(F.lower(F.trim("value")) != "\t".join(header).lower()).select(F.get(cells, F.lit(0)).alias(header[0]), F.coalesce(F.get(cells, F.lit(1)), F.lit("")).alias(header[1]))
    return explode_truth(rows, *header)


def append_ledger(entry: dict, spark: SparkSession, path: str) -> None:
    """A row of the run ledger."""
    spark.createDataFrame([{k: str(v) for k, v in entry.items()}]).coalesce(1).write.mode("append").json(path)


def content_digest(df: DataFrame) -> DataFrame:
    """A digest of the rows that does not depend on their order."""
    row = F.sha1(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns)))
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(row)).alias("digest"))
