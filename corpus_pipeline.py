"""A training corpus from raw documents, in five stages. Part of linkmill.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what each returns as
Parquet in the shared folder and hands the next one what it reads again. All but the last return the
columns of docs, and all rows that are kept, whole:

* quality_classifier drops what the co-trained classifier rejects;
* quality_rules drops what the base rules or the n-gram ratio reject;
* jaccard_join keeps one document of each group of near copies (word 5-grams, similarity 0.8), the
  one with the smallest id;
* suffix_dedup removes from the texts passages of 100 bytes or more that occur earlier; characters
  stay whole, n_chars follows the text, and a document that loses all its text stays as an empty one;
* packing returns the pieces of the packed sequences.

A row whose id is null is judged by the filters like any other, is in no group of copies and keeps its text.
Rows that repeat an id are one document: they stay or go together, and each is packed. Null and empty texts
fail the base rules; texts of any length are read whole; an empty table gives no rows; other columns, whatever
their names, come through to the last stage but one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmill.llm import cotraining, jaccard_join, packing, quality_rules as rules, suffix_dedup as passages
from linkmill.llm.runtime import staged, table

WORDS, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotraining.classified(docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.judged(docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(docs, words=WORDS, percent=PERCENT)
    # Few ids beside whole texts: the texts are only dealt out if the ids are too many to send.
    gone = staged(found.where("component_id < doc_id").select("doc_id").distinct(), "gone")
    small = gone.count() <= jaccard_join.BROADCAST_NODES
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = F.col("kept").cast("string")
    rows = passages.remove_copies(docs, characters=True).select("row.*", text.alias("text"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("jaccard_join", near_copies), ("suffix_dedup", suffix_dedup), ("packing", pack)]

#: The classifier and the tokenizer are beyond SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
