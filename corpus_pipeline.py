"""The corpus pipeline: language, repeated lines, near duplicates, repeated passages, packing.

Each stage takes the rows that the one before kept, with the columns of documents, and its decisions take
effect; between stages they are written as Parquet and read again. The last stage gives pieces of packed
sequences. There is no oracle in SQL: language identification and packing can't be put in SQL.

A null text goes at the first stage. A row without doc_id loses no lines and no passages, as nothing can come before
it; among near duplicates it comes after all rows with one, and it is packed. Rows that share a doc_id are one
document, with the least of their texts: the third stage keeps one of them. Ties go to the smaller doc_id. Empty tables
give empty ones. Other columns, whatever their names, are carried to the fourth stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common, langid, lines, minhash, packing, substrings

ORACLE_SQL = None


#: The least score of a document's language. Of held-out documents of sf0.01 and sf0.001 none is below it; texts of several languages are.
LEAST_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are no one language's go: those without a letter or text, and those of which no language has LEAST_SCORE."""
    return langid.drop_unknown(docs, langid.fit(langid.learnable(docs)), LEAST_SCORE)


def sized(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column, of their texts now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go, and documents that consist of such copies."""
    return sized(lines.delete_repeats(docs)).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the smallest doc_id stays, and of rows that share one the least row with the text that counts."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"))
    nameless = whole.filter("id is null")
    if nameless.take(1):
        # Numbers above all others, fixed by being stored.
        numbered = common.stored(nameless.withColumn("id", F.lit(1 << 62) + F.monotonically_increasing_id()), "nameless")
        whole = whole.filter("id is not null").unionByName(numbered)
    kept = minhash.near_duplicates(whole.select(F.col("id").alias("doc_id"), "row.text")).filter("kept").select(F.col("doc_id").alias("id"))
    staying = whole.join(kept.hint("merge"), "id", "left_semi")
    again = common.stored(whole.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "again")
    if not again.take(1):
        return staying.select("row.*")
    order = F.struct(F.col("row.text").isNull().alias("empty"), F.col("row.text").alias("text"), "row")
    one = staying.join(again, "id", "left_semi").groupBy("id").agg(F.min(order).alias("least"))
    return staying.join(again, "id", "left_anti").select("row.*").unionByName(one.select("least.row.*"))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that start earlier go."""
    return sized(substrings.delete_repeats(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("passages", without_repeated_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
