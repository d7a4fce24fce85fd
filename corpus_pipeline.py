"""The corpus pipeline: quality rules, line dedup, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_folder, ship, table, text_of
from tidemark.llm.entry import vocabulary
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.minhash_dedup import rooted_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import apply, fit, statistics


def settled(df: DataFrame, condition: str) -> DataFrame:
    """Filter by columns as they are: without the row number, the optimizer would push the condition below the
    projections that make them and put their whole expressions, many times over, in its place.

    Rows whose condition is null go; all columns come out as they are, and an empty table stays empty."""
    at = "_at"
    while at in df.columns:
        at += "_"
    return df.withColumn(at, F.monotonically_increasing_id()).filter(f"({condition}) AND {at} >= 0").drop(at)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and no rule of the learned list rejects; a null text goes.

    Null ids and repeated rows are judged like others; columns come out as they are, whatever their names."""
    rules = fit(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("_text"))
    return settled(apply(statistics(whole, ["_doc"], "_text"), rules), "kept").select("_doc.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of 50 words or more that an earlier one has; those left without a word by that go.

    Null and empty texts stay. Other columns come out as they are, but for n_chars of a text that changed."""
    rest = F.struct(*[c for c in docs.columns if c != "text"])
    out = settled(dedup_lines(docs.select(rest.alias("_doc"), "doc_id", "text")), r"NOT (n_removed > 0 AND NOT regexp_like(text, '[^\\x20\\x09-\\x0D]'))")
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("_doc.n_chars"))
    return out.select(*[(made[c] if c in made else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id (then text hash).

    A document without words is near none but its own repetitions (equal id and text), of which one
    stays. Null ids come after others; groups are told apart by themselves, not by their ids. Columns
    come out as they are, whatever their names."""
    none, least = F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id")
    key = F.struct("none", "id", "tkey")
    kept = rooted_duplicates(docs).filter("kept").select(none, least, "tkey", "root", "n_shingles")
    alone = F.when(F.col("n_shingles") == 0, key).alias("alone")  # these have no root
    keys = kept.groupBy("root", alone).agg(F.min(key).alias("f")).select("f.*")
    named = docs.select(F.struct(*docs.columns).alias("doc"), none, least, F.xxhash64(text_of("text")).alias("tkey"))
    return named.join(keys, ["none", "id", "tkey"], "left_semi").dropDuplicates(["none", "id", "tkey"]).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens; a null or empty text has its end id, null ids and repeated rows are packed each."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), end_id=1)


STAGES = [("quality rules", quality), ("line dedup", lines), ("minhash near-dedup", near), ("packing", packing)]

#: SQL has no tokenizer, and no learned list; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
