"""The given tables seen as the engine's inputs, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TERMS = (
    "positive",
    "moderately positive",
    "mildly positive",
    "strong positive",
    "negative",
    "moderately negative",
    "mildly negative",
    "strong negative",
    "neutral",
    "neutral",
    "unmapped",
)
ANSWERS = (
    "Positive",
    "negative.",
    "The sentiment is neutral",
    "Negative, because costs rose",
    "unsure",
    "",
    "neu-tral",
    "non-positive",
)
TRUTHS = ("negative", "neutral", "positive")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, position):
    return F.get(F.array(*[F.lit(v) for v in values]), position.cast("int"))


def en_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("lang = 'en'")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("text").alias("input"), _pick(TERMS, F.col("doc_id") % 11).alias("output")
    )


def vi_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("lang <> 'en'").select("doc_id", "text")
    part = F.col("doc_id") % 10
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("sentence"),
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1).alias("sentiment"),
        (F.col("doc_id") % 4).cast("int").alias("topic"),
        F.when(part < 7, "train").when(part < 8, "validation").otherwise("test").alias("split"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' raw answers to every document."""
    docs = table(spark, sf_dir, "documents")
    truth = _pick(TRUTHS, F.col("doc_id") % 3)
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("language"),
        F.lit("label it").alias("instruction"),
        F.col("text").alias("input_text"),
        truth.alias("ground_truth"),
        _pick(ANSWERS, F.col("doc_id") % 8).alias("baseline_raw_output"),
        F.when(F.col("doc_id") % 5 == 0, "neutral").otherwise(truth).alias("finetuned_raw_output"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt_no"), F.col("text").alias("prompt"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


EN_RAW = f"""en_raw AS (
  SELECT doc_id AS id, text AS input, {_sql_list(TERMS)}[doc_id % 11 + 1] AS output
  FROM documents WHERE lang = 'en')"""

VI_RAW = """vi_raw AS (
  SELECT d.doc_id AS id, d.text AS sentence,
         CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END AS sentiment,
         CAST(d.doc_id % 4 AS INT) AS topic,
         CASE WHEN d.doc_id % 10 < 7 THEN 'train' WHEN d.doc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang <> 'en')"""

ANSWERED = f"""answers AS (
  SELECT doc_id AS id, lang AS language, 'label it' AS instruction, text AS input_text,
         {_sql_list(TRUTHS)}[doc_id % 3 + 1] AS ground_truth,
         {_sql_list(ANSWERS)}[doc_id % 8 + 1] AS baseline_raw_output,
         CASE WHEN doc_id % 5 = 0 THEN 'neutral' ELSE {_sql_list(TRUTHS)}[doc_id % 3 + 1] END AS finetuned_raw_output
  FROM documents)"""
