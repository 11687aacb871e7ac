"""Confusion counts and derived metrics of a rule against labels, by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", (F.col("n_chars") < 400).alias("flagged"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 0).alias("bad"))
    hit, bad = F.col("flagged"), F.col("bad")
    counts = docs.join(labels, "doc_id").groupBy("lang").agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"), F.count_if(~hit & ~bad).alias("tn"))
    return counts.select("lang", "tp", "fp", "fn", "tn", F.round(M.precision("tp", "fp"), 4).alias("precision"), F.round(M.recall("tp", "fn"), 4).alias("recall"), F.round(M.f1("tp", "fp", "fn"), 4).alias("f1"), F.round(M.accuracy("tp", "fp", "fn", "tn"), 4).alias("accuracy"), F.round(M.mcc("tp", "fp", "fn", "tn"), 4).alias("mcc"))


_SQL = """
WITH c AS (
  SELECT lang, CAST(count(*) FILTER (WHERE n_chars < 400 AND quality = 0) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE n_chars < 400 AND quality <> 0) AS BIGINT) AS fp,
    CAST(count(*) FILTER (WHERE n_chars >= 400 AND quality = 0) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE n_chars >= 400 AND quality <> 0) AS BIGINT) AS tn
  FROM documents JOIN labels USING (doc_id) GROUP BY lang),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS q,
  sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) AS root FROM c)
SELECT lang, tp, fp, fn, tn, round(p, 4) AS "precision", round(q, 4) AS recall, round(CASE WHEN p + q = 0 THEN 0e0 ELSE 2 * p * q / (p + q) END, 4) AS f1,
  round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 4) AS accuracy, round(CASE WHEN root = 0 THEN 0e0 ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / root END, 4) AS mcc
FROM r
"""

PLANS = {"q_confusion_prf_mcc": (confusion, _SQL)}
