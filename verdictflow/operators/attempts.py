"""Answers of several attempts: which attempt counts, which files have none, and what went wrong.

An attempt at a file asks for every unit of it, and fails as a whole where one answer is missing or cannot be read:
then the file is tried again. The first attempt without an error counts. A file whose every attempt failed leaves
all counts; what was answered instead is kept as dead letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import findings as A

#: How often a file is tried.
TRIES = 3


def answer_error(response: Column, error: Column | None = None) -> Column:
    """Why an answer cannot be used: what the connector reported, no answer, or no findings list in it; null for a good one."""
    unread = F.when(response.isNull(), F.lit("no answer")).when(A.findings_of(response).isNull(), F.lit("no findings list in the response"))
    return unread if error is None else F.coalesce(error, unread)


def placed(units: DataFrame, answers: DataFrame, tries: int = TRIES) -> DataFrame:
    """The answers of the first `tries` attempts with the file of their unit and `error`.

    answers: unit_key, response, and if there are such columns attempt (1 without it), error, and chat (true where an
    unreadable answer of the chat layout has no findings, which is no error). Answers about other units are dropped.
    """
    rows = answers if "attempt" in answers.columns else answers.withColumn("attempt", F.lit(1))
    if "chat" in rows.columns:
        nothing = F.lit('{"findings": []}')
        rows = rows.withColumn("response", F.when(F.coalesce("chat", F.lit(False)) & A.findings_of(F.col("response")).isNull(), nothing).otherwise(F.col("response")))
    own = rows.select("unit_key", F.col("attempt").cast("int").alias("attempt"), "response", answer_error(F.col("response"), F.col("error") if "error" in rows.columns else None).alias("error"))
    return own.where(F.col("attempt") <= tries).join(units.select("unit_key", F.col("path").alias("file")), "unit_key")


def outcomes(units: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each file with units: file, attempt (the one that counts; null if all failed), attempts; rows as of placed()."""
    wanted = units.groupBy(F.col("path").alias("file")).agg(F.count_distinct("unit_key").alias("units"))
    tried = rows.groupBy("file", "attempt").agg(F.count_distinct("unit_key").alias("answered"), F.bool_and(F.col("error").isNull()).alias("good"))
    judged = wanted.join(tried, "file", "left").withColumn("good", F.col("good") & (F.col("answered") == F.col("units")))
    return judged.groupBy("file").agg(F.min(F.when(F.col("good"), F.col("attempt"))).alias("attempt"), F.count("attempt").cast("int").alias("attempts"))


def counted_answers(rows: DataFrame, ended: DataFrame) -> DataFrame:
    """(unit_key, response) of the attempts that count."""
    return rows.join(ended.select("file", "attempt"), ["file", "attempt"], "left_semi").select("unit_key", "response")


def dead_letters(rows: DataFrame, ended: DataFrame) -> DataFrame:
    """file, unit_key, attempt, error, response and lost (whether the file has no attempt that counts) of answers that could not be used."""
    last = ended.select("file", F.col("attempt").isNull().alias("lost"))
    return rows.where(F.col("error").isNotNull()).join(last, "file").select("file", "unit_key", "attempt", "error", "response", "lost")
