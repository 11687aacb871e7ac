"""Ground truth, benchmark reports and recorded responses, read as DataFrames; and report sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.findings import safe_name

ITEM = "id string, file string, function string, expected_category string, category string, verifiable boolean, should_go_to_esbmc boolean, expression string, line int, expected_type string"
GROUND_TRUTH = f"category string, description string, items array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>"
LEGACY = "map<string,struct<expected_findings:array<struct<function:string,category:string,verifiable:boolean,expression:string,line:int>>>>"
RESPONSE, VERIFIER = "unit_key string, response string", "file string, function string, stdout string, stderr string, returncode int, seconds double"


def _typed(items: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows of a column `item`: flags and texts are filled, the category falls back to the older field."""
    text = lambda c: F.coalesce(F.col(f"item.{c}"), F.lit("")).alias(c)
    flag = lambda c: F.coalesce(F.col(f"item.{c}"), F.lit(False)).alias(c)
    category = F.coalesce(F.col("item.expected_category"), F.col("item.category"), F.lit("")).alias("category")
    return items.select(*keys, text("id"), text("file"), text("function"), category, flag("verifiable"), flag("should_go_to_esbmc"), text("expression"), F.col("item.line").alias("line"), text("expected_type"))


def parse_ground_truth(files: DataFrame) -> DataFrame:
    """(json_path, text) to one row for each item with a file, numbered in load order (by path, then position), with its source_path; a path is given once."""
    rows = files.select("json_path", F.from_json("text", GROUND_TRUTH).alias("g")).select("json_path", "g.*").where("items is not null")
    stem = F.regexp_extract("json_path", r"([^/]+)\.json$", 1)
    placed = F.filter(F.transform("items", lambda x, i: F.struct(i.alias("pos"), x.alias("item"))), lambda x: F.coalesce(x["item"]["file"], F.lit("")) != "")
    rows = rows.select("json_path", F.coalesce(F.nullif(F.col("category"), F.lit("")), stem).alias("group"), placed.alias("placed"))
    before = F.sum("n").over(Window.orderBy("json_path").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.select("json_path", F.size("placed").alias("n")).select("json_path", F.coalesce(before, F.lit(0)).alias("before"))  # one slim row a file
    items = rows.join(starts, "json_path").select("json_path", "group", "before", F.posexplode("placed").alias("nth", "x")).select("json_path", "group", (F.col("before") + F.col("nth") + 1).cast("int").alias("ord"), "x.item")
    items = items.withColumn("source_path", source_path(F.regexp_replace("json_path", r"/[^/]*$", ""), F.col("group"), F.col("item.file")))
    return _typed(items, ["ord", "json_path", "source_path"])


def _whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("json_path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """parse_ground_truth() of one file, or of all JSON files of a folder, searched in depth."""
    return parse_ground_truth(_whole_files(spark, path, "*.json"))


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """The older layout: file name to expected findings."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", LEGACY).alias("m"))
    per = rows.select(F.explode("m").alias("file", "x"))
    return per.select("file", F.explode("x.expected_findings").alias("e")).select("file", "e.*")


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Expected rows (source_path, function, category, verifiable, expression, line) of any of the three layouts.

    A folder, or a file with `items`, is read as items; another file as the older layout, whose sources lie beside it.
    """
    columns = ["source_path", "function", "category", "verifiable", "expression", "line"]
    if not path.endswith(".json"):
        return read_ground_truth(spark, path).select(*columns)
    listed = spark.read.text(path, wholetext=True).where(F.get_json_object("value", "$.items").isNotNull())
    if listed.limit(1).count():
        return read_ground_truth(spark, path).select(*columns)
    folder = path.rsplit("/", 1)[0]
    return read_legacy(spark, path).withColumn("source_path", F.concat(F.lit(folder + "/"), "file")).select(*columns)


def source_path(folder, category, file):
    """Where an item's file lies: x/ground_truths/bugs has its sources in x/ok/bugs, another folder x/y in x/ok/y.

    A category other than clean has a folder of its own there, unless the folder is named after it.
    """
    inside = F.regexp_replace(folder, "(^|/)ground_truths/([^/]+)$", "$1ok/$2")
    root = F.when(inside != folder, inside).otherwise(F.regexp_replace(folder, "(^|/)([^/]+)$", "$1ok/$2"))
    flat = (category == "clean") | (F.regexp_extract(root, "([^/]+)$", 1) == category)
    return F.when(flat, F.concat_ws("/", root, file)).otherwise(F.concat_ws("/", root, category, file))


def collect_reports(reports: DataFrame) -> DataFrame:
    """One row: all reports as an array of (name, data), by name; reports are written by people's runs, so they are few."""
    return reports.agg(F.sort_array(F.collect_list(F.struct(F.col("file").alias("name"), F.col("report").alias("data")))).alias("reports"))


def parse_reports(files: DataFrame) -> DataFrame:
    """(file, text) to (file, report): JSON objects that have metrics, by name; the manifest of a matrix is none."""
    named = F.startswith("file", F.lit("benchmark_")) & F.endswith("file", F.lit(".json")) & (F.col("file") != "benchmark_matrix_manifest.json")
    rows = files.where(named).select("file", F.col("text").alias("report"))
    return rows.where(F.get_json_object("report", "$.metrics").isNotNull()).orderBy("file")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return parse_reports(_whole_files(spark, path, "benchmark_*.json"))


def per_category(reports: DataFrame) -> DataFrame:
    """file, category, precision, recall, f1, tp, fp, fn; older reports name the section differently."""
    cell = "map<string,struct<precision:double,recall:double,f1:double,tp:int,fp:int,fn:int>>"
    text = F.coalesce(F.get_json_object("report", "$.per_category_llm"), F.get_json_object("report", "$.per_category"))
    return reports.select("file", F.explode(F.from_json(text, cell)).alias("category", "x")).select("file", "category", "x.*")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Recorded analyzer responses: the default, repeatable analyzer source."""
    return spark.read.schema(RESPONSE).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Recorded verifier runs."""
    return spark.read.schema(VERIFIER).parquet(path)


def write_json_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_direct_results(rows: DataFrame, path: str) -> None:
    """Verifier results without their raw output."""
    write_json_report(rows.drop("stdout", "stderr"), path)


def write_full_report(files: DataFrame, summary: DataFrame, experiment: dict, ground_truth: dict, path: str) -> None:
    """A folder with the report's parts: head (experiment, ground truth and summary, one row) and files, one JSON row each.

    The files stay rows of their own, so the report of a large run is never one value.
    """
    blocks = {"experiment": experiment, "ground_truth": ground_truth}
    head = summary.select(*[F.lit(json.dumps(v, ensure_ascii=False)).alias(k) for k, v in blocks.items()], F.to_json(F.struct("*")).alias("summary"))
    body = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), F.col(k)) for k in ("experiment", "ground_truth", "summary")]), F.lit("}"))
    head.select(body.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/head")
    write_json_report(files, f"{path}/files")


def write_benchmark_reports(reports: DataFrame, path: str, by: str = "model") -> None:
    """One JSON file for each model's report, below a folder named after it."""
    rows = reports.select(safe_name(F.col(by)).alias("name"), F.to_json("report").alias("value"))
    rows.repartition("name").write.mode("overwrite").partitionBy("name").text(path)


def write_logs(runs: DataFrame, path: str) -> None:
    """Raw logs by file; unit and finding are part of the key, so no log overwrites another."""
    runs.write.mode("overwrite").partitionBy("file").parquet(path)


def write_annotations(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Annotated rows as one file: people have written them by hand, so they are few. All cells of a CSV are quoted."""
    out = rows.coalesce(1).write.mode("overwrite")
    if kind == "csv":
        out.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
    else:
        out.json(path)
