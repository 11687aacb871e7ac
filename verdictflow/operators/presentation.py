"""Tables and pages for people. Every line of one is a row, made by column expressions; only what shows a whole table
brings its lines to the driver: one line for each model or category, so they are few, and MOST_ROWS bounds them.
"""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.findings import escape_html

MOST_ROWS = 10_000
_LATEX = str.maketrans({c: "\\" + c for c in "&%$#_{}"} | {"~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"})


def _few(rows: DataFrame) -> list[Row]:
    """All rows; more than MOST_ROWS are an error, as they are no table for people."""
    got = rows.limit(MOST_ROWS + 1).collect()
    if len(got) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows are no table for people")
    return got


def _shown(rows: DataFrame) -> dict[str, Column]:
    """The columns as text: four digits of a fraction, N/A for null."""
    fraction = {f.name for f in rows.schema if f.dataType.typeName() in ("double", "float")}
    told = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c)) if c in fraction else F.col(c).cast("string")).otherwise("N/A")
    return {c: told(c) for c in rows.columns}


def _latex(cell: Column) -> Column:
    """A cell with LaTeX's special characters written out."""
    parts = F.transform(F.split(cell, ""), lambda ch: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in _LATEX.items() for x in (chr(k), v)]), ch), ch))
    return F.array_join(parts, "")


def widths(rows: DataFrame) -> list[int]:
    """Of each column, the characters of its widest cell or its name: one row, whatever the table's length."""
    widest = rows.agg(*[F.max(F.length(c)).alias(f"w{i}") for i, c in enumerate(_shown(rows).values())]).first()
    return [max(len(name), w or 0) for name, w in zip(rows.columns, widest)]


def lines(rows: DataFrame) -> DataFrame:
    """rows with `ascii`, the row's line in a padded table, and `latex`, its line in a tabular."""
    cells = _shown(rows)
    padded = [F.rpad(c, w, " ") for c, w in zip(cells.values(), widths(rows))]
    return rows.select("*", F.rtrim(F.concat_ws("  ", *padded)).alias("ascii"), F.concat(F.concat_ws(" & ", *map(_latex, cells.values())), F.lit(r" \\")).alias("latex"))


def ascii_table(rows: DataFrame) -> str:
    """Columns padded to their widest cell, below a ruled header."""
    width = widths(rows)
    head = "  ".join(c.ljust(w) for c, w in zip(rows.columns, width)).rstrip()
    return "\n".join([head, "  ".join("-" * w for w in width), *[r["ascii"] for r in _few(lines(rows).select("ascii"))]])


def latex_table(rows: DataFrame, caption: str = "") -> str:
    """A tabular with its special characters escaped."""
    head = " & ".join(c.translate(_LATEX) for c in rows.columns) + r" \\"
    body = [r["latex"] for r in _few(lines(rows).select("latex"))]
    parts = [r"\begin{table}[h]", r"\centering", *([rf"\caption{{{caption.translate(_LATEX)}}}"] if caption else []), rf"\begin{{tabular}}{{{'l' * len(rows.columns)}}}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}", r"\end{table}"]
    return "\n".join(parts)


_METRICS = "map<string,struct<precision:double,recall:double,f1:double,tp:long,fp:long,fn:long>>"


def page_rows(reports: DataFrame) -> DataFrame:
    """(file, report as JSON text) to name, section, html: the table row of each section of a report; what is missing is blank."""
    told = F.from_json(F.get_json_object("report", "$.metrics"), _METRICS)
    each = reports.select(F.col("file").alias("name"), F.coalesce(F.nullif(F.get_json_object("report", "$.model"), F.lit("")), F.col("file")).alias("model"), F.explode(told).alias("section", "m"))
    rate = lambda c: F.when(F.col(f"m.{c}").isNotNull(), F.format_string("%.4f", F.col(f"m.{c}"))).otherwise("")
    cells = [F.col("model"), F.col("section"), *map(rate, ("precision", "recall", "f1")), *[F.coalesce(F.col(f"m.{c}").cast("string"), F.lit("")) for c in ("tp", "fp", "fn")]]
    wrapped = F.concat(*[F.concat(F.lit("<td>"), escape_html(c), F.lit("</td>")) for c in cells])
    return each.select("name", "section", F.concat(F.lit("<tr>"), wrapped, F.lit("</tr>")).alias("html"))


def dashboard(reports: DataFrame, title: str = "Reports") -> str:
    """A static page with one table of all reports (file, report as JSON text), which it also carries as data.

    The data cannot end the script that holds it: </ is written as <\\/.
    """
    body = "".join(r["html"] for r in _few(page_rows(reports).orderBy("name", "section")))
    found = [(r["file"], json.loads(r["report"])) for r in _few(reports.select("file", "report"))]
    head = "".join(f"<th>{c}</th>" for c in ("model", "section", "precision", "recall", "f1", "tp", "fp", "fn"))
    held = json.dumps([{"name": n, "data": d} for n, d in found], ensure_ascii=False).replace("</", "<\\/")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table><script type="application/json" id="reports">{held}</script></body></html>\n'


def manifest(runs: DataFrame, created_at: str, bound: int = 5, timeout: int = 30) -> dict:
    """The manifest of a matrix of models: rows (model, returncode, elapsed_seconds, report); failed tells whether any run failed."""
    rows = [{"model": r["model"], "status": "ok" if r["returncode"] == 0 else "failed", "returncode": r["returncode"], "elapsed_seconds": r["elapsed_seconds"], "report": r["report"]} for r in _few(runs)]
    return {"created_at": created_at, "bound": bound, "timeout": timeout, "runs": rows, "failed": any(x["status"] == "failed" for x in rows)}
