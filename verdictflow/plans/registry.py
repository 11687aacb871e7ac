"""The registry of queries: each is a DataFrame plan, with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from . import evaluation, findings, flagship, native, verifier


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


FLAGSHIP = "q_confusion_prf_mcc"
QUERIES: dict[str, Query] = {}
for _module in (flagship, evaluation, verifier, findings, native):
    for _name, (_run, _sql) in _module.PLANS.items():
        QUERIES[_name] = Query(_run, _sql)
