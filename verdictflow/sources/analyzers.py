"""Analyzer backends: one that replays recorded responses, and one that asks a provider's HTTP interface.

Live answers are meant to be recorded first (record()), so that a retried task repeats no call; every flow then
replays the recording.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol
from urllib import error, request

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.findings import DEFAULT_MODELS
from ..functions.prompts import ANSWER_SCHEMA, SYSTEM

# Addresses of the providers, and the codes after which a call is tried again.
URLS = {
    "openai": "https://api.openai.com/v1/responses",
    "anthropic": "https://api.anthropic.com/v1/messages",
    "ollama": "http://localhost:11434/v1/chat/completions",
    "google": "https://generativelanguage.googleapis.com/v1beta/openai/chat/completions",
}
BACKENDS = tuple(URLS)
AGAIN = (429, 500, 502, 503, 504)
MAX_TOKENS = 4096


class Analyzer(Protocol):
    def analyze(self, units: DataFrame) -> DataFrame:
        """Units (with unit_key and prompt) to the same rows with response."""


@dataclass(frozen=True)
class ReplayAnalyzer:
    """Answers from a table (unit_key, response); units without one get null."""

    responses: DataFrame

    def analyze(self, units: DataFrame) -> DataFrame:
        return units.join(self.responses, "unit_key", "left")


def _body(backend: str, model: str, system: str, prompt: str, schema: dict | None) -> dict:
    """A request in the backend's own layout; where the interface takes a schema or a JSON mode, the answer is held to it."""
    common = {"model": model, "temperature": 0}
    if backend == "openai":
        held = {"text": {"format": {"type": "json_schema", "name": "findings", "schema": schema, "strict": True}}} if schema else {}
        return {**common, "instructions": system, "input": prompt, **held}
    if backend == "anthropic":
        return {**common, "max_tokens": MAX_TOKENS, "system": system, "messages": [{"role": "user", "content": prompt}]}
    held = {"response_format": {"type": "json_object"}} if schema else {}
    return {**common, "stream": False, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}], **held}


def _headers(backend: str, key: str) -> dict[str, str]:
    own = {"x-api-key": key, "anthropic-version": "2023-06-01"} if backend == "anthropic" else {"Authorization": f"Bearer {key}"} if key else {}
    return {"Content-Type": "application/json", **own}


@dataclass(frozen=True)
class HttpAnalyzer:
    """One POST for each unit, in the executors' tasks; the answer's whole envelope is the response.

    The system prompt and the answer's schema go with every call. A call that fails for good fails its task. Only the openai backend tries again: `tries` times in all, after
    1, 2, ... seconds, on the codes of AGAIN and on network errors.
    """

    backend: str
    model: str
    key: str = ""
    url: str = ""
    system: str = SYSTEM
    schema: dict | None = field(default_factory=lambda: ANSWER_SCHEMA)
    timeout: int = 300
    tries: int = 3

    def ask(self, prompt: str, wait: Callable[[float], None] = time.sleep) -> str:
        data = json.dumps(_body(self.backend, self.model, self.system, prompt, self.schema)).encode()
        call = request.Request(self.url or URLS[self.backend], data, _headers(self.backend, self.key), method="POST")
        left = self.tries if self.backend == "openai" else 1
        for turn in range(left):
            try:
                with request.urlopen(call, timeout=self.timeout) as answer:
                    return answer.read().decode("utf-8")
            except (error.URLError, TimeoutError) as e:
                final = isinstance(e, error.HTTPError) and e.code not in AGAIN
                if final or turn == left - 1:
                    raise RuntimeError(f"{self.backend} does not answer: {e}") from e
                wait(2.0**turn)
        raise AssertionError("unreachable")

    def analyze(self, units: DataFrame) -> DataFrame:
        schema = T.StructType([*units.schema.fields, T.StructField("response", T.StringType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(response=[self.ask(p) for p in b["prompt"]])

        return units.mapInPandas(run, schema)


def build_analyzer(backend: str = "openai", model: str = "", responses: DataFrame | None = None, **options) -> Analyzer:
    """A replay of `responses` if they are given, else the backend's HTTP interface with the backend's default model."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}; known: {', '.join(BACKENDS)}")
    return ReplayAnalyzer(responses) if responses is not None else HttpAnalyzer(backend, model or DEFAULT_MODELS[backend], **options)


def record(analyzer: Analyzer, units: DataFrame, path: str) -> None:
    """Write the analyzer's answers (unit_key, response) to a table that read_responses() reads."""
    analyzer.analyze(units).select("unit_key", "response").write.mode("overwrite").parquet(path)
