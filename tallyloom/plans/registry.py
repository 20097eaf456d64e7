"""Registry of named queries and of their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: adapter views: name -> SQL text valid in both engines, sources written as ``{name}``
VIEWS: dict[str, str] = {}
QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
TWINS: dict[str, str] = {}

_SOURCE = re.compile(r"\{(\w+)\}")


class Tables:
    """Lazily opened tables and adapter views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._open: dict[str, DataFrame] = {}

    def replaced(self, **tables: DataFrame) -> Tables:
        """The same folder with other rows for some tables; views follow them."""
        other = Tables(self.spark, self.folder)
        other._open.update(tables)
        return other

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._open:
            if name in TABLES:
                self._open[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = VIEWS[name]
                sources = {s: getattr(self, s) for s in set(_SOURCE.findall(text))}
                self._open[name] = self.spark.sql(text, **sources)
        return self._open[name]


def view(name: str, text: str) -> None:
    VIEWS[name] = text.strip()


def query(name: str, twin: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``twin`` is its SQL for the checking engine."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if twin is not None:
            TWINS[name] = twin
        return fn

    return register


def _views_used(text: str, seen: list[str]) -> list[str]:
    for word in re.findall(r"\bfx_\w+", text):
        if word in VIEWS and word not in seen:
            _views_used(VIEWS[word], seen)
            if word not in seen:
                seen.append(word)
    return seen


def twin_sql(name: str) -> str:
    """The twin with the adapter views it uses put in front as common table expressions."""
    body = TWINS[name].strip()
    used = _views_used(_SOURCE.sub(lambda m: m.group(1), body), [])
    for view_name in list(used):
        _views_used(_SOURCE.sub(lambda m: m.group(1), VIEWS[view_name]), used)
    ordered: list[str] = []

    def place(view_name: str) -> None:
        for dep in _SOURCE.findall(VIEWS[view_name]):
            if dep in VIEWS:
                place(dep)
        if view_name not in ordered:
            ordered.append(view_name)

    for view_name in used:
        place(view_name)
    parts = [f"{v} AS ({_SOURCE.sub(lambda m: m.group(1), VIEWS[v])})" for v in ordered]
    recursive = ""
    if body.upper().startswith("WITH RECURSIVE "):
        recursive, body = "RECURSIVE ", "WITH " + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        parts.append(body[5:].lstrip())
        return f"WITH {recursive}" + ",\n".join(parts)
    if not parts:
        return body
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + body
