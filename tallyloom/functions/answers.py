"""Matching of free answers against the accepted ones."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.numbers import NUMBER
from tallyloom.functions.text import as_column, strip

MODES = ("exact", "numeric_tol", "contains", "regex")


def _numeric(text: Column) -> Column:
    squeezed = F.replace(F.replace(strip(text), F.lit(","), F.lit(".")), F.lit(" "), F.lit(""))
    return F.when(squeezed.rlike(NUMBER), squeezed.try_cast("double"))


def match_answer(answer, expected: list[str], mode: str = "exact", tolerance: float = 0.01) -> Column:
    """True when the answer meets any alternative; no alternative gives false.

    The accepted answers belong to the key, so they are constants of the plan;
    an invalid pattern is ignored as if it were absent.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    choices = [e for e in expected if e not in (None, "")]
    text = strip(F.coalesce(as_column(answer), F.lit("")))
    found = F.lit(False)
    for choice in choices:
        if mode == "exact":
            found = found | (F.lower(text) == choice.strip().lower())
        elif mode == "contains":
            found = found | F.lower(text).contains(choice.strip().lower())
        elif mode == "numeric_tol":
            gap = F.abs(_numeric(F.lit(choice)) - _numeric(text))
            found = found | F.coalesce(gap <= F.lit(float(tolerance)), F.lit(False))
        else:
            try:
                re.compile(choice)
            except re.error:
                continue
            found = found | text.rlike(choice)
    return found


def open_answer_score(matched, points, confidence) -> tuple[Column, Column]:
    """Points of an open answer (all or nothing) and its confidence at three decimals."""
    level = F.round(as_column(confidence), 3)
    worth = points if isinstance(points, Column) else F.lit(float(points))
    return F.when(as_column(matched), worth).otherwise(F.lit(0.0)), level
