"""Number parsing, scaling and identifiers as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import as_column, strip

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _number(text: Column) -> Column:
    # words such as NaN or Infinity are not marks: they count as unreadable
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def coerce_float(value) -> Column:
    """Mark cell as a double, decimal comma accepted; unreadable gives null, never 0."""
    return _number(F.replace(strip(as_column(value)), F.lit(","), F.lit(".")))


def frac(value) -> Column:
    """``1/2``, ``-1/3`` or a plain number; blank, bad or divided by zero gives null."""
    text = strip(as_column(value))
    top = _number(F.trim(F.split_part(text, F.lit("/"), F.lit(1))))
    bottom = _number(F.trim(F.split_part(text, F.lit("/"), F.lit(2))))
    return F.when(text.contains("/"), F.try_divide(top, bottom)).otherwise(_number(text))


def frac_or_zero(value) -> Column:
    return F.coalesce(frac(value), F.lit(0.0))


def suffix(value, width: int) -> Column:
    return F.right(as_column(value), F.lit(width))


def zfill(value, width) -> Column:
    """Left zeros up to ``width``; longer texts are kept whole."""
    text = as_column(value)
    size = F.lit(width) if isinstance(width, int) else width
    return F.lpad(text, F.greatest(F.length(text), size), F.lit("0"))


def strip_zeros(value) -> Column:
    return F.ltrim(as_column(value), F.lit("0"))


def rescale(raw, norm, top) -> Column:
    """``min(raw / norm, 1) * top``: capped above, not below; 0 when the norm is 0."""
    raw, norm, top = as_column(raw), as_column(norm), as_column(top)
    return F.when(F.coalesce(norm, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.least(raw / norm, F.lit(1.0)) * top)


def uncertainty(proba) -> Column:
    """0 for a firm prediction, 1 at even odds, 0.5 when there is none."""
    p = as_column(proba)
    return F.when(p.isNull(), F.lit(0.5)).otherwise(1.0 - F.abs(2.0 * p - 1.0))


def score_text(value, decimals: int = 2) -> Column:
    """Fixed decimals without trailing zeros: ``4.50`` reads ``4.5`` and ``5.00`` reads ``5``."""
    shown = F.format_string(f"%.{decimals}f", as_column(value))
    return F.regexp_replace(F.when(shown.contains("."), F.rtrim(shown, F.lit("0"))).otherwise(shown), r"\.$", "")


def general_text(value) -> Column:
    """Six significant digits, shortest form (marks between 1e-4 and 1e6)."""
    x = as_column(value)
    digits = F.format_string("%.10f", F.expr("0.0") + x)
    scale = F.when(x == 0, F.lit(0)).otherwise(5 - F.floor(F.log10(F.abs(x))).cast("int"))
    factor = F.pow(F.lit(10.0), scale)
    shown = F.format_string("%.10f", F.rint(x * factor) / factor)
    return F.coalesce(F.regexp_replace(F.rtrim(shown, F.lit("0")), r"\.$", ""), digits)


def bits_to_int(ratio, rank, width: int, threshold) -> Column:
    """Aggregate: ranked bit measures as an integer, rank 1 the most significant."""
    bit = F.lit(1).cast("bigint")
    shifted = F.call_function("shiftleft", bit, (F.lit(width) - as_column(rank)).cast("int"))
    level = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return F.coalesce(F.sum(F.when(as_column(ratio) > level, shifted)), F.lit(0).cast("bigint"))
