"""Scalar expressions. Each clip guards NULL, since greatest() and least() skip it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ratio_text(x: Column) -> Column:
    return F.when(x.isNull(), "N/A").otherwise(F.format_string("%.2f", x))


def money_text(x: Column) -> Column:
    """$1.50B, $2.00M, $3.00, or - for NULL."""
    return (
        F.when(x.isNull(), "-").when(x > 1e9, F.format_string("$%.2fB", x / 1e9)).when(x > 1e6, F.format_string("$%.2fM", x / 1e6))
        .otherwise(F.format_string("$%.2f", x))
    )


def fraction_text(x: Column) -> Column:
    return F.when(x.isNull(), "-").otherwise(F.format_string("%.2f%%", x * 100))


def signed_percent_text(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%+.2f%%", x))


def compact_text(x: Column) -> Column:
    """No decimals; K, M, B and T from a million on."""
    a = F.abs(x)
    return (
        F.when(x.isNull(), "-").when(a >= 1e12, F.format_string("%.0fT", x / 1e12)).when(a >= 1e9, F.format_string("%.0fB", x / 1e9))
        .when(a >= 1e6, F.format_string("%.0fM", x / 1e6)).otherwise(F.format_string("%,.0f", x))
    )


def strength(r: Column) -> Column:
    a = F.abs(r)
    return F.when(r.isNull(), None).when(a > 0.7, "Strong").when(a > 0.5, "Moderate").otherwise("Weak")


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; NULL where either side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
