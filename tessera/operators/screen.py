"""Screening fundamentals by criteria that compile to one predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import fraction_text, money_text
from tessera.schemas import FRACTIONS, METRICS
from tessera.sources.tables import group_name

_COMPARE = {
    "Under": Column.__lt__, "<": Column.__lt__, "Over": Column.__gt__, ">": Column.__gt__, "Equals": Column.__eq__, "=": Column.__eq__,
}


def parse_value(metric: str, value) -> float | None:
    """The number of a criterion, or None if it has none. Of a fraction, more than 1 is percent."""
    try:
        x = float(str(value).replace("%", "").replace(",", "").strip())
    except ValueError:
        return None
    return x / 100 if metric in FRACTIONS and abs(x) > 1 else x


def predicate(criterion: dict) -> Column | None:
    """None where the criterion is to be skipped: incomplete, unknown or not a number."""
    metric, operator, value = (criterion.get(k) for k in ("metric", "operator", "value"))
    if not metric or not operator or value in (None, "") or metric not in METRICS or operator not in _COMPARE:
        return None
    x = parse_value(metric, value)
    return None if x is None else _COMPARE[operator](F.col(METRICS[metric]), F.lit(x))


def legacy_criteria(filters: dict[str, str]) -> list[dict]:
    """{"P/E": "Under 15"} as criteria; the key Index names the group and is no criterion."""
    out = []
    for metric, text in filters.items():
        parts = str(text).split(" ")
        if metric != "Index" and len(parts) >= 2:
            out.append({"metric": metric, "operator": parts[0], "value": parts[1]})
    return out


def screen(universe: DataFrame, criteria: list[dict], order_by: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows that meet all criteria. A missing value meets none."""
    made = [p for p in map(predicate, criteria) if p is not None]
    out = universe.where(reduce(Column.__and__, made)) if made else universe
    out = out.orderBy(F.desc_nulls_last(order_by), "ticker") if order_by else out
    return out.limit(limit) if limit is not None else out


def of_group(universe: DataFrame, groups: DataFrame, name: str | None, aliases: bool = True) -> DataFrame:
    wanted = groups.where(F.col("group_name") == (group_name(name) if aliases else name))
    return universe.join(wanted, F.col("ticker") == F.col("symbol"), "left_semi")


def formatted(rows: DataFrame) -> DataFrame:
    """Display text of every metric."""

    def text(metric: str, column: str) -> Column:
        x = F.col(column)
        if metric in FRACTIONS:
            return fraction_text(x)
        return money_text(x) if metric in ("Price", "Market Cap") else F.when(x.isNull(), "-").otherwise(F.format_string("%.2f", x))

    return rows.select("ticker", *[text(m, c).alias(f"{c}_txt") for m, c in METRICS.items()])


def export(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The tickers under the header Symbol, and their CSV file if a path is given."""
    out = rows.select(F.col("ticker").alias("Symbol"))
    if path:
        out.write.mode("overwrite").csv(path, header=True)
    return out
