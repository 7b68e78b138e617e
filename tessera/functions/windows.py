"""Per-ticker window expressions over bars (ticker, dt, ...). A rolling value is NULL until its
window is full, which Spark's own frames don't do."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("dt")


def rolling(x: Column, n: int, agg: Callable[[Column], Column], count: Column | None = None) -> Column:
    w = by_ticker().rowsBetween(-(n - 1), 0)
    return F.when(F.count(x if count is None else count).over(w) == n, agg(x).over(w))


def row_index() -> Column:
    return F.row_number().over(by_ticker()) - 1


def previous(x: str) -> Column:
    return F.lag(x).over(by_ticker())


def simple_return(x: str = "close") -> Column:
    return F.col(x) / F.nullif(previous(x), F.lit(0.0)) - 1


def log_return(x: str = "close") -> Column:
    """NULL where either price isn't positive."""
    return F.when((F.col(x) > 0) & (previous(x) > 0), F.ln(F.col(x) / previous(x)))


def forward_fill(x: str = "close") -> Column:
    return F.last(x, ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))


def backward_fill(x: str = "close") -> Column:
    return F.first(x, ignorenulls=True).over(by_ticker().rowsBetween(0, Window.unboundedFollowing))


def running_sum(x: Column) -> Column:
    return F.sum(x).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))


def rsi(change: Column, n: int = 14) -> Column:
    """Simple-mean RSI; a missing first change counts as no gain and no loss."""
    up, down = F.greatest(F.coalesce(change, F.lit(0.0)), F.lit(0.0)), F.greatest(-F.coalesce(change, F.lit(0.0)), F.lit(0.0))
    gain, loss = (rolling(x, n, F.avg) for x in (up, down))
    return 100 - 100 / (1 + gain / (loss + 1e-10))


def ema(x: str = "close", alpha: float = 0.3) -> Column:
    """s = alpha x + (1 - alpha) s'. The frame reaches back to where the weight left is below a
    double's precision, whatever alpha is, so it gives the whole recursion."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    reach = 1 if alpha == 1 else math.ceil(math.log(1e-17) / math.log1p(-alpha))
    seen = F.collect_list(x).over(by_ticker().rowsBetween(-reach, 0))
    return F.aggregate(F.slice(seen, F.lit(2), F.greatest(F.size(seen) - 1, F.lit(0))), F.element_at(seen, 1), lambda s, v: (1 - alpha) * s + alpha * v)


def lookback(x: str, n: int) -> Column:
    """The n values before the row, NULL until there are n."""
    seen = F.collect_list(x).over(by_ticker().rowsBetween(-n, -1))
    return F.when(F.size(seen) == n, seen)
