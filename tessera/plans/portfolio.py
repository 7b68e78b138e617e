"""Optimising a portfolio from bars: clean, forecast, shrink, blend, allocate."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass
from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import forecast as forecasts
from tessera.operators import frontier, ml, panel, risk
from tessera.sources import store
from tessera.sources.tables import history


class InvalidRequest(ValueError):
    """A request that can't be answered."""


def date_range(start: str | None, end: str | None, as_of: date | None = None) -> tuple[str, str]:
    """The range, or the 90 days that end the day before ``as_of`` if either bound is missing."""
    today = as_of or date.today()
    if not start or not end:
        last = today - timedelta(days=1)
        return (last - timedelta(days=90)).isoformat(), last.isoformat()
    try:
        a, b = (datetime.strptime(x, "%Y-%m-%d").date() for x in (start, end))
    except ValueError as e:
        raise InvalidRequest(f"Invalid date range: {e}") from None
    if a >= b:
        raise InvalidRequest("Invalid date range: the start must be before the end")
    if b > today:
        raise InvalidRequest("Invalid date range: the end is in the future")
    return start, end


@dataclass(frozen=True)
class BenchmarkRequest:
    """A checked request to value a portfolio back."""

    weights: dict[str, float]
    prices: dict[str, float]
    budget: float
    rate: float
    start: str
    end: str


REQUIRED = ("portfolio_data", "budget", "start_date", "end_date", "risk_free_rate")


def benchmark_request(body: dict | None, as_of: date | None = None) -> BenchmarkRequest:
    """The request's values, or InvalidRequest with what is wrong: absent keys, a budget that isn't a
    positive number, a rate that isn't a number, a bad range, weights or prices absent or empty."""
    if not body:
        raise InvalidRequest("the request is empty")
    if missing := [k for k in REQUIRED if k not in body]:
        raise InvalidRequest(f"missing: {', '.join(missing)}")

    def number(name: str) -> float:
        try:
            x = float(body[name])
        except (TypeError, ValueError):
            raise InvalidRequest(f"{name} must be a number") from None
        if not np.isfinite(x):
            raise InvalidRequest(f"{name} must be a finite number")
        return x

    budget, rate = number("budget"), number("risk_free_rate")
    if budget <= 0:
        raise InvalidRequest("budget must be positive")
    start, end = date_range(body["start_date"], body["end_date"], as_of)
    held = body["portfolio_data"]
    if not isinstance(held, dict):
        raise InvalidRequest("portfolio_data must be an object")
    if missing := [k for k in ("weights", "prices") if not isinstance(held.get(k), dict) or not held[k]]:
        raise InvalidRequest(f"portfolio_data needs {' and '.join(missing)}")
    return BenchmarkRequest(held["weights"], held["prices"], budget, rate, start, end)


def days_ahead(asked) -> int:
    """Days to project: 0 for what is no number or below 0."""
    try:
        return max(int(asked), 0)
    except (TypeError, ValueError):
        return 0


def get_data(bars: DataFrame, ticker: str, start: str | None, end: str | None, regression: bool = False, future_days=0, as_of: date | None = None) -> dict[str, DataFrame]:
    """History, and if asked for the fitted line and its projection, of one ticker in one call."""
    first, last = date_range(start, end, as_of)
    seen = history(bars, [ticker], first, last)
    out = {"prices": seen.select("ticker", "dt", "close")}
    if regression:
        models = store.kept(ml.price_models(seen), "models")  # one fit for the line and the projection
        out["regression"] = ml.price_regression(seen, models)
        days = days_ahead(future_days)
        none = seen.select("ticker", "dt", F.col("close").alias("value")).where(F.lit(False))
        out["future"] = ml.price_projection(seen, days, models) if days else none
    return out


@dataclass
class Bundle:
    """All that an allocation needs and that its constraints don't change."""

    names: list[str]
    mu: np.ndarray
    sigma: np.ndarray
    uncertainty: np.ndarray
    prices: dict[str, float]


def prepare(bars: DataFrame, start: str, end: str, tickers: list[str] | None = None, method: str = "LIGHTWEIGHT") -> Bundle:
    """Forecasts, covariance and last prices of the tickers that survive cleaning."""
    seen = history(bars, tickers, start, end)
    alive = panel.liveness(seen).where("alive").select("ticker")
    clean = panel.scrub(seen.join(alive, "ticker", "left_semi")).withColumn("volume", F.lit(None).cast("double"))
    mu = {r["ticker"]: r for r in forecasts.forecast(clean, method).collect()}
    names, sigma = risk.as_matrix(risk.ledoit_wolf(clean))
    if not names:
        raise InvalidRequest("no ticker is left after cleaning")
    prices = {r["ticker"]: r["last_close"] for r in panel.ends(clean).collect()}
    return Bundle(names, np.array([mu[t]["mu"] for t in names]), sigma, np.array([mu[t]["uncertainty"] for t in names]), {t: prices[t] for t in names})


def optimise(bundle: Bundle, rate: float = 0.0, caps: dict[str, float] | None = None, delta: float = risk.DELTA, target_return: float | None = None, risk_tolerance: float | None = None) -> dict:
    """Weights, prices and figures. With caps of all tickers the forecasts are views on the implied prior."""
    mu, sigma = bundle.mu, bundle.sigma
    if caps and all(caps.get(t) for t in bundle.names):
        w = np.array([caps[t] for t in bundle.names])
        prior = delta * sigma @ (w / w.sum()) + rate
        mu, sigma = risk.posterior(sigma, prior, mu, bundle.uncertainty)
    w = frontier.allocate(mu, sigma, rate, target_return, risk_tolerance)
    kept = dict(frontier.prune(bundle.names, w))
    return {"weights": kept, "prices": {t: bundle.prices.get(t, 0.0) for t in kept}, **frontier.performance(w, mu, sigma, rate)}


class Planner:
    """Optimises portfolios, keeping the last ``most`` bundles: what only changes the constraints
    reuses forecasts and covariance, and a saved result is loaded instead of computed."""

    def __init__(self, bars: DataFrame, folder: str, groups: DataFrame | None = None, most: int = 8) -> None:
        self.bars, self.folder, self.groups, self.most = bars, folder, groups, most
        self.bundles: OrderedDict[str, Bundle] = OrderedDict()

    def bundle(self, start: str, end: str, group: str | None = None, tickers: list[str] | None = None, method: str = "LIGHTWEIGHT") -> Bundle:
        key = store.bundle_key(start, end, group, tickers, method)
        if key not in self.bundles:
            bars = self.bars
            if group is not None and self.groups is not None:
                bars = bars.join(self.groups.where(F.col("group_name") == group).select(F.col("symbol").alias("ticker")), "ticker", "left_semi")
            self.bundles[key] = prepare(bars, start, end, tickers, method)
            while len(self.bundles) > self.most:
                self.bundles.popitem(last=False)
        self.bundles.move_to_end(key)
        return self.bundles[key]

    def run(self, start: str, end: str, group: str | None = None, tickers: list[str] | None = None, method: str = "LIGHTWEIGHT", portfolio_id: str | None = None, load: bool = False, persist: bool = False, **constraints) -> DataFrame | dict:
        """The saved record if ``load`` finds one, else the new result, saved if ``persist``."""
        spark = self.bars.sparkSession
        if load and portfolio_id is not None:
            saved = store.load(spark, self.folder, portfolio_id)
            if saved is not None:
                return saved
        out = optimise(self.bundle(start, end, group, tickers, method), **constraints)
        if persist and portfolio_id is not None:
            weights = spark.createDataFrame(list(out["weights"].items()), "ticker string, weight double")
            prices = spark.createDataFrame(list(out["prices"].items()), "ticker string, close double")
            store.save(weights, prices, self.folder, portfolio_id, out, {"method": method})
        return out


def allocation(weights: DataFrame, prices: DataFrame, budget: float) -> DataFrame:
    """(ticker, amount, shares); a ticker without a price counts as price 1."""
    amount = F.col("weight") * budget
    return weights.join(prices.select("ticker", "close"), "ticker", "left").select("ticker", amount.alias("amount"), (amount / F.nullif(F.coalesce("close", F.lit(1.0)), F.lit(0.0))).alias("shares"))
