"""Forecasts by fitted models, one ticker a group: ARIMA, boosted trees, and their ensemble.

A fit's failure stays with its ticker and member, as a status (``attempt``). Fitted price models are
a table (``price_models``) that the line and the projection read.

The models are this package's own, so orders and fitted values differ from any library's;
gates, features, targets, horizons and clips are the contract. The recurrent-network member
always forecasts the constant that it is known for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import boosting, forecast, panel
from tessera.operators.boosting import Boosted, Model

YEAR = 252
NETWORK = 0.08
#: The uncertainty of a forecast that stands alone.
LONE = 0.05
LEAST_PRICES, LEAST_ROWS = 100, 50
REGRESSORS = ["t", "ma7", "ma21", "lag1", "volume"]


def arma(x: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Hannan-Rissanen: coefficients (constant, p lags, q shocks), residuals and AIC."""
    n = len(x)
    long = min(max(p + q + 2, 5), max(n // 3, 1))

    def lagged(s, k, start):
        return [s[start - i - 1 : n - i - 1] for i in range(k)]

    first = np.column_stack([np.ones(n - long), *lagged(x, long, long)])
    shocks = np.zeros(n)
    shocks[long:] = x[long:] - first @ np.linalg.lstsq(first, x[long:], rcond=None)[0]
    start = long + q
    design = np.column_stack([np.ones(n - start), *lagged(x, p, start), *lagged(shocks, q, start)])
    beta = np.linalg.lstsq(design, x[start:], rcond=None)[0]
    e = x[start:] - design @ beta
    shocks[start:] = e
    return beta, shocks, len(e) * np.log(max(float(e @ e) / max(len(e), 1), 1e-300)) + 2 * (p + q + 1)


def arima_forecast(prices: np.ndarray) -> tuple[float, float]:
    """(annual log return, uncertainty): the sum of 252 forecast log returns, and their deviation
    times sqrt(252), at least 0.01. Below 10 prices (0.05, 0.15); where no model fits, the
    log-linear trend a year on."""
    prices = prices[np.isfinite(prices)]
    if len(prices) < 10 or (prices <= 0).any():
        return 0.05, 0.15
    logs = np.log(prices)
    try:
        d = 0
        x = np.diff(logs)
        while d < 2 and len(x) > 10 and np.var(np.diff(x)) < np.var(x):
            x, d = np.diff(x), d + 1
        fits = [(arma(x, p, q), p, q) for p in range(4) for q in range(4) if len(x) > 3 * (p + q + 3)]
        (beta, shocks, _), p, q = min(fits, key=lambda f: f[0][2])
        past, e, out = list(x), list(shocks), []
        bound = 10 * max(np.abs(x).max(), 1e-12)
        for _ in range(YEAR):
            v = beta[0] + sum(beta[1 + i] * past[-1 - i] for i in range(p)) + sum(beta[1 + p + i] * e[-1 - i] for i in range(q))
            out.append(float(np.clip(v, -bound, bound)))
            past.append(out[-1])
            e.append(0.0)
        r = np.array(out)
        base = np.diff(logs)
        for k in range(d):
            r = np.cumsum(r) + np.diff(base, d - 1 - k)[-1]
        if not np.isfinite(r).all():
            raise ValueError("the forecast diverges")
        return float(r.sum()), max(float(r.std() * np.sqrt(YEAR)), 0.01)
    except (ValueError, np.linalg.LinAlgError):
        t = np.arange(len(logs))
        slope, icpt = np.polyfit(t, logs, 1)
        return float(slope * (len(logs) + YEAR) + icpt - logs[-1]), 0.15


def boost_forecast(rows: pd.DataFrame) -> float:
    """252 times the prediction at the mean of the features, clipped to +-0.69; 0.08 below the gates.
    Rows with a feature that isn't finite are left out."""
    x = rows[panel.FEATURES + ["target"]].replace([np.inf, -np.inf], np.nan).dropna()
    if len(rows) < LEAST_PRICES or len(x) < LEAST_ROWS:
        return NETWORK
    model = Boosted().fit(x[panel.FEATURES].to_numpy(), x["target"].to_numpy())
    return float(np.clip(YEAR * model.predict(x[panel.FEATURES].mean().to_numpy()[None, :])[0], -0.69, 0.69))


def spread(bars: DataFrame) -> DataFrame:
    """``bars`` dealt by ticker to a stated number of partitions. Fits are heavy and rows light, so
    the adaptive planner, which goes by bytes, would merge all tickers into one task; a stated number
    it leaves alone, and the windows and groups by ticker that follow need no further shuffle."""
    session = bars.sparkSession
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    return bars.repartition(n, "ticker")


def _per_ticker(rows: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return rows.groupBy("ticker").applyInPandas(lambda group: f(group.sort_values("dt")), schema)


FORECAST = "ticker string, mu double, uncertainty double, status string"


def attempt(fit: Callable[[pd.DataFrame], tuple[float, float]], rows: pd.DataFrame) -> tuple[float | None, float | None, str]:
    """(value, uncertainty, status) of one member on one ticker. What it raises stays here: the status
    says it and the value is None, as it is for a forecast that isn't finite."""
    try:
        mu, u = fit(rows)
    except Exception as error:  # any member, any failure: the other tickers go on
        return None, None, f"failed: {type(error).__name__}: {error}"[:200]
    return (float(mu), float(u), "ok") if np.isfinite(mu) else (None, None, "not finite")


def fitted(rows: DataFrame, fit: Callable[[pd.DataFrame], tuple[float, float]]) -> DataFrame:
    """(ticker, mu, uncertainty, status) by ``fit`` of each ticker's rows, failures kept in their own group."""

    def f(group: pd.DataFrame) -> pd.DataFrame:
        mu, u, status = attempt(fit, group)
        return pd.DataFrame({"ticker": [group["ticker"].iloc[0]], "mu": [mu], "uncertainty": [u], "status": [status]}).astype({"mu": float, "uncertainty": float})

    return _per_ticker(rows, f, FORECAST)


def _arima(rows: pd.DataFrame) -> tuple[float, float]:
    return arima_forecast(rows["close"].dropna().to_numpy())


def _boost(rows: pd.DataFrame) -> tuple[float, float]:
    return boost_forecast(rows), LONE


def _network(rows: pd.DataFrame) -> tuple[float, float]:
    return NETWORK, LONE


#: The ensemble's members: each gives (forecast, its own uncertainty) of one ticker's features and closes.
MEMBERS = {"arima": _arima, "boost": _boost, "network": _network}


def _answered(fits: DataFrame, bars: DataFrame) -> DataFrame:
    """Fits without status: a ticker whose fit failed has the lightweight forecast."""
    light = forecast.lightweight(bars).select("ticker", F.col("mu").alias("l"))
    failed = F.col("status") != "ok"
    return fits.join(light, "ticker").select("ticker", F.when(failed, F.col("l")).otherwise(F.col("mu")).alias("mu"), F.when(failed, LONE).otherwise(F.col("uncertainty")).alias("uncertainty"))


def arima(bars: DataFrame) -> DataFrame:
    """(ticker, mu, uncertainty); the lightweight forecast where the fit fails."""
    bars = spread(bars.select("ticker", "dt", "close"))
    return _answered(fitted(bars, _arima), bars)


def boost(bars: DataFrame) -> DataFrame:
    """(ticker, mu, uncertainty); the lightweight forecast where the fit fails."""
    bars = spread(bars.select("ticker", "dt", "close"))
    return _answered(fitted(panel.ml_features(bars), _boost), bars)


def vote(members: DataFrame) -> DataFrame:
    """(ticker, mu, uncertainty, members) from ``members`` (ticker, f; one row a member's forecast): mean
    and population deviation of the finite forecasts; 0.05 for a single one, (0.08, 0.05) for none."""
    f = F.when(~F.isnan("f") & (F.abs("f") != float("inf")), F.col("f"))
    got = members.groupBy("ticker").agg(F.count(f).alias("members"), F.avg(f).alias("m"), F.stddev_pop(f).alias("sd"))
    return got.select("ticker", F.coalesce("m", F.lit(NETWORK)).alias("mu"), F.when(F.col("members") > 1, F.col("sd")).otherwise(LONE).alias("uncertainty"), "members")


def member_forecasts(bars: DataFrame, members: dict[str, Callable] | None = None) -> DataFrame:
    """(ticker, n, member, f, status) of the closes that are there: every member on every ticker of at least
    ``LEAST_PRICES`` of them, in one pass over the ticker's rows; for other tickers no row."""
    members = MEMBERS if members is None else members

    def f(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["close"].count())
        tried = {name: attempt(fit, group) for name, fit in members.items()} if n >= LEAST_PRICES else {}
        return pd.DataFrame([(group["ticker"].iloc[0], n, name, mu, status) for name, (mu, _, status) in tried.items()], columns=["ticker", "n", "member", "f", "status"]).astype({"f": float})

    seen = spread(bars.where("close is not null").select("ticker", "dt", "close"))
    return _per_ticker(panel.ml_features(seen, "close"), f, "ticker string, n long, member string, f double, status string")


def ensemble(bars: DataFrame, members: dict[str, Callable] | None = None) -> DataFrame:
    """The vote of the members. Tickers with fewer than 100 prices, or with no answer from the group at
    all, get the lightweight forecast and 0.05."""
    seen = bars.where("close is not null")
    light = forecast.lightweight(spread(seen.select("ticker", "dt", "close"))).select("ticker", F.col("mu").alias("l"))
    voted = light.join(vote(member_forecasts(bars, members)), "ticker", "left")
    return voted.select("ticker", F.coalesce("mu", "l").alias("mu"), F.coalesce("uncertainty", F.lit(LONE)).alias("uncertainty"))


def fit_prices(rows: pd.DataFrame) -> Model:
    """The model of daily changes: 100 trees, rate 0.1, up to 31 leaves of at least 20 rows."""
    x = rows[REGRESSORS + ["change"]].replace([np.inf, -np.inf], np.nan).dropna()
    return Boosted(leaves=31, depth=None, penalty=0.0, least=20).fit(x[REGRESSORS].to_numpy(float), x["change"].to_numpy(float))


def price_models(bars: DataFrame) -> DataFrame:
    """One row a ticker: its model (``boosting.SCHEMA``), and where it starts and ends: ``first_close``, and
    the last row's date, close and regressors. A ticker whose fit fails has its message in ``status`` and no
    model. Keep it (``store.kept``) where more than one result reads it."""
    fit = fit_prices

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        last = rows.iloc[-1]
        out = {"ticker": last["ticker"], "first_close": float(rows["close"].iloc[0]), "last_dt": last["dt"], "last_close": float(last["close"]), "last_x": [float(v) for v in last[REGRESSORS]]}
        try:
            out |= fit(rows).row() | {"status": "ok"}
        except Exception as error:  # stays with its ticker
            out |= dict.fromkeys(boosting.COLUMNS) | {"status": f"failed: {type(error).__name__}: {error}"[:200]}
        return pd.DataFrame([out])

    schema = f"ticker string, first_close double, last_dt date, last_close double, last_x array<double>, {boosting.SCHEMA}, status string"
    return _per_ticker(panel.regression_features(spread(bars)), f, schema)


def price_regression(bars: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """(ticker, dt, value): the first kept close plus the running sum of predicted changes. ``models`` are
    those of ``price_models``; a ticker without a model has no line."""

    def f(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or model.empty:
            return pd.DataFrame(columns=["ticker", "dt", "value"], dtype=object)
        rows, model = rows.sort_values("dt"), model.iloc[0]
        line = model["first_close"] + np.cumsum(Model.of(model).predict(rows[REGRESSORS].to_numpy(float)))
        return pd.DataFrame({"ticker": rows["ticker"], "dt": rows["dt"], "value": line})

    models = (price_models(bars) if models is None else models).where("status = 'ok'")
    rows = panel.regression_features(spread(bars))
    return rows.groupBy("ticker").cogroup(models.groupBy("ticker")).applyInPandas(f, "ticker string, dt date, value double")


def price_projection(bars: DataFrame, days: int, models: DataFrame | None = None) -> DataFrame:
    """(ticker, dt, value) for each of the next calendar days: predict the change, add it, move
    time and lag on; averages and volume stay. Reads the model table only."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        model, x, price, out = Model.of(row), np.array(row["last_x"], float), float(row["last_close"]), []
        for _ in range(days):
            x[0] += 1
            x[3] = price
            price += float(model.predict(x[None, :])[0])
            out.append(price)
        dates = [pd.Timestamp(row["last_dt"]).date() + pd.Timedelta(days=i + 1) for i in range(days)]
        return pd.DataFrame({"ticker": row["ticker"], "dt": dates, "value": out})

    models = (price_models(bars) if models is None else models).where("status = 'ok'")
    return models.groupBy("ticker").applyInPandas(f, "ticker string, dt date, value double")
