"""Hand-worked cases, gates, boundaries and properties."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.functions.pvalue import incomplete_beta
from tessera.operators import benchmark, boosting, forecast, frontier, hedge, ml, panel, risk, screen
from tessera.plans import portfolio
from tessera.sources import store, tables

DAY = dt.date(2024, 1, 1)


def bars_of(spark, series: dict[str, list], start=DAY):
    rows = [(t, start + dt.timedelta(days=i), None if v is None else float(v), 1.0) for t, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, dt date, close double, volume double")


def walk(n: int, seed: int = 42, drift: float = 0.0005, sigma: float = 0.01) -> np.ndarray:
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(drift, sigma, n)))


# --- goldens -----------------------------------------------------------------------------------


def test_golden_benchmark(spark):
    bars = bars_of(spark, {"A": [100, 105, 110]})
    weights = spark.createDataFrame([("A", 1.0)], "ticker string, weight double")
    got = benchmark.summary(benchmark.portfolio(bars, weights, 10_000).withColumn("series", F.lit("portfolio")), 10_000).first()
    assert (got["final"], got["pl"]) == (11_000, 1_000) and math.isclose(got["pct"], 10)


def test_golden_riskfree(spark):
    idx = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(days=365),)], "dt date").withColumn("close", F.lit(1.0))
    got = benchmark.riskfree(idx.withColumn("ticker", F.lit("A")), idx, 10_000, 0.04, "2024-01-01").orderBy("dt").collect()
    assert [round(r["value"], 6) for r in got] == [10_000, 10_400]


def test_missing_first_price_buys_nothing(spark):
    bars = bars_of(spark, {"A": [0, 105], "B": [10, 20]})
    weights = spark.createDataFrame([("A", 0.5), ("B", 0.5), ("C", 0.0)], "ticker string, weight double")
    assert {r["ticker"]: r["shares"] for r in benchmark.shares(bars, weights, 100).collect()} == {"A": 0.0, "B": 5.0}


# --- forecasts: gates and twins ------------------------------------------------------------------


def test_forecast_gates(spark):
    lengths = {f"T{n}": list(walk(n)) for n in (1, 2, 9, 10, 29, 30)}
    bars = bars_of(spark, lengths)
    cagr = {r["ticker"]: r["mu"] for r in forecast.cagr(bars).collect()}
    assert cagr["T1"] == 0 and math.isclose(cagr["T2"], (lengths["T2"][1] / lengths["T2"][0]) ** 126 - 1)
    light = {r["ticker"]: r["mu"] for r in forecast.lightweight(bars).collect()}
    assert light["T9"] == 0.05 and light["T10"] != 0.05
    voladj = {r["ticker"]: r["f"] for r in forecast.vol_adjusted(bars).collect()}
    assert voladj["T29"] == 0.05 and voladj["T30"] != 0.05
    assert {r["ticker"]: r["f"] for r in forecast.trend(bars).collect()}["T9"] == 0.05
    assert forecast.cagr(bars_of(spark, {"Z": [5, 0]})).first()["mu"] == -0.99


def test_smoothing_equals_the_recursion(spark):
    p = walk(400)
    s = [p[0]]
    for x in p[1:]:
        s.append(0.3 * x + 0.7 * s[-1])
    from tessera.functions.windows import ema

    got = [r["e"] for r in bars_of(spark, {"A": list(p)}).select("dt", ema().alias("e")).orderBy("dt").collect()]
    assert np.allclose(got, s, rtol=1e-13)
    last = np.array(s[-30:])
    slope, icpt = np.polyfit(np.arange(30), last, 1)
    want = (icpt + slope * 282) / last[-1] - 1
    assert math.isclose(forecast.exp_smoothing(bars_of(spark, {"A": list(p)})).first()["f"], want, rel_tol=1e-9)


def test_rsi_equals_plain_python(spark):
    p = walk(60)
    d = np.concatenate([[0], np.diff(p)])
    want = [None if i < 13 else 100 - 100 / (1 + np.maximum(d[i - 13 : i + 1], 0).mean() / (np.maximum(-d[i - 13 : i + 1], 0).mean() + 1e-10)) for i in range(60)]
    from tessera.functions import windows as W

    got = bars_of(spark, {"A": list(p)}).withColumn("change", F.col("close") - W.previous("close")).select("dt", W.rsi(F.col("change")).alias("r")).orderBy("dt").collect()
    assert [r["r"] is None for r in got] == [w is None for w in want]
    assert np.allclose([r["r"] for r in got if r["r"] is not None], [w for w in want if w is not None])


def test_method_router(spark):
    bars = bars_of(spark, {"A": list(walk(120))})
    for method, name in (("HISTORICAL", "historical"), ("MPT", "historical"), ("Lightweight", "lightweight"), ("anything", "lightweight"), ("Ensemble", "ensemble")):
        assert forecast.forecast(bars, method).first()["method"] == name
    assert forecast.forecast(bars_of(spark, {"A": list(walk(50))}), "DEEP_LEARNING").first()["uncertainty"] == 0.05


def test_boosting_learns_and_arima_falls_back():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 3))
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + 0.5 * x[:, 1]
    assert np.mean((ml.Boosted().fit(x, y).predict(x) - y) ** 2) < 0.1 * y.var()
    assert ml.arima_forecast(np.arange(1.0, 6.0)) == (0.05, 0.15)
    mu, u = ml.arima_forecast(walk(500))
    assert np.isfinite(mu) and u >= 0.01


def test_projection_runs_over_calendar_days(spark):
    got = ml.price_projection(bars_of(spark, {"A": list(walk(60))}), 5).orderBy("dt").collect()
    assert [r["dt"] for r in got] == [DAY + dt.timedelta(days=60 + i) for i in range(5)]


def exact_tree(x, y, leaves, least, penalty):
    """Best-first regression tree by plain search over all values: the prediction of every row."""
    parts, value = [np.arange(len(y))], lambda r: y[r].sum() / (len(r) + penalty)

    def score(r):
        return y[r].sum() ** 2 / (len(r) + penalty)

    while len(parts) < leaves:
        best = (1e-12, None)
        for k, rows in enumerate(parts):
            for j in range(x.shape[1]):
                for cut in np.unique(x[rows, j])[:-1]:
                    lo, hi = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                    if min(len(lo), len(hi)) >= least and score(lo) + score(hi) - score(rows) > best[0] + 1e-9:
                        best = (score(lo) + score(hi) - score(rows), (k, lo, hi))
        if best[1] is None:
            break
        k, lo, hi = best[1]
        parts[k : k + 1] = [lo, hi]
    out = np.zeros(len(y))
    for rows in parts:
        out[rows] = value(rows)
    return out


@pytest.mark.parametrize("leaves, least, penalty", [(2, 1, 1.0), (7, 1, 0.0), (31, 3, 1.0)])
def test_trees_grow_best_leaf_first(leaves, least, penalty):
    rng = np.random.default_rng(leaves)
    x = rng.normal(size=(60, 3))
    y = rng.normal(size=60) + 2 * (x[:, 0] > 0.3) * (x[:, 1] < 0)
    got = boosting.Boosted(trees=1, leaves=leaves, depth=None, rate=1.0, penalty=penalty, least=least).fit(x, y)
    assert np.allclose(got.predict(x), y.mean() + exact_tree(x, y - y.mean(), leaves, least, penalty))
    assert (got.feature < 0).sum() <= leaves
    deep = boosting.Boosted(leaves=31, depth=None, penalty=0.0, least=20).fit(*(lambda z: (z, z[:, 0] ** 2 + z[:, 1]))(rng.normal(size=(2000, 2))))
    assert max(np.diff(np.append(deep.roots, len(deep.feature)))) == 61  # 31 leaves and 30 splits
    again = boosting.Model.of(deep.row())
    assert np.array_equal(again.predict(x[:, :2]), deep.predict(x[:, :2]))


def test_boosting_refuses_what_is_not_finite():
    for x, y in ((np.zeros((0, 2)), np.zeros(0)), (np.array([[np.inf], [1.0]]), np.ones(2)), (np.ones((2, 1)), np.array([np.nan, 1.0]))):
        with pytest.raises(ValueError):
            boosting.Boosted().fit(x, y)


def test_vote_leaves_out_what_is_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    given = {"all": [0.1, 0.2, 0.6], "two": [0.1, inf, 0.3], "one": [nan, 0.4, None], "none": [None, -inf, nan]}
    got = {r["ticker"]: (r["mu"], r["uncertainty"], r["members"]) for r in ml.vote(spark.createDataFrame([(t, x) for t, v in given.items() for x in v], "ticker string, f double")).collect()}
    assert got["all"] == pytest.approx((0.3, np.std([0.1, 0.2, 0.6]), 3)) and got["two"] == pytest.approx((0.2, 0.1, 2))
    assert got["one"] == (0.4, 0.05, 1) and got["none"] == (0.08, 0.05, 0)


def test_a_failing_member_stays_in_its_group(spark):
    prices = walk(160)

    def raising(rows):
        if rows["ticker"].iloc[0] == "B":
            raise RuntimeError("no fit")
        return 0.4, 0.05

    def endless(rows):
        return float("inf"), 0.05

    bars = bars_of(spark, {"A": list(prices), "B": list(prices), "few": list(prices[:50])})
    members = {"raising": raising, "endless": endless, "steady": lambda rows: (0.2, 0.05)}
    status = {(r["ticker"], r["member"]): (r["f"], r["status"]) for r in ml.member_forecasts(bars, members).collect()}
    assert status[("A", "raising")] == (0.4, "ok") and status[("A", "endless")] == (None, "not finite") and status[("B", "raising")] == (None, "failed: RuntimeError: no fit")
    assert {t for t, _ in status} == {"A", "B"}
    got = {r["ticker"]: (r["mu"], r["uncertainty"]) for r in ml.ensemble(bars, members).collect()}
    assert got["A"] == pytest.approx((0.3, 0.1)) and got["B"] == pytest.approx((0.2, 0.05))
    light = {r["ticker"]: r["mu"] for r in forecast.lightweight(bars).collect()}
    assert got["few"] == (light["few"], 0.05)
    assert {r["ticker"]: (r["mu"], r["uncertainty"]) for r in ml.ensemble(bars, {"endless": endless}).collect()}["A"] == (0.08, 0.05)
    fits = {r["ticker"]: r for r in ml.fitted(bars, raising).collect()}
    assert fits["B"]["mu"] is None and fits["A"]["mu"] == 0.4


def test_an_infinite_price_spares_the_other_members(spark):
    prices = list(walk(200))
    bars = bars_of(spark, {"A": prices, "B": prices[:120] + [float("inf")] + prices[121:]})
    got = {r["ticker"]: r for r in ml.ensemble(bars).collect()}
    members = {(r["ticker"], r["member"]): r["f"] for r in ml.member_forecasts(bars).collect()}
    for t in "AB":
        mine = [v for (who, _), v in members.items() if who == t and v is not None]
        assert len(mine) >= 2 and got[t]["mu"] == pytest.approx(np.mean(mine)) and got[t]["uncertainty"] == pytest.approx(np.std(mine))


def test_fits_are_spread_over_tasks(spark):
    bars = bars_of(spark, {f"T{k:02}": list(walk(130, k)) for k in range(25)})
    where = ml.fitted(ml.spread(bars), lambda rows: (0.1, 0.05)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert where > 4


def test_one_fit_for_line_and_projection(spark, tmp_path, monkeypatch):
    folder, plain = str(tmp_path), ml.fit_prices

    def counting(rows):
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return plain(rows)

    monkeypatch.setattr(ml, "fit_prices", counting)
    bars = bars_of(spark, {"A": list(walk(80)), "B": list(walk(80, 1))})
    got = portfolio.get_data(bars, "A", "2024-01-01", "2024-03-15", regression=True, future_days=5)
    assert got["regression"].count() == 54 and got["future"].count() == 5 and got["future"].count() == 5
    assert len(list(tmp_path.iterdir())) == 1


def test_a_ticker_without_a_model_has_no_line(spark, monkeypatch):
    plain = ml.fit_prices

    def picky(rows):
        if rows["ticker"].iloc[0] == "B":
            raise ValueError("no model")
        return plain(rows)

    monkeypatch.setattr(ml, "fit_prices", picky)
    bars = bars_of(spark, {"A": list(walk(60)), "B": list(walk(60, 1))})
    assert {r["ticker"]: r["status"] for r in ml.price_models(bars).collect()} == {"A": "ok", "B": "failed: ValueError: no model"}
    assert [r[0] for r in ml.price_regression(bars).select("ticker").distinct().collect()] == ["A"] and ml.price_projection(bars, 3).count() == 3


# --- panels --------------------------------------------------------------------------------------


def test_scrub_edges(spark):
    bars = bars_of(spark, {"ok": [1, 0, 3], "gone": [None, None, None], "huge": [1, 2e8, 1], "late": [None, 2, float("inf")]})
    got = {(r["ticker"], (r["dt"] - DAY).days): r["close"] for r in panel.scrub(bars).collect()}
    assert got == {("ok", 0): 1, ("ok", 1): 1, ("ok", 2): 3, ("late", 0): 2, ("late", 1): 2, ("late", 2): 2}


def test_liveness_limit(spark):
    bars = bars_of(spark, {"a": [1] * 30, "b": [1] * 16, "c": [1] * 15})
    assert {r["ticker"]: r["alive"] for r in panel.liveness(bars).collect()} == {"a": True, "b": True, "c": False}
    assert all(r["alive"] for r in panel.liveness(bars, strict=False).collect())


def test_rolling_waits_for_a_full_window(spark):
    got = [r["ma7"] for r in bars_of(spark, {"A": range(1, 10)}).select("dt", __import__("tessera.functions.windows", fromlist=["x"]).rolling(F.col("close"), 7, F.avg).alias("ma7")).orderBy("dt").collect()]
    assert got == [None] * 6 + [4, 5, 6]


# --- screener ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "metric, value, want",
    [("ROE", "15", 0.15), ("ROE", "1", 1.0), ("ROE", "-15", -0.15), ("ROE", "0.5%", 0.5), ("Price", "1,000", 1000.0), ("Price", "abc", None), ("P/E", "15", 15.0), ("Price", "1_000", 1000.0)],
)
def test_values(metric, value, want):
    assert screen.parse_value(metric, value) == want


def test_screen_skips_and_drops(spark):
    rows = spark.createDataFrame([("a", 10.0, 0.2), ("b", None, 0.3), ("c", 20.0, None)], "ticker string, pe double, roe double")
    pick = lambda *c: sorted(r["ticker"] for r in screen.screen(rows, list(c)).collect())
    under = {"metric": "P/E", "operator": "Under", "value": "15"}
    assert pick(under) == ["a"]
    assert pick({"metric": "P/E", "operator": "About", "value": "15"}, {"metric": "x", "operator": "Over", "value": "1"}, {"metric": "P/E"}) == ["a", "b", "c"]
    assert pick({"metric": "ROE", "operator": "Over", "value": "25"}, under) == pick(under, {"metric": "ROE", "operator": "Over", "value": "25"}) == []
    assert screen.legacy_criteria({"Index": "Dow", "P/E": "Under 15 please", "ROE": "Over"}) == [under]


def test_group_aliases():
    assert [tables.group_name(x) for x in ("DJIA", "Dow Jones", "S&P 500", "SP500", None, "")] == ["Dow", "Dow", "S&P", "S&P", "S&P", "S&P"]


def test_tickers_are_sanitised(spark):
    dirty = spark.createDataFrame([(x,) for x in ("AAPL\\", " msft ", "{\\rtf1", "BRK-B", "^GSPC", "A B")], "symbol string")
    assert sorted(r[0] for r in tables.sanitise(dirty).collect()) == ["AAPL", "BRK-B", "^GSPC", "msft"]


def test_ticker_files(spark, tmp_path):
    (tmp_path / "group.csv").write_text("Symbol\nAAPL\nBAC PRK\nAAPL\n")
    assert [r[0] for r in tables.read_group(spark, str(tmp_path / "group.csv")).collect()] == ["AAPL"]
    (tmp_path / "list.txt").write_text("{\\rtf1\nAAPL, MSFT\\\nIBM\n")
    assert sorted(r[0] for r in tables.read_ticker_list(spark, str(tmp_path / "list.txt")).collect()) == ["AAPL", "IBM", "MSFT"]


# --- hedge ---------------------------------------------------------------------------------------


def test_opposite_series_are_a_hedge(spark):
    r = np.random.default_rng(3).normal(0, 0.02, 80)
    up, down = 100 * np.cumprod(1 + r), 100 * np.cumprod(1 - r + np.random.default_rng(4).normal(0, 0.001, 80))
    got = hedge.report(bars_of(spark, {"A": list(up), "B": list(down)}), "A", "B").first()
    assert got["is_hedge"] == 1 and got["strength"] == "Strong" and got["r"] < -0.95 and got["p"] < 1e-6
    with pytest.raises(ValueError):
        hedge.report(bars_of(spark, {"A": [1, 2]}), "A", "Z")


def test_constant_series_have_no_correlation(spark):
    got = hedge.pair(bars_of(spark, {"A": [1, 2, 1, 2], "B": [5, 5, 5, 5]}), "A", "B").first()
    assert got["r"] is None and got["is_hedge"] == 0 and got["strength"] is None


def test_incomplete_beta():
    assert math.isclose(incomplete_beta(2, 3, 0.4), 0.5248, rel_tol=1e-12)
    assert math.isclose(incomplete_beta(0.5, 0.5, 0.25), 2 / math.pi * math.asin(0.5), rel_tol=1e-12)
    assert math.isclose(incomplete_beta(5, 0.5, 0.9), 1 - incomplete_beta(0.5, 5, 0.1), rel_tol=1e-12)


# --- risk and allocation -----------------------------------------------------------------------


def panel_of(n: int, days: int = 120, seed: int = 5) -> dict[str, list[float]]:
    rng = np.random.default_rng(seed)
    common = rng.normal(0, 0.01, days)
    return {f"T{i:02}": list(100 * np.cumprod(1 + 0.0006 * (i % 5) + 0.6 * common + rng.normal(0, 0.008 + 0.002 * i, days))) for i in range(n)}


def test_ledoit_wolf_equals_numpy(spark):
    series = panel_of(6)
    names, got = risk.as_matrix(lw := risk.ledoit_wolf(bars_of(spark, series)))
    p = np.array([series[t] for t in names]).T
    x = p[1:] / p[:-1] - 1
    x = x - x.mean(0)
    n, k = x.shape
    e = x.T @ x / n
    m = np.trace(e) / k
    beta = (((x**2).T @ x**2).sum() / n - (e**2).sum()) / (k * n)
    delta = ((e**2).sum() - 2 * m * np.trace(e) + k * m * m) / k
    s = min(beta, delta) / delta
    assert np.allclose(got, 252 * ((1 - s) * e + s * m * np.eye(k)), rtol=1e-9)
    assert 0 <= lw.first()["shrinkage"] <= 1 and np.linalg.eigvalsh(got).min() > 0


def test_posterior_limits():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(5, 5))
    sigma, pi, q = a @ a.T / 10 + np.eye(5) * 0.01, rng.normal(size=5), rng.normal(size=5)
    assert np.allclose(risk.posterior(sigma, pi, q, np.full(5, 1e4))[0], pi, atol=1e-4)
    assert np.allclose(risk.posterior(sigma * 1e4, pi, q, np.full(5, 1e-9))[0], q, atol=1e-4)


def _kkt(w, grad, cap, tolerance=1e-4):
    """At the optimum all inner weights have one gradient, those at 0 no less, those at the cap no more."""
    inner = (w > 1e-4) & (w < cap - 1e-4)
    if inner.any():
        level = grad[inner].mean()
        assert np.abs(grad[inner] - level).max() < tolerance
        assert (grad[w <= 1e-4] > level - tolerance).all() and (grad[w >= cap - 1e-4] < level + tolerance).all()


@settings(max_examples=12, deadline=None)
@given(st.integers(6, 14), st.integers(0, 1000))
def test_frontier(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n + 3)) * 0.1
    sigma, mu = a @ a.T + np.eye(n) * 1e-3, rng.normal(0.08, 0.05, n)
    mu[0] = abs(mu[0]) + 0.1
    feasible = lambda w: abs(w.sum() - 1) < 1e-6 and w.min() >= -1e-9 and w.max() <= 0.2 + 1e-6
    w = frontier.efficient_return(mu, sigma, -1.0)
    assert feasible(w)
    _kkt(w, 2 * (sigma + 0.05 * np.eye(n)) @ w, 0.2)
    goal = float(np.sort(mu)[-5:].mean()) * 0.9 + mu.mean() * 0.1
    assert frontier.efficient_return(mu, sigma, goal) @ mu >= goal - 1e-6
    loose = frontier.efficient_risk(mu, sigma, 10.0)
    assert feasible(loose)
    tight = float(np.sqrt(w @ sigma @ w)) * 1.05
    x = frontier.efficient_risk(mu, sigma, tight)
    assert feasible(x) and np.sqrt(x @ sigma @ x) <= tight + 1e-6
    if np.sort(mu)[-5:].mean() > 0.0:
        s = frontier.max_sharpe(mu, sigma, 0.0)
        assert feasible(s)
        full = sigma + 0.05 * np.eye(n)
        ratio = lambda v: v @ mu / np.sqrt(v @ full @ v)
        assert all(ratio(s) >= ratio(v) - 1e-5 for v in (w, loose, x))


def test_cap_decides_feasibility():
    mu, sigma = np.linspace(0.05, 0.1, 5), np.diag(np.linspace(0.01, 0.05, 5))
    assert np.allclose(frontier.max_sharpe(mu, sigma, 0.01), 0.2)
    with pytest.raises(frontier.Infeasible):
        frontier.max_sharpe(mu[:4], sigma[:4, :4], 0.01)
    with pytest.raises(frontier.Infeasible):
        frontier.max_sharpe(mu, sigma, 0.5)
    assert np.allclose(frontier.allocate(mu, sigma, 0.01, target_return=0, risk_tolerance=0), 0.2)
    assert frontier.prune(["a", "b"], np.array([0.99995, 5e-5])) == [("a", 0.99995)]


def test_optimise_end_to_end(spark):
    bars = bars_of(spark, panel_of(8))
    bundle = portfolio.prepare(bars, "2024-01-01", "2024-06-01")
    got = portfolio.optimise(bundle, 0.0, target_return=None, caps={t: 1e9 for t in bundle.names})
    assert abs(sum(got["weights"].values()) - 1) < 1e-3 and max(got["weights"].values()) <= 0.2 + 1e-5
    assert got["risk"] > 0 and set(got["prices"]) == set(got["weights"])


def test_date_range():
    today = dt.date(2024, 5, 1)
    assert portfolio.date_range(None, "2024-01-01", today) == ("2024-01-31", "2024-04-30")
    assert portfolio.date_range("2024-01-01", "2024-02-01", today) == ("2024-01-01", "2024-02-01")
    for bad in (("2024-02-01", "2024-02-01"), ("2024-01-01", "2024-06-01"), ("x", "2024-01-01")):
        with pytest.raises(portfolio.InvalidRequest, match="Invalid date range"):
            portfolio.date_range(*bad, today)


def test_saved_results(spark, tmp_path):
    weights = spark.createDataFrame([("A", 0.6), ("B", 0.4)], "ticker string, weight double")
    folder = str(tmp_path / "saved")
    assert store.saved_ids(spark, folder) == [] and store.load(spark, folder, "x") is None
    store.save(weights, None, folder, "p2", {"return": 0.1, "risk": 0.2, "sharpe_ratio": 0.5}, {"method": "m"}, "2024-01-01T00:00:00Z")
    store.save(weights, None, folder, "p1")
    assert store.saved_ids(spark, folder) == ["p1", "p2"]
    got = store.load(spark, folder, "p2").first()
    assert got["result"]["weights"] == {"A": 0.6, "B": 0.4} and got["metadata"] == {"method": "m"} and got["saved_at"] == "2024-01-01T00:00:00Z"
    assert store.bundle_key("a", "b", None, ["x", "y"], "m") == store.bundle_key("a", "b", None, ["y", "x"], "m")


def test_texts(spark):
    row = spark.range(1).select(
        scalars.ratio_text(F.lit(None).cast("double")).alias("a"), scalars.ratio_text(F.lit(1.256)).alias("b"), scalars.money_text(F.lit(2.5e9)).alias("c"), scalars.money_text(F.lit(3e6)).alias("d"),
        scalars.money_text(F.lit(12.0)).alias("e"), scalars.fraction_text(F.lit(0.123)).alias("f"), scalars.signed_percent_text(F.lit(1.5)).alias("g"), scalars.compact_text(F.lit(2e6)).alias("h"),
        scalars.clip(F.lit(None).cast("double"), -1, 1).alias("i"), scalars.finite(F.lit(float("inf"))).alias("j"),
    ).first()
    assert tuple(row) == ("N/A", "1.26", "$2.50B", "$3.00M", "$12.00", "12.30%", "+1.50%", "2M", None, None)


# --- requests, planner, get-data -----------------------------------------------------------------

GOOD = {"portfolio_data": {"weights": {"A": 1.0}, "prices": {"A": 2.0}}, "budget": "1000", "start_date": "2024-01-01", "end_date": "2024-02-01", "risk_free_rate": "0.04"}


def test_benchmark_request():
    got = portfolio.benchmark_request(GOOD)
    assert (got.budget, got.rate, got.start, got.weights) == (1000.0, 0.04, "2024-01-01", {"A": 1.0})
    bad = [
        {}, None, {k: v for k, v in GOOD.items() if k != "budget"}, GOOD | {"budget": -1}, GOOD | {"budget": "ten"}, GOOD | {"budget": None}, GOOD | {"budget": "nan"}, GOOD | {"risk_free_rate": "x"},
        GOOD | {"start_date": "2024-03-01"}, GOOD | {"portfolio_data": []}, GOOD | {"portfolio_data": {"weights": {}, "prices": {"A": 1}}}, GOOD | {"portfolio_data": {"weights": {"A": 1}}},
    ]
    for body in bad:
        with pytest.raises(portfolio.InvalidRequest):
            portfolio.benchmark_request(body)


def test_uploaded_portfolio(spark, tmp_path):
    (tmp_path / "p.json").write_text('{\n"weights": {"A": 0.4, "B": 0.6}\n}')
    (tmp_path / "empty.json").write_text('{"weights": {}, "prices": {"A": 1.0}}')
    assert store.read_portfolio(spark, str(tmp_path / "p.json")).first()["weights"] == {"A": 0.4, "B": 0.6}
    for name, benchmark_ in (("p.json", True), ("empty.json", False)):
        with pytest.raises(ValueError):
            store.read_portfolio(spark, str(tmp_path / name), benchmark_)


def test_get_data(spark):
    bars = bars_of(spark, {"A": list(walk(60)), "B": list(walk(60, 1))})
    got = portfolio.get_data(bars, "A", "2024-01-01", "2024-03-01", regression=True, future_days="5")
    assert got["prices"].count() == 60 and got["regression"].count() == 40 and got["future"].count() == 5
    assert set(portfolio.get_data(bars, "A", "2024-01-01", "2024-03-01")) == {"prices"}
    assert [portfolio.days_ahead(x) for x in ("7", -3, "x", None, 2)] == [7, 0, 0, 0, 2]
    assert portfolio.get_data(bars, "A", "2024-01-01", "2024-03-01", True, -1)["future"].count() == 0


def test_planner_reuses_bundles_and_saved_results(spark, tmp_path):
    bars = bars_of(spark, {t: list(walk(60, k)) for k, t in enumerate("ABCDEF")})
    groups = spark.createDataFrame([("g", "A"), ("g", "B")], "group_name string, symbol string")
    plan = portfolio.Planner(bars, str(tmp_path / "saved"), groups, most=1)
    one = plan.bundle("2024-01-01", "2024-03-01")
    assert plan.bundle("2024-01-01", "2024-03-01") is one and one.names == list("ABCDEF")
    first = plan.run("2024-01-01", "2024-03-01", portfolio_id="p", persist=True)
    saved = plan.run("2024-01-01", "2024-03-01", portfolio_id="p", load=True)
    assert {r["ticker"]: r["weight"] for r in store.load_weights(saved).collect()} == pytest.approx(first["weights"])
    assert isinstance(plan.run("2024-01-01", "2024-03-01", portfolio_id="q", load=True), dict)
    assert plan.bundle("2024-01-01", "2024-03-01", group="g").names == ["A", "B"] and plan.bundle("2024-01-01", "2024-03-01") is not one


def test_pair_sums_by_blocks(spark):
    from tessera.operators import pairs

    rng = np.random.default_rng(0)
    table = {f"T{k:02}": {DAY + dt.timedelta(days=int(d)): float(x) for d, x in zip(rng.permutation(30)[:20], rng.normal(size=20))} for k in range(9)}
    rows = spark.createDataFrame([(t, d, x) for t, v in table.items() for d, x in v.items()], "ticker string, dt date, x double")
    for blocks in (1, 4):
        got = {(r["i"], r["j"]): r for r in pairs.pair_sums(rows, blocks).collect()}
        for i in table:
            for j in table:
                both = sorted(set(table[i]) & set(table[j]))
                if i <= j and both:
                    x, y = (np.array([table[t][d] for d in both]) for t in (i, j))
                    want = (len(both), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum(), (x * x * y * y).sum())
                    row = got.pop((i, j))
                    assert np.allclose([row[c] for c in pairs.SUMS], want)
        assert not got


@pytest.mark.parametrize("alpha", [0.01, 0.3, 1.0])
def test_ema_is_the_recursion(spark, alpha):
    from tessera.functions import windows

    x = walk(300)
    got = [r["e"] for r in bars_of(spark, {"A": list(x)}).select("dt", windows.ema(alpha=alpha).alias("e")).orderBy("dt").collect()]
    want = [x[0]]
    for v in x[1:]:
        want.append((1 - alpha) * want[-1] + alpha * v)
    assert np.allclose(got, want, rtol=1e-12)


def test_p_values_by_quadrature(spark):
    from tessera.functions.pvalue import pearson_p

    rows = [(r, float(n)) for r in (-0.95, -0.3, 0.0, 0.5, 0.999) for n in (3, 4, 10, 60)] + [(None, 5.0), (0.5, 2.0), (1.0, 9.0)]
    got = spark.createDataFrame(rows, "r double, n double").select("r", "n", pearson_p(F.col("r"), F.col("n")).alias("p")).collect()
    for r in got:
        if r["r"] is None or r["n"] < 3:
            assert r["p"] is None
            continue
        # r = sin(u) has a density in proportion to cos(u)^(n - 3)
        u = np.linspace(math.asin(abs(r["r"])), math.pi / 2, 200_001), np.linspace(0, math.pi / 2, 200_001)
        tail, whole = (np.trapezoid(np.cos(v) ** (r["n"] - 3), v) for v in u)
        assert math.isclose(r["p"], tail / whole, rel_tol=1e-6, abs_tol=1e-9)
