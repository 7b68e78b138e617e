"""Constrained mean-variance allocation: small dense quadratic programs on the driver."""

from __future__ import annotations

import numpy as np

CAP, GAMMA = 0.2, 0.05
CUTOFF = 1e-4


class Infeasible(ValueError):
    """No weights meet the constraints."""


def quadratic_program(p: np.ndarray, q: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 20_000, tolerance: float = 1e-10) -> np.ndarray:
    """min x'Px/2 + q'x with low <= Ax <= high, by operator splitting; equal bounds get a stiffer step."""
    n, m = len(q), len(low)
    scale = max(np.abs(p).max(), 1e-12)
    p, q = p / scale, q / scale
    rho = np.where(high - low < 1e-12, 1e3, 1.0) * 0.1
    sigma = 1e-6
    for _ in range(4):
        kkt = np.linalg.inv(p + sigma * np.eye(n) + (a.T * rho) @ a)
        x, z, y = np.zeros(n), np.clip(np.zeros(m), low, high), np.zeros(m)
        for i in range(rounds):
            x = kkt @ (sigma * x - q + a.T @ (rho * z - y))
            ax = a @ x
            new = np.clip(ax + y / rho, low, high)
            y += rho * (ax - new)
            if i % 25 == 0 and np.abs(ax - new).max() < tolerance and np.abs(p @ x + q + a.T @ y).max() < tolerance:
                return x
            z = new
        if np.abs(a @ x - z).max() < 1e-6:
            return x
        rho = rho * 10
    raise Infeasible("the solver found no weights that meet the constraints")


def _boxed(n: int, cap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if n * cap < 1 - 1e-9:
        raise Infeasible(f"{n} tickers of at most {cap:g} can't add up to 1")
    return np.vstack([np.eye(n), np.ones(n)]), np.append(np.zeros(n), 1.0), np.append(np.full(n, cap), 1.0)


def _solve(sigma: np.ndarray, q: np.ndarray, cap: float, gamma: float, rows: list[tuple[np.ndarray, float, float]] = ()) -> np.ndarray:
    a, low, high = _boxed(len(q), cap)
    for r, lo, hi in rows:
        a, low, high = np.vstack([a, r]), np.append(low, lo), np.append(high, hi)
    w = quadratic_program(2 * (sigma + gamma * np.eye(len(q))), q, a, low, high)
    return np.clip(w, 0, cap) / np.clip(w, 0, cap).sum()


def max_sharpe(mu: np.ndarray, sigma: np.ndarray, rate: float, cap: float = CAP, gamma: float = GAMMA) -> np.ndarray:
    """The tangency weights, from min y'(S + gamma I)y with (mu - rate)'y = 1 and 0 <= y <= cap sum(y)."""
    n = len(mu)
    _boxed(n, cap)
    if (mu - rate).max() <= 0:
        raise Infeasible("no expected return exceeds the risk-free rate")
    if n * cap < 1 + 1e-9:
        return np.full(n, 1 / n)
    best = np.sort(mu)[::-1]
    k = int(1 / cap)
    if best[:k].sum() * cap + (1 - k * cap) * (best[k] if k < n else 0) <= rate:
        raise Infeasible("no allowed portfolio's return exceeds the risk-free rate")
    step = 1 / np.abs(mu - rate).max()
    a = np.vstack([np.eye(n), np.eye(n) - cap, (mu - rate) * step])
    low = np.concatenate([np.zeros(n), np.full(n, -np.inf), [1.0]])
    high = np.concatenate([np.full(n, np.inf), np.zeros(n), [1.0]])
    y = np.maximum(quadratic_program(2 * (sigma + gamma * np.eye(n)), np.zeros(n), a, low, high), 0)
    return y / y.sum()


def efficient_return(mu: np.ndarray, sigma: np.ndarray, target: float, cap: float = CAP, gamma: float = GAMMA) -> np.ndarray:
    """Least risk with at least the target return."""
    best = np.sort(mu)[::-1]
    k = min(int(1 / cap + 1e-9), len(mu))
    reach = best[:k].sum() * cap + (1 - k * cap) * (best[k] if k < len(mu) else 0)
    _boxed(len(mu), cap)
    if target > reach + 1e-9:
        raise Infeasible(f"the target return {target:g} is above the largest that is allowed, {reach:g}")
    return _solve(sigma, np.zeros(len(mu)), cap, gamma, [(mu, target, np.inf)])


def efficient_risk(mu: np.ndarray, sigma: np.ndarray, target: float, cap: float = CAP, gamma: float = GAMMA) -> np.ndarray:
    """Most return (less gamma |w|^2) with at most the target volatility, by bisecting the price of variance."""

    def at(price: float) -> np.ndarray:
        w = quadratic_program(2 * (price * sigma + gamma * np.eye(len(mu))), -mu, *_boxed(len(mu), cap))
        return np.clip(w, 0, cap) / np.clip(w, 0, cap).sum()

    vol = lambda w: float(np.sqrt(w @ sigma @ w))
    w = at(0.0)
    if vol(w) <= target:
        return w
    low, high = 0.0, 1.0
    while vol(w := at(high)) > target:
        low, high = high, high * 4
        if high > 1e7:
            raise Infeasible(f"the target volatility {target:g} is below the least that is allowed, {vol(w):g}")
    for _ in range(40):
        mid = (low + high) / 2
        w = at(mid)
        low, high = (mid, high) if vol(w) > target else (low, mid)
    return at(high)


def allocate(mu: np.ndarray, sigma: np.ndarray, rate: float, target_return: float | None = None, risk_tolerance: float | None = None, cap: float = CAP, gamma: float = GAMMA) -> np.ndarray:
    """By target return if there is one that isn't 0, else by risk tolerance, else the highest Sharpe ratio."""
    if target_return:
        return efficient_return(mu, sigma, target_return, cap, gamma)
    if risk_tolerance:
        return efficient_risk(mu, sigma, risk_tolerance, cap, gamma)
    return max_sharpe(mu, sigma, rate, cap, gamma)


def performance(w: np.ndarray, mu: np.ndarray, sigma: np.ndarray, rate: float) -> dict[str, float]:
    ret, risk = float(w @ mu), float(np.sqrt(w @ sigma @ w))
    return {"return": ret, "risk": risk, "sharpe_ratio": (ret - rate) / risk if risk else 0.0}


def prune(names: list[str], w: np.ndarray, cutoff: float = CUTOFF) -> list[tuple[str, float]]:
    """Weights above the cut-off, to 5 decimals."""
    return [(t, round(float(x), 5)) for t, x in zip(names, w) if x > cutoff]
