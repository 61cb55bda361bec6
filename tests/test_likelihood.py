"""Exact likelihoods, fits and forecasts against the multivariate normal, closed forms and planted series."""

import math

import numpy as np
import pytest

from gustlab.operators import likelihood as L


def planted(n, phi=(), theta=(), seed=0, burn=300):
    g = np.random.default_rng(seed)
    e, x = g.normal(size=n + burn), np.zeros(n + burn)
    for t in range(len(x)):
        x[t] = e[t] + sum(f * x[t - 1 - i] for i, f in enumerate(phi) if t > i) + sum(f * e[t - 1 - i] for i, f in enumerate(theta) if t > i)
    return x[burn:]


def covariances(n, phi, theta, m=4000):
    psi = np.zeros(m)
    psi[0] = 1
    for j in range(1, m):
        psi[j] = (theta[j - 1] if j <= len(theta) else 0) + sum(f * psi[j - 1 - i] for i, f in enumerate(phi) if j > i)
    gamma = np.array([psi[:m - k] @ psi[k:] for k in range(n)])
    return gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]


MODELS = [((0.5,), ()), ((0.6, -0.3), (0.4,)), ((), (0.8, 0.2)), ((0.9,), (-0.5, 0.3, 0.1)), ((), ())]


@pytest.mark.parametrize("phi, theta", MODELS)
def test_likelihood_and_forecasts_are_those_of_the_normal(phi, theta):
    lengths, h = [50, 7, 30, 50], 4
    y = np.zeros((4, 50))
    for i, n in enumerate(lengths):
        y[i, :n] = planted(n, phi, theta, seed=i)
    f, t = np.tile(phi, (4, 1)), np.tile(theta, (4, 1))
    got = L.filter_arma(y, np.array(lengths), f, t)
    means, variances = L.forecast_arma(got, f, t, np.zeros(4), np.zeros((4, 0)), 0, h)
    for i, n in enumerate(lengths):
        g, x = covariances(n + h, phi, theta), y[i, :n]
        s = x @ np.linalg.solve(g[:n, :n], x) / n
        ll = -0.5 * n * (math.log(2 * math.pi * s) + 1) - 0.5 * np.linalg.slogdet(g[:n, :n])[1]
        assert math.isclose(got.loglik[i], ll, rel_tol=1e-9) and math.isclose(got.sigma2[i], s, rel_tol=1e-9)
        w = np.linalg.solve(g[:n, :n], g[:n, n:])
        assert np.allclose(means[i], x @ w, atol=1e-9)
        assert np.allclose(variances[i], s * np.diag(g[n:, n:] - g[n:, :n] @ w), atol=1e-9)


@pytest.mark.parametrize("d", [1, 2])
def test_integrated_forecasts(d):
    """Sums of the differences' forecasts, and the variance of the same sums by their covariance."""
    phi, theta, h, mu = np.array([[0.6]]), np.array([[0.3]]), 5, 0.25 if d == 1 else 0.0
    w = planted(40, (0.6,), (0.3,), seed=3) + mu
    x = w
    for _ in range(d):
        x = np.concatenate([[2.0], 2.0 + np.cumsum(x)])
    got = L.filter_arma((w - mu)[None], np.array([len(w)]), phi, theta)
    base, _ = L.forecast_arma(got, phi, theta, np.array([mu]), np.zeros((1, 0)), 0, h)
    means, variances = L.forecast_arma(got, phi, theta, np.array([mu]), x[::-1][:d][None], d, h)
    g = covariances(len(w) + h, (0.6,), (0.3,))
    n = len(w)
    c = got.sigma2[0] * (g[n:, n:] - g[n:, :n] @ np.linalg.solve(g[:n, :n], g[:n, n:]))
    tail, want = x.copy(), []
    for v in base[0]:
        tail = np.append(tail, v + (tail[-1] if d == 1 else 2 * tail[-1] - tail[-2]))
        want.append(tail[-1])
    weights = np.tril(np.ones((h, h)))
    weights = weights if d == 1 else weights @ weights
    assert np.allclose(means[0], want) and np.allclose(variances[0], np.diag(weights @ c @ weights.T), rtol=1e-8)


def test_ar1_estimate_is_the_root_of_the_derivative():
    for seed in range(3):
        y = planted(200, (0.7,), seed=seed)
        a, c, b, n = y @ y, y[1:] @ y[:-1], y[1:-1] @ y[1:-1], len(y)
        lo, hi = -0.99999, 0.99999
        for _ in range(80):
            m = (lo + hi) / 2
            lo, hi = (m, hi) if n * (c - m * b) * (1 - m * m) > m * (a - 2 * m * c + m * m * b) else (lo, m)
        got = L._solve([y], 0, 0, (1, 0), 5, 5, 2, False)[0]
        assert abs(got[4][0] - lo) < 1e-8


def test_planted_orders_and_drift():
    series = [planted(900, (0.7,), seed=1) + 5, planted(900, (), (0.6,), seed=2), np.cumsum(planted(900, (0.5,), seed=3) + 0.4),
              np.cumsum(np.cumsum(planted(500, (), (0.4,), seed=4)))]
    got = L._solve(series, 3, None, None, 3, 3, 2, True)
    assert [g[1] for g in got] == [0, 0, 1, 2]
    for g, x, p, q in zip(got, series, (1, 0, 1, 0), (0, 1, 0, 1)):
        best = L._solve([x], 0, g[1], (p, q), 3, 3, 2, True)[0]
        assert g[8] <= best[8] + 1e-6  # no worse than the planted order
    assert (got[0][0], got[0][2]) == (1, 0) and abs(got[0][3] - 5) < 0.3 and abs(got[0][4][0] - 0.7) < 0.08
    assert abs(got[2][3] - 0.4) < 0.2 and got[3][3] is None


def test_intervals_hold_their_share():
    series = [planted(160, (0.8,), (0.3,), seed=s) + 10 for s in range(120)]
    got = L._solve([x[:150] for x in series], 10, 0, (1, 1), 5, 5, 2, True)
    for lo, hi, share in ((3, 4, 0.8), (5, 6, 0.95)):
        inside = np.mean([f[lo] <= x[149 + f[0]] <= f[hi] for g, x in zip(got, series) for f in g[10]])
        assert abs(inside - share) < 0.06


def test_frames(spark):
    a, b = planted(80, (0.6,), seed=5), np.cumsum(planted(60, seed=6) + 1)
    rows = [("a", i, float(v)) for i, v in enumerate(a)] + [(None, i, float(v)) for i, v in enumerate(b)]
    rows += [("a", 900, None), ("a", 901, float("nan")), ("short", 1, 2.0), ("short", 2, 3.0), ("none", 1, None)]
    rows += [("flat", i, 4.0) for i in range(20)] + [("line", i, 4.0 + 2 * i) for i in range(40)]
    np.random.default_rng(0).shuffle(rows)
    rows = [(None if r[0] is None else str(r[0]), int(r[1]), None if r[2] is None else float(r[2])) for r in rows]
    df = spark.createDataFrame(rows, "s string, ts long, x double")
    got = {r["s"]: r for r in L.auto_arima(df, "x", h=3, by=["s"], max_p=1, max_q=1).collect()}
    assert set(got) == {"a", None, "short", "flat", "line"}
    want = {k: L._solve([v], 3, None, None, 1, 1, 2, True)[0] for k, v in (("a", a), (None, b))}
    for k, w in want.items():
        assert (got[k]["p"], got[k]["d"], got[k]["q"], got[k]["n"]) == (w[0], w[1], w[2], w[9])
        assert math.isclose(got[k]["loglik"], w[7], rel_tol=1e-6)
        assert np.allclose([f["hi95"] for f in got[k]["forecasts"]], [f[6] for f in w[10]], rtol=1e-4)
    assert got["short"]["p"] is None and got["short"]["forecasts"] is None
    assert [f["forecast"] for f in got["flat"]["forecasts"]] == [4.0, 4.0, 4.0] and got["flat"]["sigma2"] == 0
    assert [f["forecast"] for f in got["line"]["forecasts"]] == [84.0, 86.0, 88.0]
    single = L.auto_arima(df.where("s = 'a'").select("ts", "x"), "x", h=3, max_p=1, max_q=1).first()
    assert (single["p"], single["q"]) == (got["a"]["p"], got["a"]["q"])
    assert L.forecasts(L.auto_arima(df.limit(0), "x", h=3, by=["s"]), ["s"]).collect() == []
    assert L.likelihood(df, "x", [((0.5,), ()), ((), (0.2,))], by=["s"]).where("s = 'a'").count() == 2
