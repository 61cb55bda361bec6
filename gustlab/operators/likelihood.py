"""ARIMA by exact Gaussian likelihood, many series a batch (H9).

Every series is one row with its values in order; a task filters the series of a batch together, so one pass over time
serves all of them and all parameter vectors that are being compared. The likelihood is the Kalman filter's, without
conditioning on first values; the orders are searched stepwise by AICc for each series on its own, with d by the KPSS
test and a drift or mean where d allows one. Forecast variances come from the filter's last state, integrated d times.

A series must fit into a task (8 bytes a value): the filter is a recursion over time. Series beyond that are the case of
:func:`forecast.arima_fit`, which works on ranges of places.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.functions.columns import null_if_nan, qcol
from gustlab.operators.forecast import KPSS_5
from gustlab.operators.timeseries import QNORM_975

QNORM_90 = 1.2815515655446004  # qnorm(0.9), fixed value
BATCH_CELLS = 40_000  # values; a search holds some hundred copies of them
UNIT_ROOT = 1.01  # fits whose polynomials have a root nearer to the unit circle are not taken


# ------------------------------------------------------------------------------------------- filter
@dataclass
class Filtered:
    """Per series: concentrated log likelihood, innovation variance, and the state after the last value."""

    loglik: np.ndarray
    sigma2: np.ndarray
    state: np.ndarray
    cov: np.ndarray


def _system(phi: np.ndarray, theta: np.ndarray):
    """Transition and noise loading of ARMA(p, q) in the companion form of max(p, q + 1) states."""
    b, p, q = len(phi), phi.shape[1], theta.shape[1]
    r = max(p, q + 1)
    trans, load = np.zeros((b, r, r)), np.zeros((b, r))
    trans[:, :p, 0] = phi
    trans[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    load[:, 0], load[:, 1:q + 1] = 1.0, theta
    return trans, load


def filter_arma(y: np.ndarray, n: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> Filtered:
    """The exact likelihood of zero-mean ARMA series: ``y`` (B, N) padded at the end, ``n`` lengths, a parameter row a series."""
    trans, load = _system(phi, theta)
    b, r = load.shape
    noise = load[:, :, None] * load[:, None, :]
    kron = (trans[:, :, None, :, None] * trans[:, None, :, None, :]).reshape(b, r * r, r * r)
    cov = np.linalg.solve(np.eye(r * r) - kron, noise.reshape(b, r * r, 1)).reshape(b, r, r)
    first, a = trans[:, :, 0].copy(), np.zeros((b, r))
    values, shortest = np.ascontiguousarray(y.T), int(n.min())
    ssq, logs, steady, t = np.zeros(b), np.zeros(b), False, 0
    shifted = np.zeros((b, r))

    def step(a, v, gain):
        shifted[:, :-1] = a[:, 1:]
        return first * a[:, :1] + shifted + gain * v[:, None]

    while t < values.shape[0]:
        if not steady:
            f = cov[:, 0, 0]
            gain = (trans @ cov[:, :, :1])[:, :, 0] / f[:, None]
        else:  # nothing but the state moves any more; a series that ends leaves its state behind
            rest, last = values.shape[0] - t, np.empty_like(a)
            vs, ends = np.empty((rest, b)), set((n - t).tolist())
            for i in range(rest):
                if i in ends:
                    last[n - t == i] = a[n - t == i]
                v = vs[i] = values[t + i] - a[:, 0]
                a = step(a, v, gain)
            last[n - t == rest] = a[n - t == rest]
            vs[np.arange(rest)[:, None] >= (n - t)[None]] = 0.0
            ssq += (vs * vs).sum(axis=0) / f
            logs += (n - t) * np.log(f)
            a = last
            break
        on = t < n
        v = values[t] - a[:, 0]
        ssq += np.where(on, v * v / f, 0.0)
        logs += np.where(on, np.log(f), 0.0)
        a = np.where(on[:, None], step(a, v, gain), a)
        if not steady:
            new = trans @ cov @ trans.transpose(0, 2, 1) + noise - gain[:, :, None] * gain[:, None, :] * f[:, None, None]
            new = np.where(on[:, None, None], new, cov)
            steady = t + 1 < shortest and bool(np.abs(new - cov).max() < 1e-13 * max(1.0, np.abs(cov).max()))
            cov = new
        t += 1
    sigma2 = ssq / n
    with np.errstate(divide="ignore"):
        ll = -0.5 * n * (np.log(2 * np.pi * sigma2) + 1) - 0.5 * logs
    return Filtered(ll, sigma2, a, cov)


def forecast_arma(got: Filtered, phi, theta, mean, tail: np.ndarray, d: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances (B, h) of the next values of the series whose d-th differences were filtered; ``tail`` (B, d): their
    last values, the latest first."""
    trans, load = _system(phi, theta)
    b, r = load.shape
    a, z = np.zeros((b, r + d, r + d)), np.zeros(r + d)
    z[0] = 1.0
    z[r:] = {0: [], 1: [1.0], 2: [2.0, -1.0]}[d]
    a[:, :r, :r] = trans
    if d:
        a[:, r] = z
    if d == 2:
        a[:, r + 1, r] = 1.0
    s = np.concatenate([got.state, tail], axis=1)
    c, noise = np.zeros((b, r + d, r + d)), np.zeros((b, r + d, r + d))
    c[:, :r, :r], noise[:, :r, :r] = got.cov, load[:, :, None] * load[:, None, :]
    means, variances = np.empty((b, h)), np.empty((b, h))
    for k in range(h):
        means[:, k] = s @ z + mean
        variances[:, k] = (c @ z @ z) * got.sigma2
        level = means[:, k]
        s = (a @ s[:, :, None])[:, :, 0]
        if d:
            s[:, r] = level  # the mean of the differences is a drift of the level
        c = a @ c @ a.transpose(0, 2, 1) + noise
    return means, variances


# ------------------------------------------------------------------------------------------- fit
def _polynomial(u: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from unbounded numbers, by its partial autocorrelations."""
    r, out = 0.99999 * np.tanh(u), np.zeros_like(u)
    for k in range(u.shape[1]):
        prev = out[:, :k].copy()
        out[:, :k] = prev - r[:, k:k + 1] * prev[:, ::-1]
        out[:, k] = r[:, k]
    return out


def _parts(u: np.ndarray, p: int, q: int):
    return _polynomial(u[:, :p]), -_polynomial(u[:, p:p + q]), u[:, p + q]


def _cost(u, y, n, p, q) -> np.ndarray:
    phi, theta, mean = _parts(u, p, q)
    with np.errstate(all="ignore"):
        c = -filter_arma(y - mean[:, None], n, phi, theta).loglik / n
    return np.where(np.isfinite(c), c, 1e10)


def _slopes(u, y, n, p, q, eps=1e-5):
    """Gradient by central differences, all of them in one filter pass."""
    b, k = u.shape
    moves = np.concatenate([np.eye(k), -np.eye(k)]) * eps
    c = _cost((u[:, None] + moves[None]).reshape(-1, k), np.repeat(y, 2 * k, axis=0), np.repeat(n, 2 * k), p, q).reshape(b, 2 * k)
    return (c[:, :k] - c[:, k:]) / (2 * eps)


def maximise(y: np.ndarray, n: np.ndarray, p: int, q: int, active: np.ndarray, start: np.ndarray | None = None, rounds: int = 80,
             least: float = 1e-12) -> np.ndarray:
    """Unbounded parameters (B, p + q + 1) of the largest likelihood: quasi-Newton steps for all rows at once, each with the
    best of several lengths, until no step gains ``least``; from a ``start`` these end in Newton steps.

    A row may have a lower order: parameters that are not ``active`` stay 0, and a partial autocorrelation of 0 is no term.
    """
    b, k = len(y), p + q + 1
    u = np.zeros((b, k)) if start is None else start.copy()
    if start is None:
        u[:, -1] = [row[:m].mean() if on else 0.0 for row, m, on in zip(y, n, active[:, -1])]

    def slopes(u, i, repeat=1):
        return _slopes(u, np.repeat(y[i], repeat, axis=0), np.repeat(n[i], repeat), p, q) * np.repeat(active[i], repeat, axis=0)

    every = np.arange(b)
    lengths = np.array([1.0, 0.5, 0.2, 0.05, 0.01, 2.0])
    inverse, cost, grad, live = np.tile(np.eye(k), (b, 1, 1)), _cost(u, y, n, p, q), slopes(u, every), active.any(axis=1)
    for _ in range(rounds):
        i = np.flatnonzero(live)
        if not len(i):
            break
        way = -(inverse[i] @ grad[i][:, :, None])[:, :, 0]
        uphill = (way * grad[i]).sum(axis=1) >= 0
        way[uphill], inverse[i[uphill]] = -grad[i[uphill]], np.eye(k)
        way /= np.maximum(1.0, np.abs(way).max(axis=1, keepdims=True) / 2)
        m = len(lengths)
        tried = (u[i][:, None] + lengths[None, :, None] * way[:, None]).reshape(-1, k)
        c = _cost(tried, np.repeat(y[i], m, axis=0), np.repeat(n[i], m), p, q).reshape(-1, m)
        best = c.argmin(axis=1)
        gain = cost[i] - c[np.arange(len(i)), best]
        moved = gain > least
        s = lengths[best][:, None] * way
        j = i[moved]
        u[j] += s[moved]
        cost[j] = c[np.arange(len(i)), best][moved]
        new = slopes(u[j], j) if len(j) else np.zeros((0, k))
        dg, ds = new - grad[j], s[moved]
        rho = (dg * ds).sum(axis=1)
        ok = rho > 1e-14
        if ok.any():
            w, x, z = np.eye(k), ds[ok], dg[ok] / rho[ok][:, None]
            left = w[None] - x[:, :, None] * z[:, None, :]
            inverse[j[ok]] = left @ inverse[j[ok]] @ left.transpose(0, 2, 1) + x[:, :, None] * x[:, None, :] / rho[ok][:, None, None]
        grad[j] = new
        live[i[~moved]] = False
        live[j[np.abs(new).max(axis=1) < 1e-7]] = False
    for _ in range(3 if start is not None else 0):
        eps = 1e-4
        moves = np.concatenate([np.eye(k), -np.eye(k)]) * eps
        g = slopes((u[:, None] + moves[None]).reshape(-1, k), every, 2 * k).reshape(b, 2 * k, k)
        hess = (g[:, :k] - g[:, k:]) / (2 * eps) * active[:, :, None]
        hess = (hess + hess.transpose(0, 2, 1)) / 2 + np.eye(k) * ~active[:, :, None]
        now = slopes(u, every)
        values, vectors = np.linalg.eigh(hess)
        step = -(vectors @ ((vectors.transpose(0, 2, 1) @ now[:, :, None]) / np.maximum(values, 1e-6)[:, :, None]))[:, :, 0]
        good = (values.min(axis=1) > 1e-6) & (np.abs(step).max(axis=1) < 0.1)
        u[good] += step[good]
    return u


def kpss_statistic(x: np.ndarray) -> float:
    """The level statistic of one series in memory, as :func:`forecast.kpss` has it for its own length; 0 if constant."""
    n, d = len(x), x - x.mean()
    lags = int(4 * (n / 100) ** 0.25)
    s2 = d @ d + 2 * sum((1 - k / (lags + 1)) * (d[:-k] @ d[k:]) for k in range(1, min(lags, n - 1) + 1))
    return float((np.cumsum(d) ** 2).sum() / (n * s2)) if s2 > 0 else 0.0


def differences(x: np.ndarray, max_d: int) -> int:
    """How many differences a series needs until the KPSS test no longer rejects its level at 5 %."""
    for d in range(max_d):
        if len(x) < 8 or kpss_statistic(x) <= KPSS_5:
            return d
        x = np.diff(x)
    return max_d


def _near_unit_root(phi: np.ndarray, theta: np.ndarray) -> bool:
    for poly in (np.append(-phi[::-1], 1.0), np.append(theta[::-1], 1.0)):
        roots = np.roots(np.trim_zeros(poly, "f"))
        if len(roots) and np.abs(roots).min() < UNIT_ROOT:
            return True
    return False


class Batch:
    """The differenced series of a batch in units of their spread, and the models fitted to them so far."""

    def __init__(self, series: list[np.ndarray], ds: list[int]):
        self.ds = ds
        raw = [np.diff(x, d) if d else x for x, d in zip(series, ds)]
        self.n = np.array([len(x) for x in raw])
        self.scale = np.array([x.std() or 1.0 for x in raw])
        self.y = np.zeros((len(raw), int(self.n.max())))
        for i, x in enumerate(raw):
            self.y[i, :len(x)] = x / self.scale[i]
        self.fits: list[dict] = [{} for _ in raw]

    def fit(self, asked: list[tuple], last: bool = False) -> None:
        """Fit (series, (p, q, constant)) pairs, all together; the ``last`` time to the end, from what was found before."""
        i, p, q = np.array([s for s, _ in asked]), max(o[0] for _, o in asked), max(o[1] for _, o in asked)
        active = np.array([[k < a for k in range(p)] + [k < b for k in range(q)] + [c] for _, (a, b, c) in asked])
        start = None
        if last and all(o in self.fits[s] for s, o in asked):
            start = np.zeros(active.shape)
            start[active] = np.concatenate([self.fits[s][o][-1] for s, o in asked])
        u = maximise(self.y[i], self.n[i], p, q, active, start, *((80, 1e-12) if last else (30, 1e-7)))
        phi, theta, mean = _parts(u, p, q)
        got = filter_arma(self.y[i] - mean[:, None], self.n[i], phi, theta)
        for k, (s, (a, b, c)) in enumerate(asked):
            n, params = int(self.n[s]), a + b + c + 1
            ll = got.loglik[k] - n * math.log(self.scale[s])
            fits = n > params + 1 and math.isfinite(ll) and not _near_unit_root(phi[k, :a], theta[k, :b])
            aicc = -2 * ll + 2 * params + 2 * params * (params + 1) / (n - params - 1) if fits else math.inf
            one = Filtered(got.loglik[k:k + 1], got.sigma2[k:k + 1], got.state[k:k + 1], got.cov[k:k + 1])
            self.fits[s][(a, b, c)] = (aicc, ll, phi[k], theta[k], mean[k], one, u[k, active[k]])

    def search(self, max_p: int, max_q: int) -> list[tuple]:
        """The order of the least AICc for each series, from four starts to neighbours until none is better."""
        best: list[tuple | None] = [None] * len(self.n)
        may = [d <= 1 for d in self.ds]
        asked = [{(min(a, max_p), min(b, max_q), c) for a, b, c in
                  ((2, 2, may[s]), (0, 0, may[s]), (1, 0, may[s]), (0, 1, may[s]), (0, 0, False))} for s in range(len(best))]
        while any(asked):
            self.fit([(s, o) for s, orders in enumerate(asked) for o in sorted(orders)])
            for s, orders in enumerate(asked):
                top = min(self.fits[s], key=lambda o: (self.fits[s][o][0], o)) if orders else best[s]
                moved, best[s] = top != best[s], top
                p, q, c = top
                near = {(p + i, q + j, c) for i in (-1, 0, 1) for j in (-1, 0, 1)} | ({(p, q, not c)} if may[s] else set())
                asked[s] = {o for o in near if 0 <= o[0] <= max_p and 0 <= o[1] <= max_q and o not in self.fits[s]} if moved else set()
        return best


_FORECAST = "array<struct<step:int,forecast:double,se:double,lo80:double,hi80:double,lo95:double,hi95:double>>"
_FIT = ("p int, d int, q int, constant double, phi array<double>, theta array<double>, sigma2 double, loglik double, aicc double, "
        f"n long, forecasts {_FORECAST}")


def _solve(series: list[np.ndarray], h: int, d: int | None, order, max_p, max_q, max_d, constant) -> list[tuple]:
    """A row of ``_FIT`` per series."""
    ds = [differences(x, max_d) if d is None else d for x in series]
    out: list[tuple] = [(None,) * 9 + (len(x) - k, None) for x, k in zip(series, ds)]
    flat = [i for i, (x, k) in enumerate(zip(series, ds)) if len(x) > k and np.ptp(np.diff(x, k)) <= 1e-12 * (1 + np.abs(x).max())]
    for i in flat:  # no noise: the last difference goes on
        x, k = series[i], ds[i]
        means, level, step = [], x[-k:][::-1].tolist(), float(np.diff(x, k)[-1])
        for _ in range(h):
            means.append(step + (0, level[0] if k else 0, 2 * level[0] - level[1] if k > 1 else 0)[k])
            level = [means[-1], *level[:1]]
        out[i] = (0, k, 0, step, [], [], 0.0, None, None, len(x) - k, [(s + 1, m, 0.0, m, m, m, m) for s, m in enumerate(means)])
    use = [i for i, (x, k) in enumerate(zip(series, ds)) if len(x) - k >= 4 and i not in flat]
    if not use:
        return out
    batch = Batch([series[i] for i in use], [ds[i] for i in use])
    if order is None:
        best = batch.search(max_p, max_q)
    else:
        best = [(*order, constant and ds[i] <= 1) for i in use]
    for last in ([True] if order is None else [False, True]):  # a search has fitted its best once
        batch.fit(list(enumerate(best)), last)
    for s, i in enumerate(use):
        p, q, c = best[s]
        aicc, ll, phi, theta, mean, got, _ = batch.fits[s][best[s]]
        unit = batch.scale[s]
        one = Filtered(got.loglik, got.sigma2 * unit ** 2, got.state * unit, got.cov)
        mu, rows = float(mean * batch.scale[s]) if c else None, []
        if h:
            tail = series[i][::-1][:ds[i]][None]
            m, v = forecast_arma(one, phi[None], theta[None], mu or 0.0, tail, ds[i], h)
            for t in range(h):
                se = math.sqrt(max(v[0, t], 0.0))
                rows.append((t + 1, m[0, t], se, m[0, t] - QNORM_90 * se, m[0, t] + QNORM_90 * se, m[0, t] - QNORM_975 * se, m[0, t] + QNORM_975 * se))
        out[i] = (p, ds[i], q, mu, phi[:p].tolist(), theta[:q].tolist(), float(one.sigma2[0]), float(ll),
                  float(aicc) if math.isfinite(aicc) else None, int(batch.n[s]), rows)
    return out


def auto_arima(df: DataFrame, value: str, h: int = 0, ts: str = "ts", by: Sequence[str] = (), max_p: int = 5, max_q: int = 5,
               max_d: int = 2, d: int | None = None, order: tuple[int, int] | None = None, constant: bool = True) -> DataFrame:
    """A fitted ARIMA(p, d, q) per series with ``h`` forecasts: ``by...``, ``p, d, q, constant`` (mean of the d-th differences: the
    level or the drift; NULL without one), ``phi, theta, sigma2, loglik, aicc, n`` (values after differencing) and
    ``forecasts`` (step, forecast, se, 80 and 95 % bounds; see :func:`forecasts`).

    ``order`` fixes (p, q), with a constant if asked for and d <= 1; else the orders are searched. ``d`` fixes the number of
    differences, else each series has its own. NULL and NaN values are left out before places are counted; equal times
    come by value. With fewer than four values after differencing the fit is NULL; a series without noise (d-th
    differences all equal) goes on as it is, with variance 0 and no likelihood. sigma2 is the likelihood's (divided by n).
    """
    by = list(by)
    x = null_if_nan(qcol(value)).cast("double")
    rows = df.select(*[qcol(c).alias(f"k{i}") for i, c in enumerate(by)], qcol(ts).alias("t"), x.alias("x")).where("x is not null")
    ks = [f"k{i}" for i in range(len(by))]
    packed = F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("xs")
    one = (rows.groupBy(*ks).agg(packed) if ks else rows.agg(packed)).where(F.size("xs") > 0)
    types = dict(rows.dtypes)
    if not ks:  # a single series is a batch of its own
        one = one.coalesce(1)

    def run(batches):
        for pdf in batches:
            held, cells = [], 0
            for i, xs in enumerate(pdf["xs"]):
                held.append(i)
                cells += len(xs)
                if cells >= BATCH_CELLS or i == len(pdf) - 1:
                    part = pdf.iloc[held]
                    got = _solve([np.asarray(v, float) for v in part["xs"]], h, d, order, max_p, max_q, max_d, constant)
                    names = [c.split(" ")[0] for c in _FIT.split(f", forecasts {_FORECAST}")[0].split(", ")] + ["forecasts"]
                    out = pd.DataFrame({c: [g[k] for g in got] for k, c in enumerate(names)}, dtype=object)
                    for k in ks:
                        out.insert(0, k, part[k].to_numpy())
                    yield out[[*ks, *names]]
                    held, cells = [], 0

    schema = "".join(f"{k} {types[k]}, " for k in ks) + _FIT
    got = one.mapInPandas(run, schema)
    return got.select(*[F.col(k).alias(c) for k, c in zip(ks, by)], *[c for c in got.columns if c not in ks])


def forecasts(fit: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The forecasts of :func:`auto_arima`, a row a series and step."""
    return fit.select(*[qcol(c) for c in by], "p", "d", "q", F.explode("forecasts").alias("__f")).select(*[qcol(c) for c in by], "p", "d", "q", "__f.*")


def likelihood(df: DataFrame, value: str, settings: Sequence[tuple], ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """The exact log likelihood and sigma2 of every series under given zero-mean ARMA settings ``(phi, theta)``: ``by..., setting
    int, sigma2, loglik, n``; one filter pass serves all settings. Series as in :func:`auto_arima`."""
    by = list(by)
    x = null_if_nan(qcol(value)).cast("double")
    rows = df.select(*[qcol(c).alias(f"k{i}") for i, c in enumerate(by)], qcol(ts).alias("t"), x.alias("x")).where("x is not null")
    ks = [f"k{i}" for i in range(len(by))]
    packed = F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("xs")
    one = (rows.groupBy(*ks).agg(packed) if ks else rows.agg(packed)).where(F.size("xs") > 0)
    p, q = max((len(a) for a, _ in settings), default=0), max((len(b) for _, b in settings), default=0)
    m = len(settings)
    phi, theta = np.zeros((m, p)), np.zeros((m, q))
    for i, (a, b) in enumerate(settings):
        phi[i, :len(a)], theta[i, :len(b)] = a, b
    types = dict(rows.dtypes)

    def run(batches):
        for pdf in batches:
            for i in range(len(pdf)):
                v = np.asarray(pdf["xs"].iloc[i], float)
                got = filter_arma(np.tile(v, (m, 1)), np.full(m, len(v)), phi, theta)
                yield pd.DataFrame({**{k: [pdf[k].iloc[i]] * m for k in ks}, "setting": range(m), "sigma2": got.sigma2, "loglik": got.loglik,
                                    "n": len(v)})

    got = one.mapInPandas(run, "".join(f"{k} {types[k]}, " for k in ks) + "setting int, sigma2 double, loglik double, n long")
    return got.select(*[F.col(k).alias(c) for k, c in zip(ks, by)], "setting", "sigma2", "loglik", "n")
