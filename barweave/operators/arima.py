"""ARIMA(1,1,1) on log closes: the one model Spark expressions cannot fit.

Per symbol the input is an array of at most 250 values, gathered by Spark. The
fit maximises the exact Gaussian likelihood of the differenced series, in one
numpy pass over all symbols of an Arrow batch: the time recursion is a loop of
at most 249 vector steps, whatever the number of symbols.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.operators.signals import age

TAIL_BARS = 250
MAX_ROUNDS = 50
FIRST_STEP, LAST_STEP = 0.3, 1e-5
MIN_DIFFERENCES = 10


def log_tail(n: int = TAIL_BARS) -> Column:
    """Aggregate: the last n log closes in order, at most n values."""
    entry = F.struct("pos", F.log("close").alias("v"))
    rows = F.array_sort(F.collect_list(F.when(age() < n, entry)))
    return F.transform(rows, lambda r: r["v"]).alias("log_tail")


def _innovations(w, length, phi, theta):
    """Run the one-step predictor; arrays are (series, candidates).

    Returns the concentrated negative log-likelihood and the prediction of
    the value after the last one.
    """
    n, steps = w.shape
    count = length[:, None].astype(float)
    scale = (1.0 + 2.0 * phi * theta + theta * theta) / (1.0 - phi * phi)
    ahead = np.zeros_like(phi)
    squares = np.zeros_like(phi)
    logs = np.zeros_like(phi)
    for t in range(steps):
        live = (t < length)[:, None]
        value = w[:, t][:, None]
        error = value - ahead
        squares += np.where(live, error * error / scale, 0.0)
        logs += np.where(live, np.log(scale), 0.0)
        ahead = np.where(live, phi * value + theta * error / scale, ahead)
        scale = np.where(live, 1.0 + theta * theta - theta * theta / scale, scale)
    cost = count * np.log(np.maximum(squares, 1e-300) / count) + logs
    return cost, ahead


def _fit(w, length):
    """Best (phi, theta) per series: a coarse grid, then a shrinking search."""
    n = len(w)
    axis = np.linspace(-1.8, 1.8, 7)  # tanh keeps both inside (-1, 1)
    a, b = (g.ravel() for g in np.meshgrid(axis, axis))
    cost, _ = _innovations(
        w, length, np.tile(np.tanh(a), (n, 1)), np.tile(np.tanh(b), (n, 1)))
    best = cost.argmin(axis=1)
    at_a, at_b, low = a[best], b[best], cost[np.arange(n), best]
    step = np.full(n, FIRST_STEP)
    da, db = (g.ravel() for g in np.meshgrid([-1.0, 0.0, 1.0], [-1.0, 0.0, 1.0]))
    for _ in range(MAX_ROUNDS):
        live = step >= LAST_STEP  # each series ends by itself, whatever the others do
        if not live.any():
            break
        near_a = np.clip(at_a[:, None] + step[:, None] * da, -5.0, 5.0)
        near_b = np.clip(at_b[:, None] + step[:, None] * db, -5.0, 5.0)
        cost, _ = _innovations(w, length, np.tanh(near_a), np.tanh(near_b))
        best = cost.argmin(axis=1)
        found = cost[np.arange(n), best]
        better = live & (found < low - 1e-12)
        at_a = np.where(better, near_a[np.arange(n), best], at_a)
        at_b = np.where(better, near_b[np.arange(n), best], at_b)
        low = np.where(better, found, low)
        step = np.where(better | ~live, step, step / 2.0)
    return np.tanh(at_a), np.tanh(at_b)


def forecast_paths(tails: list, h: int) -> list:
    """Paths of h levels for log-price arrays; None where there is no fit."""
    out: list = [None] * len(tails)
    series = {}
    for i, tail in enumerate(tails):
        values = np.asarray(tail, dtype=float) if tail is not None else np.empty(0)
        if len(values) > MIN_DIFFERENCES and np.isfinite(values).all():
            series[i] = values
    if not series:
        return out
    keys = list(series)
    length = np.array([len(series[i]) - 1 for i in keys])
    w = np.zeros((len(keys), length.max()))
    for row, i in enumerate(keys):
        w[row, :length[row]] = np.diff(series[i])
    phi, theta = _fit(w, length)
    _, ahead = _innovations(w, length, phi[:, None], theta[:, None])
    moves = ahead * phi[:, None] ** np.arange(h)
    last = np.array([series[i][-1] for i in keys])
    paths = np.exp(last[:, None] + np.cumsum(moves, axis=1))
    for row, i in enumerate(keys):
        if np.isfinite(paths[row]).all():
            out[i] = paths[row].tolist()
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def fit_path(tail: pd.Series, h: pd.Series) -> pd.Series:
    if not len(tail):
        return pd.Series([], dtype=object)
    return pd.Series(forecast_paths(list(tail), int(h.iloc[0])), dtype=object)
