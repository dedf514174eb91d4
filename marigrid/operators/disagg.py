"""Daily values to hourly ones: marginal and correlation fits, caches as joins, and the stochastic blocks.

Fits run once for each distinct parameter tuple and are joined back. Only the last step is sequential, along the
time of one series; series run side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marigrid.functions import distributions as dist
from marigrid.functions.optimize import nelder_mead
from marigrid.functions.scalar import key4
from marigrid.operators.calendar import centers
from marigrid.params import Disaggregation
from marigrid.params import Window as Recurring

#: Gaussian correlations at which targets are computed.
RHO_Z = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
#: Candidate days that are held at once, nearest ones whose means are then taken exactly; size and reach of tabulated quantiles.
CHUNK, NEAR, TABLE, _REACH = 4096, 16, 1 << 16, 8.0
_NODES, _WEIGHTS = np.polynomial.hermite.hermgauss(40)


def _keys_schema(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def fit_marginals(df: DataFrame, keys: Sequence[str], value: str, family: str) -> DataFrame:
    """(keys, param, value) of likelihood fits, one group a series."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[value].dropna().to_numpy()
        found = dist.fit(family, x) if len(x) > 2 else {}
        return pd.DataFrame([(*key, k, float(v)) for k, v in found.items()], columns=[*keys, "param", "value"])

    return df.select(*keys, value).groupBy(*keys).applyInPandas(one, f"{_keys_schema(df, keys)}, param string, value double")


def window_marginals(df: DataFrame, window: Recurring, keys: Sequence[str], value: str, family: str, time: str = "time", match: str = "instant", hour: int = 0, block: int = 31) -> DataFrame:
    """2.7 with R15: (keys, center_day, param, value) of the likelihood fits of all 366 annual windows.

    Calendar days go in blocks of ``block`` centers. A task gets the days of one block, with half a window of
    neighbouring days before and after it, of one key: rows go to two blocks or so and never 31-fold. In it,
    each window's rows are slices of the years' sorted rows, one for each year. "instant" takes rows at ``hour`` of whole days,
    "interval" the rows of the closed intervals around the centers. Windows with under three rows have no fit. Null
    values take no part.
    """
    half = window.half
    # 366 x years rows
    at = centers(df.sparkSession, window, hour).withColumn("block", F.floor((F.dayofyear(F.to_date(F.concat(F.lit("1980"), "center_day"), "yyyyMMdd")) - 1) / block).cast("int"))
    days = at.select("block", F.explode(F.sequence(F.to_date("center") - half, F.to_date("center") + half)).alias("__day")).distinct()
    spans: dict[int, dict[str, list[int]]] = {}
    for r in at.select("block", "center_day", F.unix_timestamp(F.col("center").cast("timestamp")).alias("s")).orderBy("center_day", "s").collect():
        spans.setdefault(r.block, {}).setdefault(r.center_day, []).append(r.s)
    rows = df.dropna(subset=[value]).select(*keys, F.col(time).cast("timestamp_ntz").alias("__t"), F.col(value).cast("double").alias("__v"))
    if match == "instant":
        rows = rows.filter(F.col("__t") == F.date_trunc("day", "__t").cast("timestamp_ntz") + F.expr(f"INTERVAL {hour} HOURS"))
    near = rows.withColumn("__day", F.to_date("__t")).join(F.broadcast(days), "__day").select(*keys, F.col("block").alias("__block"), F.unix_timestamp(F.col("__t").cast("timestamp")).alias("__s"), "__v")

    def one(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["__s", "__v"])
        s, v = held["__s"].to_numpy(), held["__v"].to_numpy()
        out = []
        for center_day, middles in spans[key[-1]].items():
            m = np.array(middles)
            cuts = zip(np.searchsorted(s, m - half * 86400, "left"), np.searchsorted(s, m + half * 86400, "right"), strict=True)
            # each row once, where windows of neighbouring years overlap
            taken, x = 0, []
            for a, b in cuts:
                x.append(v[max(a, taken) : b])
                taken = max(taken, b)
            x = np.concatenate(x)
            if len(x) > 2:
                out += [(*key[:-1], center_day, k, float(f)) for k, f in dist.fit(family, x).items()]
        return pd.DataFrame(out, columns=[*keys, "center_day", "param", "value"])

    # few bytes but much work: as many tasks as the session has for a shuffle, which AQE doesn't merge by size
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(filter(None, [_keys_schema(df, keys), "center_day string, param string, value double"]))
    return near.repartition(tasks, *keys, "__block").groupBy(*keys, "__block").applyInPandas(one, kinds)


#: Parameters of the correlation curves by family, and the curves.
ACF_PARAMETERS = {"weibull": ("scale", "shape"), "paretoII": ("scale", "shape"), "burrXII": ("scale", "shape1", "shape2")}
_CURVES = {
    "weibull": lambda lag, s, k: np.exp(-((lag / s) ** k)),
    "paretoII": lambda lag, s, k: (1 + k * lag / s) ** (-1 / k),
    "burrXII": lambda lag, s, k, m: (1 + m * (lag / s) ** k) ** (-m / k),
}


def fit_acf(acf: DataFrame, keys: Sequence[str], family: str = "weibull", places: int | None = 2) -> DataFrame:
    """(keys, the family's parameters, mae): the curve with the least mean absolute error.

    Parameters are given to two places, as they are stored; None keeps them whole. The error is that of the whole ones.
    """
    names, curve = ACF_PARAMETERS[family], _CURVES[family]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lag, rho = rows["lag"].to_numpy(float), rows["acf"].to_numpy(float)
        found = nelder_mead(lambda p: float(np.abs(curve(lag, *p) - rho).mean()), [max(len(lag), 1), *[1.0] * (len(names) - 1)], 200 * len(names), low=0.05)
        shown = [float(p) if places is None else round(float(p), places) for p in found]
        return pd.DataFrame([(*key, *shown, float(np.abs(curve(lag, *found) - rho).mean()))], columns=[*keys, *names, "mae"])

    kinds = ", ".join(f"{n} double" for n in [*names, "mae"])
    return acf.select(*keys, "lag", "acf").dropna().groupBy(*keys).applyInPandas(one, f"{_keys_schema(acf, keys)}, {kinds}")


def correlation_points(family: str, params: Sequence[float]) -> np.ndarray:
    """Correlation of the target for each of ``RHO_Z``, by two-dimensional Gauss-Hermite quadrature."""
    mean, variance = dist.moments(family, *params)
    x = math.sqrt(2) * _NODES
    a = dist.ppf(family, dist.norm_cdf(x), *params)
    rho = np.array(RHO_Z)[:, None, None]
    b = dist.ppf(family, dist.norm_cdf(rho * x[:, None] + np.sqrt(1 - rho**2) * x[None, :]), *params)
    e = (np.outer(_WEIGHTS, _WEIGHTS) * a[:, None] * b).sum((1, 2)) / math.pi
    out = (e - mean**2) / variance
    return np.where(out < 0, np.nan, out)


def curve(rho: np.ndarray, b: float, c: float) -> np.ndarray:
    return ((1 + b * rho) ** (1 - c) - 1) / ((1 + b) ** (1 - c) - 1)


def fit_curve(rho_x: np.ndarray, rho_z: np.ndarray) -> tuple[float, float]:
    """(b, c) by damped Gauss-Newton steps within bounds, to four places.

    There is no curve (NaN) if a point is negative, NaN or infinite.
    """
    if not (np.isfinite(rho_x).all() and (rho_x >= 0).all()):
        return math.nan, math.nan
    x, z, p = rho_x, rho_z, np.array([0.5, 0.9])
    for _ in range(50):
        f = curve(x, *p)
        step = 1e-6 * np.maximum(np.abs(p), 1e-3)
        j = np.stack([(curve(x, *(p + step * e)) - curve(x, *(p - step * e))) / (2 * step @ e) for e in np.eye(2)], 1)
        if not (np.isfinite(f).all() and np.isfinite(j).all()):
            break
        delta = np.linalg.solve(j.T @ j + 1e-6 * np.eye(2), j.T @ (z - f))
        p = np.clip(p + delta, 1e-6, [1e3, 1e2])
        if np.abs(delta).max() < 1e-10:
            break
    return round(float(p[0]), 4), round(float(p[1]), 4)


def correlation_curves(params: DataFrame, family: str) -> DataFrame:
    """(params, points array, b, c), once for each distinct tuple; scales are at least 1e-4. Tuples without a curve have null b and c."""
    names = dist.PARAMETERS[family]
    tuples = params.select(*(key4(F.greatest(F.col(n), F.lit(1e-4)) if n == "scale" else F.col(n)).cast("double").alias(n) for n in names)).dropna().distinct()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            points = [correlation_points(family, r) for r in rows.itertuples(index=False)]
            fits = [fit_curve(p, np.array(RHO_Z)) for p in points]
            yield rows.assign(rho_x=[p.tolist() for p in points], b=[f[0] for f in fits], c=[f[1] for f in fits])

    return tuples.mapInPandas(work, ", ".join(f"{n} double" for n in names) + ", rho_x array<double>, b double, c double")


def block_means(params: DataFrame, family: str, spec: Disaggregation = Disaggregation(), n: int = 1000) -> DataFrame:
    """(params, xk, fxk, v): sorted means of ``n`` simulated days and the blocks each needs.

    Draws are seeded by the tuple. v is at most its greatest within the clipped range, and at least 1.
    """
    names = dist.PARAMETERS[family]
    tuples = params.select(*names).dropna().distinct()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                rng = np.random.default_rng([spec.seed, *(int(round(v * 1e4)) & 0xFFFFFFFF for v in r)])
                xk = np.sort(dist.ppf(family, rng.random((n, spec.hours)), *r).mean(1))
                fxk, v = blocks_needed(xk, spec)
                yield pd.DataFrame(dict(zip(names, r, strict=True)) | {"xk": xk, "fxk": fxk, "v": v})

    return tuples.mapInPandas(work, ", ".join(f"{p} double" for p in names) + ", xk double, fxk double, v double")


def blocks_needed(xk: np.ndarray, spec: Disaggregation) -> tuple[np.ndarray, np.ndarray]:
    """(positions, blocks) of sorted means: enough blocks that one falls within the tolerance with the confidence."""
    fxk = np.linspace(1 / len(xk), 1, len(xk))
    delta = np.maximum(spec.tolerance * np.abs(xk), spec.tolerance * xk.std())
    u = np.interp(xk + delta, xk, fxk) - np.interp(xk - delta, xk, fxk)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.where(u <= 0, np.inf, np.ceil(math.log(1 - spec.confidence) / np.log(1 - np.minimum(u, 1))))
    edge = (1 - spec.clip) / 2
    inner = v[(fxk >= edge) & (fxk <= 1 - edge)]
    return fxk, np.maximum(np.minimum(v, inner.max() if len(inner) else v.max()), 1)


def autoregression(rho: np.ndarray, known: int | None, from_zero: bool = False) -> tuple[np.ndarray, float]:
    """Coefficients, nearest first, and noise deviation by Yule-Walker.

    The stored rule starts the correlations at lag 1 and uses that as the diagonal; ``from_zero`` puts 1 first.
    ``known`` bounds the order by the values there are to start from.
    """
    rho = np.concatenate([[1.0], rho]) if from_zero else rho
    p = max(int((rho > 0.01).sum()) - 1, 0)
    p = p if known is None else min(p, known)
    lag = np.abs(np.subtract.outer(np.arange(p), np.arange(p)))
    a = np.linalg.solve(rho[lag], rho[1 : p + 1]) if p else np.zeros(0)
    return a, math.sqrt(max(1 - float(rho[1 : p + 1] @ a), 0.0))


def best_block(rng: np.random.Generator, mean: float, blocks: int, family: str, params: Sequence[float], rho: np.ndarray, state: np.ndarray | None, spec: Disaggregation, from_zero: bool = False, gaussian: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The simulated day whose mean is nearest, of ``blocks`` candidates, and the state after it.

    The state holds uniforms, which also start the next day's Gaussian series, as the stored rule has it; with
    ``gaussian`` it holds the Gaussian values themselves, so that the series goes on over midnight. After
    a missing day (``state`` None) an AR(1) series starts it; the first day (empty state) is white noise.
    Candidates are drawn ``CHUNK`` at a time beside the nearest so far by tabulated quantiles; of the ``NEAR`` nearest,
    interpolated quantiles decide.
    """
    a, noise = autoregression(rho, None if state is None else len(state), from_zero)
    p, n = len(a), spec.hours
    start = np.zeros(p)
    if p and state is None:
        first = rho[1] if len(rho) > 1 else 0.0
        for i in range(p):
            start[i] = (start[i - 1] * first if i else 0.0) + rng.normal(0, math.sqrt(max(1 - first**2, 0)))
    elif p:
        start = state[-p:]
    # what the start and each hour's noise add to every hour: the recursion as one product
    steady, answer = np.concatenate([start, np.zeros(n)]), np.concatenate([np.zeros(p), [1.0], np.zeros(n - 1)])
    for i in range(n):
        steady[p + i] = steady[i : p + i] @ a[::-1]
        if i:
            answer[p + i] = answer[i : p + i] @ a[::-1]
    spread = (noise * np.tril(answer[p:][np.maximum(np.subtract.outer(np.arange(n), np.arange(n)), 0)])).astype(np.float32)
    centre, (at, exact, table) = steady[p:, None].astype(np.float32), _quantiles(family, tuple(params))
    found: list[np.ndarray] = []
    for done in range(0, blocks, CHUNK):
        z = spread @ rng.standard_normal((n, min(CHUNK, blocks - done)), dtype=np.float32) + centre
        place = np.clip((z + _REACH) * (len(table) / (2 * _REACH)), 0, len(table) - 1).astype(np.int32)
        off = np.abs(table[place].mean(0) - mean)
        some = np.argpartition(off, min(NEAR, len(off)) - 1)[:NEAR]
        found = [np.concatenate([*found, np.concatenate([off[some][None], z[:, some]])], axis=1)]
        found = [found[0][:, np.argsort(found[0][0], kind="stable")[:NEAR]]]
    z = found[0][1:].T.astype(float)
    x = np.interp(z, at, exact)
    k = int(np.abs(x.mean(1) - mean).argmin())
    return x[k], np.concatenate([state if state is not None else np.zeros(0), z[k] if gaussian else _uniform(z[k])])[-spec.lags :]


def _uniform(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.7978845608028654 * z))


@lru_cache(maxsize=64)
def _quantiles(family: str, params: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Gaussian values, a distinct tuple's quantiles at them, quantiles at the middles of ``TABLE`` equal steps).

    Straight lines between 8192 values are within 1e-6 of the scale, less than the hours' float shows.
    """
    at = np.linspace(-_REACH, _REACH, 8192)
    exact = dist.ppf(family, _uniform(at), *params)
    fine = (np.arange(TABLE) + 0.5) * (2 * _REACH / TABLE) - _REACH
    return at, exact, np.interp(fine, at, exact).astype(np.float32)


def disaggregate(days: DataFrame, keys: Sequence[str], family: str, spec: Disaggregation = Disaggregation(), from_zero: bool = False, gaussian: bool = False) -> DataFrame:
    """(keys, time, ntr float) hourly, from days with xk, the marginal's parameters, acs_scale, acs_shape, b, c and v.

    One task runs a series along its time, holding the last ``spec.lags`` values; the seed is the series' key, so
    results don't depend on the partitioning. Days without parameters are null. ``from_zero`` and ``gaussian`` take the other
    readings of the correlations' first lag and of what starts a day (``autoregression``, ``best_block``).
    """
    names = dist.PARAMETERS[family]
    lag = np.arange(1, spec.lags + 1)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([spec.seed, *"|".join(map(str, key)).encode()])
        state: np.ndarray | None = np.zeros(0)
        values, times = [], []
        for r in rows.sort_values("time").itertuples(index=False):
            params = [getattr(r, n) for n in names]
            times.append(pd.date_range(r.time, periods=spec.hours, freq="h"))
            if not np.isfinite([*params, r.xk, r.b, r.c, r.v, r.acs_scale, r.acs_shape]).all():
                values.append(np.full(spec.hours, np.nan))
                state = None
                continue
            rho = curve(np.exp(-((lag / r.acs_scale) ** r.acs_shape)), r.b, r.c)
            x, state = best_block(rng, r.xk, int(max(r.v, 1)), family, params, rho, state, spec, from_zero, gaussian)
            values.append(x)
        out = pd.DataFrame({"time": np.concatenate(times), "ntr": np.concatenate(values).astype("float32")})
        out[list(keys)] = key
        return out[[*keys, "time", "ntr"]]

    # few bytes but much work: as many tasks as the session has for a shuffle, which AQE doesn't merge by size
    tasks = int(days.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return days.repartition(tasks, *keys).groupBy(*keys).applyInPandas(one, f"{_keys_schema(days, keys)}, time timestamp_ntz, ntr float")
