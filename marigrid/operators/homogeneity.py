"""Is a region homogeneous? Hosking and Wallis' H, by simulation from a kappa distribution."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marigrid.functions.distributions import lgamma
from marigrid.functions.optimize import nelder_mead
from marigrid.functions.scalar import quotient
from marigrid.operators.stats import dispersion, l_moments


def _g(k: float, h: float) -> np.ndarray:
    """g_1 to g_4 of the kappa distribution's L-moments; NaN where they don't exist."""
    r = np.arange(1, 5.0)
    if abs(h) < 1e-6:
        return r**-k * np.exp(lgamma(1 + k)) if k > -1 else np.full(4, np.nan)
    if h > 0:
        return r * np.exp(lgamma(1 + k) + lgamma(r / h) - lgamma(1 + k + r / h)) / h ** (1 + k) if k > -1 else np.full(4, np.nan)
    if k <= -1 or -k - 1 / h <= 0:
        return np.full(4, np.nan)
    return r * np.exp(lgamma(1 + k) + lgamma(-k - r / h) - lgamma(1 - r / h)) / (-h) ** (1 + k)


def ratios(k: float, h: float) -> tuple[float, float]:
    """t3 and t4 of a kappa distribution (Hosking 1994; the stored rule, which is unfinished, has t4 with the other sign)."""
    a, b, c, d = _g(k, h)
    return float((-a + 3 * b - 2 * c) / (a - b)), float((a - 6 * b + 10 * c - 5 * d) / (a - b))


def fit_kappa(l1: float, l2: float, t3: float, t4: float) -> tuple[float, float, float, float]:
    """(location, scale, k, h), k and h within (-1, 3), whose L-moments are nearest: t3 and t4 by search from several starts."""

    def off(p: np.ndarray) -> float:
        k, h = p
        if not (-1 < k < 3 and -1 < h < 3):
            return 1e9
        u, v = ratios(k, h)
        return (u - t3) ** 2 + (v - t4) ** 2 if np.isfinite(u + v) else 1e9

    found = [nelder_mead(off, start, 300, tolerance=1e-10) for start in ((0.1, 0.1), (0.5, 0.8), (-0.2, -0.3), (0.3, -0.5))]
    k, h = min(found, key=off)
    k = k if abs(k) > 1e-6 else 1e-6
    a, b, *_ = _g(k, h)
    scale = k * l2 / (a - b)
    return float(l1 - scale * (1 - a) / k), float(scale), float(k), float(h)


def kappa_quantiles(u: np.ndarray, location: float, scale: float, k: float, h: float) -> np.ndarray:
    inner = -np.log(u) if abs(h) < 1e-6 else (1 - u**h) / h
    return location + scale * (1 - inner**k) / k


def weighted_spread(samples: Sequence[np.ndarray]) -> float:
    """V: the weighted spread of l2 / l1 over samples."""
    n = np.array([len(s) for s in samples], float)
    means = np.array([s.mean() for s in samples])
    b1 = np.array([(np.sort(s) * np.arange(len(s))).sum() / (len(s) * (len(s) - 1)) for s in samples])
    t = (2 * b1 - means) / means
    at = (t * n).sum() / n.sum()
    return float(((t - at) ** 2 * n).sum() / n.sum())


def homogeneity(df: DataFrame, keys: Sequence[str], site: Sequence[str], value: str, simulations: int = 1000, seed: int = 7) -> DataFrame:
    """(keys, sites, v, mean_v, std_v, h) of each region: how far its sites' spread of L-CV lies from that of equal sites.

    Sites' L-moments and V come from grouped aggregates; the kappa distribution of each region's average ratios is fitted
    from one row. Each simulation is a row of its own, spread over all tasks and seeded by region and number, so
    that results don't depend on the partitioning; a task holds one simulated region at a time. Sites with under four
    values, and regions with under two such sites or a mean of 0, have no H and aren't in the result.
    """
    keys = list(keys)
    sites = l_moments(df, [*keys, *site], value).filter(F.col("l4").isNotNull() & (F.col("l1") != 0) & (F.col("l2") != 0))
    seen = dispersion(sites, keys).join(sites.groupBy(*keys).agg(F.collect_list("n").alias("sizes")), keys)
    seen = seen.filter(F.size("sizes") > 1).withColumn("sizes", F.sort_array("sizes"))
    named = seen.withColumn("own_hash", F.xxhash64(*keys) if keys else F.lit(0).cast("long"))
    kinds = dict(named.dtypes)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(kappa=[list(fit_kappa(r.l1, r.l2, r.t3, r.t4)) for r in rows.itertuples()])

    columns = [*keys, "own_hash", "v", "sizes", "l1", "l2", "t3", "t4"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", kappa array<double>"
    regions = named.select(*columns).mapInPandas(fitted, schema)

    def simulated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                rng = np.random.default_rng([seed, r.own_hash & 0xFFFFFFFFFFFFFFFF, r.simulation])
                out.append(weighted_spread([kappa_quantiles(rng.random(int(n)), *r.kappa) for n in r.sizes]))
            yield rows[[*keys, "v", "sites"]].assign(simulated=out)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = regions.select(*keys, "own_hash", "v", F.size("sizes").alias("sites"), "sizes", "kappa", F.explode(F.sequence(F.lit(1), F.lit(simulations))).alias("simulation")).repartition(tasks, "own_hash", "simulation")
    result = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "v double, sites int, simulated double"])
    worlds = drawn.mapInPandas(simulated, result).groupBy(*keys, "v", "sites").agg(F.avg("simulated").alias("mean_v"), F.stddev_pop("simulated").alias("std_v"))
    return worlds.select(*keys, "sites", "v", "mean_v", "std_v", quotient(F.col("v") - F.col("mean_v"), F.col("std_v")).alias("h"))
