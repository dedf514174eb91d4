"""The batch operators' counterparts on streams: extensions, as the batch side has no stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marigrid.functions import distributions as dist
from marigrid.operators.disagg import best_block, curve
from marigrid.params import Disaggregation


def _stamped(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks need zoned stamps; the session's zone is UTC."""
    return stream.withColumn(time, F.col(time).cast("timestamp_ltz"))


def daily_means(stream: DataFrame, keys: Sequence[str], value: str, time: str = "time", late: str = "1 day") -> DataFrame:
    """A1 in tumbling windows; rows later than ``late`` are dropped, so state is bounded."""
    days = _stamped(stream, time).withWatermark(time, late).groupBy(*keys, F.window(time, "1 day").alias("w"))
    return days.agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").cast("timestamp_ntz").alias("time"), value, "n")


def sessions(stream: DataFrame, keys: Sequence[str], gap: str = "48 hours", time: str = "time", late: str = "1 day") -> DataFrame:
    """(keys, first, last, n) of segments that end after ``gap`` without a row."""
    groups = _stamped(stream, time).withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("s"))
    edge = lambda f, name: f(time).cast("timestamp_ntz").alias(name)
    return groups.agg(edge(F.min, "first"), edge(F.max, "last"), F.count(F.lit(1)).alias("n")).drop("s")


def gap_alerts(stream: DataFrame, key: str, hours: float, time: str = "time") -> DataFrame:
    """(key, start, stop, hours) whenever a series' next row comes after more than ``hours``; state is its last stamp."""

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = np.sort(np.concatenate([b[time].to_numpy("datetime64[us]") for b in batches]))
        if state.exists:
            t = np.concatenate([[np.datetime64(state.get[0], "us")], t])
        state.update((int(t.max().astype("int64")),))
        step = np.diff(t).astype("timedelta64[us]").astype(float) / 3.6e9
        at = np.flatnonzero(step > hours)
        yield pd.DataFrame({key: [k[0]] * len(at), "start": t[at], "stop": t[at + 1], "hours": step[at]})

    kind = dict(stream.dtypes)[key]
    return stream.select(key, time).groupBy(key).applyInPandasWithState(work, f"`{key}` {kind}, start timestamp_ntz, stop timestamp_ntz, hours double", "last long", "append", GroupStateTimeout.NoTimeout)


def disaggregate(stream: DataFrame, key: str, family: str, spec: Disaggregation = Disaggregation()) -> DataFrame:
    """Days of one series after another to hours; state is the last ``spec.lags`` values.

    Days of a batch are taken in order; draws are seeded by series and day, so a replayed batch gives the same
    hours. Days without parameters are null and start the state anew.
    """
    names, lag = dist.PARAMETERS[family], np.arange(1, spec.lags + 1)

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get[0] if state.exists else []
        z = None if kept is None else np.array(kept)
        rows = pd.concat(list(batches)).sort_values("time")
        for r in rows.itertuples(index=False):
            rng = np.random.default_rng([spec.seed, *f"{k[0]}|{r.time}".encode()])
            if not np.isfinite([float("nan") if v is None else v for v in (r.xk, r.b, r.c, r.v, r.acs_scale, r.acs_shape, *(getattr(r, n) for n in names))]).all():
                z = None
                yield pd.DataFrame({key: k[0], "time": pd.date_range(r.time, periods=spec.hours, freq="h"), "ntr": np.full(spec.hours, np.nan, "float32")})
                continue
            rho = curve(np.exp(-((lag / r.acs_scale) ** r.acs_shape)), r.b, r.c)
            x, z = best_block(rng, r.xk, int(max(r.v, 1)), family, [getattr(r, n) for n in names], rho, z, spec)
            yield pd.DataFrame({key: k[0], "time": pd.date_range(r.time, periods=spec.hours, freq="h"), "ntr": x.astype("float32")})
        state.update((None if z is None else z.tolist(),))

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(work, f"`{key}` {kind}, time timestamp_ntz, ntr float", "z array<double>", "append", GroupStateTimeout.NoTimeout)
