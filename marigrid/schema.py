"""Schemas of the inputs, and what missing values become."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

LEVELS = "time timestamp_ntz, value double"
TREND = "Year int, ` Month` int, ` Linear_Trend` double"
STATIONS = "id long, lat double, lng double, state string, timezonecorr int, tidal boolean"
CLIMATE_INDEX = "year int, month int, nino34 double"
PARAMETERS = "x double, y double, ts timestamp_ntz, param string, value double"
MANIFEST = "model string, ripf string, exp string, lat double, lon double"
CATALOGUE = "id string, source_id string, experiment_id string, variant_label string, table_id string, variable_id string, grid string, grid_label string"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing floating point values as nulls, once, where data come in: aggregates then skip them."""
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None)) for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))})
