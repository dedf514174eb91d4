"""Sources: CSV, TSV, fixed width text, JSON payloads and Parquet, with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marigrid.functions.scalar import wrap_longitude
from marigrid.schema import nan_to_null


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str, sep: str = ",") -> DataFrame:
    """A header line, NaN as null."""
    return nan_to_null(spark.read.schema(schema).option("header", True).option("sep", sep).option("enforceSchema", False).csv(paths))


def read_csv_after_preamble(spark: SparkSession, paths: str | Sequence[str], header: Sequence[str], schema: str, sep: str = ",") -> DataFrame:
    """Lines after the one that holds ``header``; names lose their blanks. Data lines start with a digit or sign."""
    lines = spark.read.text(paths).select(F.trim("value").alias("value")).filter(F.col("value").rlike("^[-+0-9]"))
    rows = lines.select(F.from_csv("value", schema, {"sep": sep, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r")).select("r.*")
    return nan_to_null(rows.toDF(*(h.strip() for h in header)))


def read_fixed_width(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str], widths: Sequence[int] | None = None) -> DataFrame:
    """Columns cut by ``widths``, or by runs of blanks; all strings, lines without a leading number are left out."""
    lines = spark.read.text(paths).filter(F.col("value").rlike(r"^\s*[-+0-9]"))
    if widths is None:
        parts = F.split(F.trim("value"), r"\s+")
        return lines.select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))
    starts = [sum(widths[:i]) + 1 for i in range(len(widths))]
    return lines.select(*(F.trim(F.substring("value", s, w)).alias(n) for n, s, w in zip(names, starts, widths, strict=True)))


def detect_widths(line: str) -> list[int]:
    """Widths of right-aligned columns, from the ends of a line's fields."""
    import re

    ends = [m.end() for m in re.finditer(r"\S+", line)]
    return [b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def read_series_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(other columns, time, value) of JSON with a list under "data" or "predictions"; empty values go, errors give no rows."""
    item = "array<struct<t:string,v:string>>"
    parsed = df.withColumn("__p", F.from_json(payload, f"struct<data:{item},predictions:{item}>"))
    rows = parsed.withColumn("__i", F.explode(F.coalesce("__p.data", "__p.predictions"))).filter(F.length(F.trim("__i.v")) > 0)
    return rows.select(*(c for c in df.columns if c != payload), F.to_timestamp_ntz("__i.t").alias("time"), F.col("__i.v").cast("double").alias("value"))


def read_partitioned(spark: SparkSession, paths: str | Sequence[str], first_year: int, last_year: int, year: str = "year") -> DataFrame:
    """Parquet with a year partition; other years' files aren't listed for reading."""
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).filter(F.col(year).between(first_year, last_year))


def read_many(spark: SparkSession, paths: Iterable[str], prepare=lambda df: df) -> DataFrame:
    """Parquet paths with one preparation; columns that a path lacks are null."""
    out: DataFrame | None = None
    for p in paths:
        df = prepare(spark.read.parquet(p))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out


def with_name_parts(df: DataFrame, names: Sequence[str], sep: str = "_", suffix: str = "") -> DataFrame:
    """Fields of the file's name as columns; None skips one."""
    stem = F.replace(F.col("_metadata.file_name"), F.lit(suffix), F.lit("")) if suffix else F.col("_metadata.file_name")
    parts = F.split(stem, sep)
    return df.select("*", *(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names) if n))


def decode_days(days, origin: str = "1850-01-01"):
    """Days since ``origin`` as timestamps; values out of (0.1, 300000) are null."""
    whole = F.make_dt_interval(F.floor(days).cast("int"), F.lit(0), F.lit(0), ((days - F.floor(days)) * 86400).cast("decimal(18,6)"))
    return F.when((days > 0.1) & (days < 300000), F.to_timestamp_ntz(F.lit(origin)) + whole)


def tidal_stations(df: DataFrame) -> DataFrame:
    """S16."""
    return df.filter("tidal").select("id", "lat", "lng", "state", "timezonecorr")


def availability(spark: SparkSession, log: dict[str, Sequence[str]]) -> DataFrame:
    """A download log (status -> names) as rows."""
    schema = StructType.fromDDL("status string, name string")
    return spark.createDataFrame([(s, n) for s, names in log.items() for n in names or ()], schema)


def read_download_logs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, key, value) of logs that are flat YAML maps, one a file and each in one task.

    Quotes go, doubled single quotes become one; keys over two lines ("? key" and ": value") count. Comments, lists and
    indented lines give no rows; an empty value or "null" is null. An empty log gives one row with a null key, so that it
    isn't lost (``missing_logs``).
    """
    quoted = "'(?:[^']|'')*'|\"[^\"]*\""
    text = F.regexp_replace("value", r"(?m)^\? (.*)\r?\n: ", "$1: ")
    pattern = rf"^({quoted}|[^\s#'\"\[{{-](?:[^:]|:(?=\S))*?)\s*:(?:\s+({quoted}|[^#].*?))?\s*$"

    def plain(c: Column) -> Column:
        single = F.replace(F.regexp_extract(c, r"^'(.*)'$", 1), F.lit("''"), F.lit("'"))
        return F.when(c.rlike("^'.*'$"), single).when(c.rlike('^".*"$'), F.regexp_extract(c, '^"(.*)"$', 1)).otherwise(c)

    found = F.filter(F.split(text, r"\r?\n"), lambda one: one.rlike(pattern))
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.explode_outer(found).alias("line"))
    value = plain(F.regexp_extract("line", pattern, 2))
    return rows.select("path", plain(F.regexp_extract("line", pattern, 1)).alias("key"), F.when(~value.isin("", "null", "~"), value).alias("value"))


def missing_logs(logs: DataFrame, suffix: str = ".nc") -> DataFrame:
    """(path, n_files, missing): how many keys of a log name files, and whether none does."""
    n = F.count_if(F.endswith("key", F.lit(suffix)))
    return logs.groupBy("path").agg(n.alias("n_files"), (n == 0).alias("missing"))


def read_grid(spark: SparkSession, paths: str | Sequence[str], x: str = "lon", ordered: bool = False) -> DataFrame:
    """Gridded Parquet with longitudes from -180 to 180. Rows have no order, as writers sort; ``ordered`` sorts by ``x``."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    df = df.withColumn(x, wrap_longitude(F.col(x)))
    return df.orderBy(x) if ordered else df


def standard_date(year: Column, month: Column, day: Column) -> Column:
    """A date of a calendar with 360 days as the standard date at the same share of the year, ties to even."""
    first = F.make_date(year, F.lit(1), F.lit(1))
    length = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    return F.date_add(first, (F.bround(((month - 1) * 30 + day) * length / F.lit(360.0), 0) - 1).cast("int"))


def scan_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV or Parquet by the path's suffix; without a schema a CSV file's types are inferred."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return nan_to_null((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))
    if path.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    raise ValueError(f"neither CSV nor Parquet: {path}")
