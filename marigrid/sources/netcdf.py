"""Classic NetCDF files (formats 1, 2 and 5) as a data source that Spark plans: slices of the first dimension are tasks."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from marigrid.functions.scalar import wrap_longitude

#: Cells of a task and of a batch at most, if one step of the first dimension has no more.
CELLS = 1_000_000
#: Rows from which on a batch is handed on.
BATCH = 65_536
#: Fixed values of the format: numpy's names of its types; text (2) holds no numbers.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


@dataclass
class Variable:
    name: str
    dims: list[str]
    shape: list[int]
    attributes: dict[str, Any]
    type: np.dtype
    begin: int
    record: bool


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def files(path: str) -> list[str]:
    """The files of a comma-separated list of files and folders, without empty ones."""
    out = []
    for one in filter(None, map(str.strip, path.split(","))):
        system, inner = _system(one)
        root = one[: len(one) - len(inner)]
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(one)
        found = [info] if info.type == fs.FileType.File else sorted((i for i in system.get_file_info(fs.FileSelector(inner)) if i.path.endswith(".nc")), key=lambda i: i.path)
        out += [root + i.path for i in found if i.size]
    return out


def header(path: str) -> tuple[dict[str, Variable], int]:
    """A file's variables and the bytes of a record."""
    system, inner = _system(path)
    with system.open_input_stream(inner, buffer_size=1 << 16) as f:

        def take(form: str) -> int:
            return struct.unpack(">" + form, f.read(struct.calcsize(form)))[0]

        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError(f"not a classic NetCDF file: {path}")
        count, offset = ("Q" if magic[3] == 5 else "I"), ("I" if magic[3] == 1 else "Q")

        def text() -> str:
            n = take(count)
            return f.read(n + -n % 4)[:n].decode()

        def attributes() -> dict[str, Any]:
            take("I")
            out: dict[str, Any] = {}
            for _ in range(take(count)):
                name, kind, n = text(), np.dtype(TYPES[take("I")]), take(count)
                size = n * kind.itemsize
                raw = f.read(size + -size % 4)[:size]
                out[name] = raw.decode(errors="replace") if kind.kind == "S" else np.frombuffer(raw, kind)
            return out

        records = take(count)
        take("I")
        dims = [(text(), take(count)) for _ in range(take(count))]
        attributes()
        take("I")
        found: dict[str, Variable] = {}
        for _ in range(take(count)):
            name = text()
            ids = [take(count) for _ in range(take(count))]
            own, kind = attributes(), np.dtype(TYPES[take("I")])
            take(count)  # the variable's size: it overflows in large files and follows from the shape
            record = bool(ids) and dims[ids[0]][1] == 0
            shape = [records if dims[i][1] == 0 else dims[i][1] for i in ids]
            found[name] = Variable(name, [dims[i][0] for i in ids], shape, own, kind, take(offset), record)
        steps = [math.prod(v.shape[1:]) * v.type.itemsize for v in found.values() if v.record]
        record_bytes = steps[0] if len(steps) == 1 else sum(s + -s % 4 for s in steps)
        if records == (1 << (64 if count == "Q" else 32)) - 1:  # a file that was streamed: its length tells
            first = min((v.begin for v in found.values() if v.record), default=0)
            records = (system.get_file_info(inner).size - first) // record_bytes if record_bytes else 0
            for v in found.values():
                if v.record:
                    v.shape[0] = records
    return found, record_bytes


def _values(f: pa.NativeFile, v: Variable, record_bytes: int, i: int, first: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` numbers from place ``first`` on of step ``i`` of the first dimension, unpacked; what is missing is NaN."""
    step = math.prod(v.shape[1:])
    count = step - first if count is None else count
    start = v.begin + (i * record_bytes if v.record else i * step * v.type.itemsize)
    raw = np.frombuffer(f.read_at(count * v.type.itemsize, start + first * v.type.itemsize), v.type)
    out = raw.astype(float)
    for name in ("_FillValue", "missing_value"):
        if len(v.attributes.get(name, ())) and not isinstance(v.attributes[name], str):
            out[np.isin(raw, v.attributes[name])] = np.nan
    scale, shift = (float(v.attributes[n][0]) if n in v.attributes else d for n, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
    return out if (scale, shift) == (1.0, 0.0) else out * scale + shift


@dataclass
class Slice(InputPartition):
    path: str
    start: int
    stop: int


def _passes(values: np.ndarray, tests: list[tuple[str, Any]]) -> np.ndarray:
    ok = np.ones(len(values), bool)
    for how, value in tests:
        ok &= {"=": lambda: values == value, ">": lambda: values > value, ">=": lambda: values >= value, "<": lambda: values < value, "<=": lambda: values <= value, "in": lambda: np.isin(values, value)}[how]()  # noqa: B023
    return ok


class NetCDFReader(DataSourceReader):
    """Slices of the first dimension; ``tests`` on dimensions choose what is read of them."""

    def __init__(self, paths: list[str], names: list[str], dims: list[str], cells: int):
        self.paths, self.names, self.dims, self.cells = paths, names, dims, cells
        self.tests: dict[str, list[tuple[str, Any]]] = {}

    def partitions(self) -> list[Slice]:
        out = []
        for path in self.paths:
            shape = self._wanted(header(path)[0], path)[0].shape
            if math.prod(shape):
                steps = max(1, self.cells // math.prod(shape[1:])) if shape else 1
                n = shape[0] if shape else 1
                out += [Slice(path, s, min(n, s + steps)) for s in range(0, n, steps)]
        return out or [Slice("", 0, 0)]

    def _wanted(self, found: dict[str, Variable], path: str) -> list[Variable]:
        lacking = [n for n in self.names if n not in found]
        if lacking or any(found[n].dims != self.dims for n in self.names):
            raise ValueError(f"{path}: variables {self.names} with the dimensions {self.dims} are needed")
        return [found[n] for n in self.names]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        found, record_bytes = header(partition.path)
        wanted = self._wanted(found, partition.path)
        shape = wanted[0].shape
        system, inner = _system(partition.path)
        names = [*self.dims, *self.names]
        with system.open_input_file(inner) as f:

            def axis(d: int, start: int, stop: int) -> np.ndarray:
                v = found.get(self.dims[d])
                if v is None or v.dims != [self.dims[d]] or v.type.kind == "S":
                    return np.arange(start, stop, dtype=float)  # no coordinates: places
                if v.record:
                    return np.concatenate([_values(f, v, record_bytes, i) for i in range(start, stop)])
                return _values(f, Variable(v.name, [], [1, *v.shape], v.attributes, v.type, v.begin, False), 0, 0, start, stop - start)

            axes = [axis(0, partition.start, partition.stop)] if shape else []
            axes += [axis(d, 0, shape[d]) for d in range(1, len(shape))]
            keep = [_passes(a, self.tests.get(n, [])) for a, n in zip(axes, self.dims, strict=True)]
            if not all(k.any() for k in keep):
                return
            # of the second dimension only what lies between its first and last place that pass is read
            row = math.prod(shape[2:])
            places = np.flatnonzero(keep[1]) if len(shape) > 1 else np.array([0])
            low, high = int(places[0]), int(places[-1]) + 1
            rows = max(1, self.cells // max(row, 1))
            held: list[list[np.ndarray]] = []  # of small steps, to be one batch

            def batch() -> pa.RecordBatch:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, pa.float64(), from_pandas=True) for c in columns], names=names)

            for i in np.flatnonzero(keep[0]) if shape else [0]:
                for at in range(low, high, rows):
                    end = min(high, at + rows)
                    grid = [axes[0][i : i + 1], axes[1][at:end], *axes[2:]] if len(shape) > 1 else [a[i : i + 1] for a in axes]
                    masks = [keep[0][i : i + 1], keep[1][at:end], *keep[2:]] if len(shape) > 1 else [k[i : i + 1] for k in keep]
                    mask = np.ones([len(a) for a in grid], bool)
                    for d, k in enumerate(masks):
                        mask &= k.reshape([-1 if e == d else 1 for e in range(len(grid))])
                    flat = mask.ravel()
                    columns = [np.broadcast_to(a.reshape([-1 if e == d else 1 for e in range(len(grid))]), mask.shape).ravel()[flat] for d, a in enumerate(grid)]
                    columns += [_values(f, v, record_bytes, partition.start + int(i), at * row, (end - at) * row)[flat] for v in wanted]
                    held.append(columns)
                    if sum(len(c[0]) for c in held) >= min(self.cells, BATCH):
                        yield batch()
            if held:
                yield batch()


class FilteredReader(NetCDFReader):
    """The reader where Spark pushes filters; Spark applies all of them again."""

    _KINDS = ((EqualTo, "="), (GreaterThan, ">"), (GreaterThanOrEqual, ">="), (LessThan, "<"), (LessThanOrEqual, "<="), (In, "in"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            how = next((h for k, h in self._KINDS if type(one) is k), None)
            if how and len(one.attribute) == 1 and one.attribute[0] in self.dims and one.value is not None:
                value = [x for x in one.value if x is not None] if how == "in" else one.value
                self.tests.setdefault(one.attribute[0], []).append((how, value))
        return filters


class NetCDFSource(DataSource):
    """Options: ``path`` (files and folders, local or URIs that pyarrow opens), ``variable`` (a list with commas), ``cells``, ``pushed`` (whether filters are)."""

    @classmethod
    def name(cls) -> str:
        return "netcdf_classic"

    def _plan(self) -> tuple[list[str], list[str], list[str]]:
        names = [n.strip() for n in self.options["variable"].split(",")]
        paths = files(self.options["path"])
        if not paths:
            raise ValueError(f"no files that hold anything: {self.options['path']}")
        found = header(paths[0])[0]
        if names[0] not in found:
            raise ValueError(f"{paths[0]} has no variable {names[0]}")
        return paths, names, found[names[0]].dims

    def schema(self) -> str:
        _, names, dims = self._plan()
        return ", ".join(f"`{n}` double" for n in [*dims, *names])

    def reader(self, schema: Any) -> NetCDFReader:
        kind = FilteredReader if self.options.get("pushed") == "true" else NetCDFReader
        return kind(*self._plan(), int(self.options.get("cells", CELLS)))


def read_netcdf(spark: SparkSession, path: str, variables: list[str], x: str | None = None, cells: int = CELLS) -> DataFrame:
    """(a column for each dimension, one for each variable) of classic NetCDF files; all are doubles.

    ``path``: files and folders (their ``.nc`` files) with commas between them, on a file system that driver and executors
    share; empty files are skipped, as are folders' other files. Variables share their dimensions; only those named
    are read. Packed numbers are unpacked; fill values and NaN are null, rows of missing cells stay. A dimension without
    coordinates gives places from 0 on. Times stay numbers (``readers.decode_days``). ``x`` names a longitude to wrap to
    -180 to 180: filters on it are then no longer pushed, those on other dimensions are, where the session has
    ``spark.sql.python.filterPushdown.enabled`` (``session.session`` sets it). A task reads ``cells`` cells or one step of the first dimension, in batches of
    about as many. Files of format 4 (HDF5) and files that lack a variable raise ``ValueError``.
    """
    spark.dataSource.register(NetCDFSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    df = spark.read.format(NetCDFSource.name()).option("pushed", pushed).option("variable", ",".join(variables)).option("cells", cells).option("path", path).load()
    return df.withColumn(x, wrap_longitude(F.col(x))) if x else df
