"""Files are written here byte by byte, after the public description of the classic format."""

import struct

import numpy as np
import pytest
from marigrid.sources import netcdf

CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}


def padded(b):
    return b + b"\0" * (-len(b) % 4)


def classic(path, dims, variables, version=1, streamed=False):
    """dims: name -> size, None for records. variables: name -> (dims, array, attributes)."""
    n = "Q" if version == 5 else "I"
    number = lambda k: struct.pack(">" + n, k)
    text = lambda s: number(len(s)) + padded(s.encode())
    listed = lambda tag, items: (struct.pack(">I", tag) + number(len(items)) + b"".join(items)) if items else struct.pack(">I", 0) + number(0)

    def attributes(found):
        out = []
        for k, a in found.items():
            if isinstance(a, str):
                out.append(text(k) + struct.pack(">I", 2) + text(a))
            else:
                out.append(text(k) + struct.pack(">I", CODES[a.dtype.str[1:]]) + number(a.size) + padded(a.astype(a.dtype.newbyteorder(">")).tobytes()))
        return listed(12, out)

    order = list(dims)
    records = next((a.shape[0] for d, a, _ in variables.values() if d and dims[d[0]] is None), 0)
    data = {k: a.astype(a.dtype.newbyteorder(">")) for k, (_, a, _) in variables.items()}
    recorded = [k for k, (d, _, _) in variables.items() if d and dims[d[0]] is None]

    def head(begins):
        out = b"CDF" + bytes([version]) + (b"\xff" * struct.calcsize(n) if streamed else number(records))
        out += listed(10, [text(d) + number(s or 0) for d, s in dims.items()]) + attributes({"title": "made by a test"})
        items = []
        for k, (d, a, at) in variables.items():
            items.append(text(k) + number(len(d)) + b"".join(number(order.index(x)) for x in d) + attributes(at) + struct.pack(">I", CODES[a.dtype.str[1:]]) + number(0) + struct.pack(">" + ("I" if version == 1 else "Q"), begins[k]))
        return out + listed(11, items)

    begins, at = {}, len(head(dict.fromkeys(variables, 0)))
    body = b""
    for k in variables:
        if k not in recorded:
            begins[k] = at + len(body)
            body += padded(data[k].tobytes())
    pad = padded if len(recorded) > 1 else bytes
    step = at + len(body)
    for k in recorded:
        begins[k] = step
        step += len(pad(data[k][:1].tobytes())) if records else 0
    for r in range(records):
        for k in recorded:
            body += pad(data[k][r : r + 1].tobytes())
    path.write_bytes(head(begins) + body)
    return str(path)


def cube(t=7, y=4, x=5, seed=0):
    rng = np.random.default_rng(seed)
    packed = rng.integers(-300, 300, (t, y, x)).astype("i2")
    packed[rng.random((t, y, x)) < 0.2] = -999
    other = rng.standard_normal((t, y, x)).astype("f4")
    other[0, 0, 0] = np.nan
    return packed, other, np.arange(t) * 1.5, np.linspace(-1, 2, y), np.arange(x) * 90.0


def rows_of(packed, other, time, lat, lon):
    out = []
    for i, a in enumerate(time):
        for j, b in enumerate(lat):
            for k, c in enumerate(lon):
                v, w = packed[i, j, k], float(other[i, j, k])
                out.append((a, b, c, None if v == -999 else v * 0.5 + 10, None if np.isnan(w) else w))
    return sorted(out, key=str)


def tables(packed, other, time, lat, lon):
    d = ["time", "lat", "lon"]
    at = {"_FillValue": np.array([-999], "i2"), "scale_factor": np.array([0.5]), "add_offset": np.array([10.0]), "units": "mm"}
    return {"lat": (["lat"], lat, {}), "lon": (["lon"], lon, {"units": "degrees_east"}), "time": (["time"], time, {"units": "days since 1850-01-01"}), "zos": (d, packed, at), "psl": (d, other, {})}


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("records", [True, False])
@pytest.mark.parametrize("cells", [1, 13, 10**6])
def test_round_trip(spark, tmp_path, version, records, cells):
    a = cube()
    p = classic(tmp_path / "a.nc", {"time": None if records else 7, "lat": 4, "lon": 5}, tables(*a), version, streamed=records and version == 2)
    got = netcdf.read_netcdf(spark, p, ["zos", "psl"], cells=cells)
    assert got.columns == ["time", "lat", "lon", "zos", "psl"]
    assert sorted(map(tuple, got.collect()), key=str) == rows_of(*a)


def test_filters_choose_what_is_read(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        a = cube(seed=1)
        p = classic(tmp_path / "a.nc", {"time": None, "lat": 4, "lon": 5}, tables(*a))
        df = netcdf.read_netcdf(spark, p, ["zos", "psl"], cells=20)
        got = df.filter("time between 1.5 and 4.5 and lat >= 0 and lon in (90.0, 270.0) and zos > 0").collect()
        want = [r for r in rows_of(*a) if 1.5 <= r[0] <= 4.5 and r[1] >= 0 and r[2] in (90, 270) and r[3] is not None and r[3] > 0]
        assert sorted(map(tuple, got), key=str) == want
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = netcdf.FilteredReader([p], ["zos"], ["time", "lat", "lon"], 20)
    reader.pushFilters([netcdf.EqualTo(("time",), 3.0), netcdf.LessThan(("lat",), 0.5), netcdf.GreaterThan(("zos",), 0.0)])
    parts = reader.partitions()
    assert len(parts) == 7
    assert [sum(b.num_rows for b in reader.read(s)) for s in parts] == [0, 0, 10, 0, 0, 0, 0]


def test_many_files_wrapped(spark, tmp_path):
    cubes = [cube(seed=s) for s in (2, 3)]
    for i, a in enumerate(cubes):
        classic(tmp_path / f"{i}.nc", {"time": None, "lat": 4, "lon": 5}, tables(*a))
    (tmp_path / "empty.nc").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("no grid")
    got = netcdf.read_netcdf(spark, str(tmp_path), ["psl"], x="lon")
    assert got.count() == 2 * 7 * 4 * 5
    assert sorted(r[0] for r in got.select("lon").distinct().collect()) == [-180, -90, 0, 90]


def test_odd_files(spark, tmp_path):
    one = classic(tmp_path / "one.nc", {"t": None}, {"v": (["t"], np.array([1, 2, 3], "i2"), {})})  # one record variable isn't padded
    assert sorted(map(tuple, netcdf.read_netcdf(spark, one, ["v"]).collect())) == [(0, 1), (1, 2), (2, 3)]
    none = classic(tmp_path / "none.nc", {"t": None, "x": 2}, {"v": (["t", "x"], np.zeros((0, 2)), {}), "x": (["x"], np.array([1.0, 2.0]), {})})
    assert netcdf.read_netcdf(spark, none, ["v"]).collect() == []
    scalar = classic(tmp_path / "scalar.nc", {}, {"v": ([], np.array(4.5), {})})
    assert [tuple(r) for r in netcdf.read_netcdf(spark, scalar, ["v"]).collect()] == [(4.5,)]
    (tmp_path / "h.nc").write_bytes(b"\x89HDF\r\n\x1a\n")
    for bad in (str(tmp_path / "h.nc"), one + "," + none):
        with pytest.raises(Exception, match="classic|needed"):
            netcdf.read_netcdf(spark, bad, ["v"]).collect()
