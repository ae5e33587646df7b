"""Array files that the tests write come back, a range a partition."""

import struct

import numpy as np
import pytest

from tonefield.sources import arrays

CODE = {np.dtype(v): k for k, v in arrays.TYPES.items() if v != "S1"}


def padded(b):
    return b + b"\0" * (-len(b) % 4)


def written(path, dims, variables, version=1, records=0):
    """A classic file: dims {name: length, 0 the open one}, variables {name: (dims, array)}; written by the format's own description."""
    n = lambda x: struct.pack(">Q" if version == 5 else ">I", x)
    name = lambda s: n(len(s)) + padded(s.encode())
    note = struct.pack(">i", 12) + n(1) + name("title") + struct.pack(">i", 2) + n(5) + padded(b"hello")
    order = list(dims)
    opened = [v for v, (d, _) in variables.items() if d and dims[d[0]] == 0]
    rowsize = lambda v: variables[v][1][0].nbytes if len(opened) == 1 else len(padded(variables[v][1][:1].tobytes()))

    def header(begins):
        out = b"CDF" + bytes([version]) + n(records) + struct.pack(">i", 10) + n(len(dims)) + b"".join(name(d) + n(k) for d, k in dims.items()) + note
        out += struct.pack(">i", 11) + n(len(variables))
        for v, (d, x) in variables.items():
            out += name(v) + n(len(d)) + b"".join(n(order.index(k)) for k in d) + struct.pack(">i", 0) + n(0) + struct.pack(">i", CODE[x.dtype]) + n(len(padded(x.tobytes()))) + struct.pack(">i" if version == 1 else ">q", begins.get(v, 0))
        return out

    at, begins = len(header({})), {}
    for v in [*(v for v in variables if v not in opened), *opened]:
        begins[v] = at
        at += rowsize(v) if v in opened else len(padded(variables[v][1].tobytes()))
    data = header(begins) + b"".join(padded(x.tobytes()) for v, (_, x) in variables.items() if v not in opened)
    for i in range(records):
        for v in opened:
            row = variables[v][1][i : i + 1].tobytes()
            data += row if len(opened) == 1 else padded(row)
    path.write_bytes(data)


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("kind", [">i1", ">i2", ">f8"])
def test_recordings_come_back(spark, tmp_path, version, kind):
    rng = np.random.default_rng(version)
    for i, sweeps in enumerate((50, 7)):
        x = rng.integers(-100, 100, (sweeps, 2, 3, 4)).astype(kind)
        scalar = lambda v: ((), np.array(v, ">i4"))
        written(tmp_path / f"{i}.cdf", {"nsweep": sweeps, "ntxpol": 2, "nrange": 3, "nadc": 4}, {"adc_like_I": scalar(2 - i), "adc_like_Q": scalar(3), "PRF": ((), np.array(1000.0, ">f4")), "range": (("nrange",), np.array([2600, 2615, 2630], ">f4")), "adc_data": (("nsweep", "ntxpol", "nrange", "nadc"), x)}, version)
        np.save(tmp_path / f"x{i}.npy", x.astype(float))
    part = 24 * 8 * np.dtype(kind).itemsize
    cube = arrays.netcdf(spark, str(tmp_path), "adc_data", bytes=str(part))
    assert cube.columns == ["file_id", "nsweep", "ntxpol", "nrange", "nadc", "value"] and cube.rdd.getNumPartitions() == 7 + 1
    got = cube.toPandas()
    for i, sweeps in enumerate((50, 7)):
        mine = got[got["file_id"] == f"{i}.cdf"].sort_values(["nsweep", "ntxpol", "nrange", "nadc"])
        want = np.load(tmp_path / f"x{i}.npy")
        assert (mine["value"].to_numpy().reshape(want.shape) == want).all()
        pulses = arrays.acquisition(spark, str(tmp_path)).where(f"file_id = '{i}.cdf'").orderBy("sweep", "range_bin").toPandas()
        assert (pulses["re"].to_numpy().reshape(sweeps, 3) == want[:, 0, :, 2 - i]).all() and (pulses["im"].to_numpy().reshape(sweeps, 3) == want[:, 0, :, 3]).all()
    known = arrays.ranges_of(spark, str(tmp_path)).where("file_id = '0.cdf'").orderBy("range_bin").collect()
    assert [(r["range_bin"], r["range_m"], r["prf_hz"]) for r in known] == [(0, 2600, 1000), (1, 2615, 1000), (2, 2630, 1000)]


@pytest.mark.parametrize("more", [False, True])
def test_records_of_an_open_dimension(spark, tmp_path, more):
    x, y = np.arange(30, dtype=">i2").reshape(10, 3), (np.arange(10) / 2).astype(">f8")
    variables = {"a": (("time", "n"), x)} | ({"b": (("time",), y)} if more else {})
    written(tmp_path / "r.cdf", {"time": 0, "n": 3}, variables, records=10)
    out = arrays.netcdf(spark, str(tmp_path / "r.cdf"), "a", bytes="40").orderBy("time", "n").toPandas()
    assert (out["value"].to_numpy().reshape(10, 3) == x).all() and out["time"].max() == 9
    if more:
        assert arrays.netcdf(spark, str(tmp_path / "r.cdf"), "b").orderBy("time").toPandas()["value"].tolist() == y.tolist()


def test_array_files_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=1000) + 1j * rng.normal(size=1000), rng.normal(size=(40, 3))
    np.save(tmp_path / "hi.npy", x)
    np.save(tmp_path / "grid.npy", y.astype("f4"))
    df = arrays.npy_ranges(spark, str(tmp_path), bytes="1600")
    assert df.rdd.getNumPartitions() == 10 + 1
    out = df.toPandas().sort_values(["signal_id", "n"])
    hi = out[out["signal_id"] == "hi"]
    assert (hi["re"].to_numpy() + 1j * hi["im"].to_numpy() == x).all()
    assert (out[out["signal_id"] == "grid/2"]["re"].to_numpy() == y[:, 2].astype("f4")).all()


def test_what_is_no_such_file(spark, tmp_path):
    (tmp_path / "bad.cdf").write_bytes(b"HDF and more")
    with pytest.raises(Exception, match="classic NetCDF"):
        arrays.netcdf(spark, str(tmp_path), "x").count()
    with pytest.raises(Exception, match="no .npy"):
        arrays.npy_ranges(spark, str(tmp_path)).count()
    written(tmp_path / "bad.cdf", {"n": 2}, {"x": (("n",), np.arange(2, dtype=">i4"))})
    with pytest.raises(Exception, match="no variable"):
        arrays.netcdf(spark, str(tmp_path), "y").count()
    assert arrays.netcdf(spark, str(tmp_path), "x").count() == 2
