"""Array files as data sources of Spark: classic NetCDF and NumPy files, read by ranges of their first dimension.

A partition is a range of one file; its task seeks to the range and reads no more than that, so a file may be larger
than a task's memory. Only headers are read where partitions are planned.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition, and values of a batch, unless the reader is told otherwise.
PART, BATCH = 64 << 20, 1 << 18
#: Fixed values of the classic format: its types by number, and the marks of its lists.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
STREAMED = 0xFFFFFFFF


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)


def files_of(path: str, suffix: str) -> list[str]:
    """The file at path, or those with the suffix beneath it, in order; none is an error."""
    from pyarrow import fs

    system, at = filesystem(path)
    info = system.get_file_info(at)
    found = [at] if info.type == fs.FileType.File else sorted(x.path for x in system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File and x.path.endswith(suffix))
    if not found:
        raise FileNotFoundError(f"no {suffix} under {path}")
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    return [scheme + x for x in found]


@dataclass(frozen=True)
class Block:
    """Where an array lies: the bytes of a row of its first dimension follow each other, rows are `stride` bytes apart."""

    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: str
    begin: int
    stride: int

    def rows(self, f, start: int, stop: int) -> np.ndarray:
        """Rows start .. stop - 1 of the first dimension."""
        kind, inner = np.dtype(self.kind), self.shape[1:]
        size = kind.itemsize * prod(inner)
        f.seek(self.begin + start * self.stride)
        data = f.read(max(0, stop - start - 1) * self.stride + size) if stop > start else b""
        if size == self.stride or stop - start == 1:
            return np.frombuffer(data, kind).reshape(stop - start, *inner)
        return np.stack([np.frombuffer(data, kind, prod(inner), i * self.stride).reshape(inner) for i in range(stop - start)]) if stop > start else np.zeros((0, *inner), kind)


class Header:
    """The header of a classic NetCDF file (versions 1, 2 and 5), read from the front."""

    def __init__(self, f):
        self.f, self.bytes, self.at = f, b"", 0
        magic = self.take(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self.version = magic[3]
        records = self.count()
        size = f.size()
        self.dims = [(self.name(), self.count()) for _ in range(self.listed(DIMENSION))]
        self.attributes = self.noted()
        raw = []
        for _ in range(self.listed(VARIABLE)):
            name, ids = self.name(), [self.count() for _ in range(self.count())]
            self.noted()
            kind, vsize, begin = TYPES[self.number(">i")], self.count(), self.number(">i" if self.version == 1 else ">q")
            raw.append((name, ids, kind, vsize, begin))
        # records of all variables along the open dimension lie one after the other, each padded but for a lone one
        own = lambda ids, kind: np.dtype(kind).itemsize * prod(self.dims[i][1] for i in ids)
        recorded = [own(ids[1:], kind) for _, ids, kind, _, _ in raw if ids and self.dims[ids[0]][1] == 0]
        stride = recorded[0] if len(recorded) == 1 else sum(-(-x // 4) * 4 for x in recorded)
        if records == (STREAMED if self.version < 5 else (1 << 64) - 1):
            first = min((b for _, ids, _, _, b in raw if ids and self.dims[ids[0]][1] == 0), default=size)
            records = (size - first) // max(1, stride)
        self.variables: dict[str, Block] = {}
        for name, ids, kind, _, begin in raw:
            open_ = bool(ids) and self.dims[ids[0]][1] == 0
            shape = tuple(records if i == 0 and open_ else self.dims[j][1] for i, j in enumerate(ids))
            self.variables[name] = Block(name, tuple(self.dims[j][0] for j in ids), shape, kind, begin, stride if open_ else own(ids[1:], kind))

    def take(self, n: int) -> bytes:
        while self.at + n > len(self.bytes):
            more = self.f.read(1 << 16)
            if not more:
                raise ValueError("the file ends within its header")
            self.bytes += more
        self.at += n
        return self.bytes[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]

    def count(self) -> int:
        return self.number(">Q" if self.version == 5 else ">I")

    def listed(self, mark: int) -> int:
        tag, n = self.number(">i"), self.count()
        if tag not in (0, mark):
            raise ValueError(f"a list of kind {tag} instead of {mark}")
        return n

    def padded(self, n: int) -> bytes:
        return self.take(-(-n // 4) * 4)[:n]

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def noted(self) -> dict[str, object]:
        out = {}
        for _ in range(self.listed(ATTRIBUTE)):
            name, kind, n = self.name(), TYPES[self.number(">i")], self.count()
            data = self.padded(n * np.dtype(kind).itemsize)
            out[name] = data.decode("latin-1") if kind == "S1" else np.frombuffer(data, kind).tolist()
        return out


def netcdf_block(path: str, variable: str) -> Block:
    fs, at = filesystem(path)
    with fs.open_input_file(at) as f:
        found = Header(f).variables
    if variable not in found:
        raise KeyError(f"{path} has no variable {variable!r}; it has {', '.join(found)}")
    return found[variable]


def npy_block(path: str) -> Block:
    fs, at = filesystem(path)
    with fs.open_input_file(at) as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        begin = f.tell()
    if fortran and len(shape) > 1:
        raise ValueError(f"{path} is stored column by column")
    shape = shape or (1,)
    return Block(path, tuple(f"i{i}" for i in range(len(shape))), shape, kind.str, begin, kind.itemsize * prod(shape[1:]))


@dataclass
class Range(InputPartition):
    path: str
    block: Block
    start: int
    stop: int


class Ranges(DataSourceReader):
    """Rows of the ranges of some files; a scalar is one row."""

    def __init__(self, blocks: list[tuple[str, Block]], part: int, rows):
        self.blocks, self.part, self.rows = blocks, part, rows

    def partitions(self) -> list[Range]:
        out = []
        for path, b in self.blocks:
            n, step = b.shape[0] if b.shape else 1, max(1, self.part // max(1, b.stride))
            out += [Range(path, b, a, min(n, a + step)) for a in range(0, n, step)]
        return out or [Range("", Block("", (), (0,), ">f8", 0, 8), 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        b = partition.block
        if partition.start >= partition.stop:
            return
        fs, at = filesystem(partition.path)
        step = max(1, BATCH // max(1, prod(b.shape[1:])))
        with fs.open_input_file(at) as f:
            for a in range(partition.start, partition.stop, step):
                yield self.rows(partition.path, b, a, b.rows(f, a, min(a + step, partition.stop)))


def base_name(path: str) -> str:
    return path.rpartition("/")[2]


def cells(path: str, b: Block, start: int, x: np.ndarray) -> pa.RecordBatch:
    """A row a value: the file's name, a column a dimension, the value."""
    n = x.size
    places = [np.arange(start, start + len(x)), *(np.arange(k) for k in x.shape[1:])] if b.dims else []
    columns = [np.broadcast_to(p.reshape([-1 if i == j else 1 for j in range(x.ndim)]), x.shape).ravel().astype(np.int64) for i, p in enumerate(places)]
    return pa.RecordBatch.from_arrays([pa.array([base_name(path)] * n), *map(pa.array, columns), pa.array(x.ravel().astype(np.float64))], ["file_id", *b.dims, "value"])


def samples(path: str, b: Block, start: int, x: np.ndarray) -> pa.RecordBatch:
    """A row a sample, a signal a column of a matrix, named by the file without its suffix."""
    name, flat = base_name(path).removesuffix(".npy"), x.reshape(len(x), -1)
    n = np.repeat(np.arange(start, start + len(x)), flat.shape[1])
    names = [name] if len(b.shape) == 1 else [f"{name}/{j}" for j in range(flat.shape[1])]
    return pa.RecordBatch.from_arrays([pa.array(names * len(x)), pa.array(n), pa.array(flat.real.ravel().astype(np.float64)), pa.array(np.imag(flat).ravel().astype(np.float64))], ["signal_id", "n", "re", "im"])


class NetcdfSource(DataSource):
    """Options: path (a file or a folder), variable, suffix (.cdf), bytes (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "classic_netcdf"

    def blocks(self) -> list[tuple[str, Block]]:
        return [(f, netcdf_block(f, self.options["variable"])) for f in files_of(self.options["path"], self.options.get("suffix", ".cdf"))]

    def schema(self) -> T.StructType:
        dims = self.blocks()[0][1].dims
        return T.StructType([T.StructField("file_id", T.StringType()), *[T.StructField(d, T.LongType()) for d in dims], T.StructField("value", T.DoubleType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Ranges(self.blocks(), int(self.options.get("bytes", PART)), cells)


class NpySource(DataSource):
    """Options: path (a file or a folder), bytes (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "npy_ranges"

    def schema(self) -> str:
        return "signal_id string, n long, re double, im double"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Ranges([(f, npy_block(f)) for f in files_of(self.options["path"], ".npy")], int(self.options.get("bytes", PART)), samples)


def netcdf(spark: SparkSession, path: str, variable: str, **options: str) -> DataFrame:
    """(file_id, a column a dimension, value) of a variable of classic NetCDF files."""
    spark.dataSource.register(NetcdfSource)
    return spark.read.format("classic_netcdf").options(variable=variable, **options).load(path)


def npy_ranges(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(signal_id, n, re, im) of array files, by ranges of their samples."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy_ranges").options(**options).load(path)


def acquisition(spark: SparkSession, path: str, txpol: int = 0, **options: str) -> DataFrame:
    """(file_id, sweep, range_bin, re, im) of raw recordings: the like-polarised I and Q channels of one transmitted polarisation.

    adc_data has the dimensions sweep, polarisation, range and channel; two scalars say which channels are I and Q.
    """
    x = netcdf(spark, path, "adc_data", **options)
    _, sweep, pol, bin_, channel, _ = x.columns
    pick = {}
    for name, variable in (("re", "adc_like_I"), ("im", "adc_like_Q")):
        pick[name] = {r["file_id"]: int(r["value"]) for r in netcdf(spark, path, variable, **options).collect()}  # a row a file
    which = {n: F.coalesce(*[F.when(F.col("file_id") == f, F.lit(c)) for f, c in sorted(p.items())]) for n, p in pick.items()}
    x = x.where((F.col(pol) == txpol) & ((F.col(channel) == which["re"]) | (F.col(channel) == which["im"])))
    part = lambda n: F.max(F.when(F.col(channel) == which[n], F.col("value"))).alias(n)
    return x.groupBy("file_id", F.col(sweep).alias("sweep"), F.col(bin_).cast("int").alias("range_bin")).agg(part("re"), part("im"))


def ranges_of(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(file_id, range_bin, range_m, prf_hz) of raw recordings."""
    r = netcdf(spark, path, "range", **options)
    prf = netcdf(spark, path, "PRF", **options).select("file_id", F.col("value").alias("prf_hz"))
    return r.select("file_id", F.col(r.columns[1]).cast("int").alias("range_bin"), F.col("value").alias("range_m")).join(prf, "file_id")
