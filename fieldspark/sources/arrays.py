"""Large .npy arrays as a partitioned Spark source: byte ranges are planned from headers, and only asked ranges are read (S16).

`spark.read.format("npy")` lists the files and reads their headers on the driver; each partition is a run
of the slowest axes of one file, found by offset.  Ranges of places come as options or from filters, for which
`register` allows pushdown to Python sources.  A schema with fewer columns makes fewer.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

#: Column of each axis of an array with three axes, or four: components last.
AXES = ("z", "y", "x", "c")
#: Bytes of a partition, and of one read.
SLAB_BYTES, READ_BYTES = 128 << 20, 4 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The .npy files of a path, folder or pattern in the last part, in order of name."""
    store, at = _opened(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    head, _, last = at.rpartition("/")
    if any(c in last for c in "*?["):
        found = [i.path for i in store.get_file_info(fs.FileSelector(head or "/")) if i.is_file and fnmatch.fnmatch(i.base_name, last)]
    elif store.get_file_info(at).type == fs.FileType.Directory:
        found = [i.path for i in store.get_file_info(fs.FileSelector(at)) if i.is_file and i.base_name.endswith(".npy")]
    else:
        found = [at]
    if not found:
        raise FileNotFoundError(f"no .npy file at {path}")
    return [prefix + p for p in sorted(found)]


@dataclass(frozen=True)
class Header:
    """Where the values of a file begin and how they lie: axes from the slowest to the fastest, and their lengths."""

    path: str
    kind: str
    offset: int
    axes: tuple[str, ...]
    lengths: tuple[int, ...]


def header(path: str) -> Header:
    store, at = _opened(path)
    with store.open_input_file(at) as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, kind = read(f)
        offset, size = f.tell(), f.size()
    if len(shape) not in (3, 4):
        raise ValueError(f"{path} has {len(shape)} axes, not 3 or 4")
    if kind.hasobject or kind.kind not in "iufb":
        raise ValueError(f"{path} has values of the kind {kind}")
    if size < offset + kind.itemsize * int(np.prod(shape, dtype=object)):
        raise ValueError(f"{path} ends before its last value")
    axes = AXES[: len(shape)]
    turn = -1 if fortran else 1
    return Header(path, kind.str, offset, axes[::turn], tuple(int(n) for n in shape[::turn]))


@dataclass
class Slab(ds.InputPartition):
    """Ranges of a file by axis, slowest first; all but the first two are read whole and cut to their range."""

    of: Header
    ranges: tuple[tuple[int, int], ...]


def slabs(of: Header, wanted: dict[str, tuple[int, int]], slab_bytes: int = SLAB_BYTES) -> list[Slab]:
    """Partitions of a file of about slab_bytes each: runs along the slowest axis, and along the next where one step is larger."""
    ranges = [(max(0, wanted.get(a, (0, n))[0]), min(n, wanted.get(a, (0, n))[1])) for a, n in zip(of.axes, of.lengths, strict=True)]
    if any(lo >= hi for lo, hi in ranges):
        return []
    row = int(np.prod(of.lengths[2:], dtype=object)) * np.dtype(of.kind).itemsize
    (a0, a1), (b0, b1) = ranges[:2]
    along_b = max(1, min(b1 - b0, slab_bytes // max(row, 1)))
    along_a = max(1, slab_bytes // max(row * (b1 - b0), 1))
    return [Slab(of, ((a, min(a + along_a, a1)), (b, min(b + along_b, b1)), *ranges[2:])) for a in range(a0, a1, along_a) for b in range(b0, b1, along_b)]


def _batches(slab: Slab, names: list[str]) -> Iterator[pa.RecordBatch]:
    of = slab.of
    kind, inner = np.dtype(of.kind), of.lengths[2:]
    row = int(np.prod(inner)) * kind.itemsize
    (a0, a1), (b0, b1) = slab.ranges[:2]
    cut = tuple(slice(lo, hi) for lo, hi in slab.ranges[2:])
    step = max(1, READ_BYTES // row)
    store, at = _opened(of.path)
    with store.open_input_file(at) as f:
        for a in range(a0, a1):
            for b in range(b0, b1, step):
                count = min(step, b1 - b)
                f.seek(of.offset + (a * of.lengths[1] + b) * row)
                values = np.frombuffer(f.read(count * row), kind).reshape(count, *inner)[(slice(None), *cut)]
                starts = [a, b, *(c.start for c in cut)]
                places = np.indices((1, *values.shape), np.int32)
                columns = {name: pa.array((k + lo).ravel()) for name, k, lo in zip(of.axes, places, starts, strict=True) if name in names}
                n = values.size
                if "v" in names:
                    columns["v"] = pa.array(np.ascontiguousarray(values).ravel().astype(np.float64))
                if "file" in names:
                    columns["file"] = pa.array([of.path], pa.string()).take(pa.array(np.zeros(n, np.int32)))
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)


class NpyReader(ds.DataSourceReader):
    def __init__(self, names: list[str], options: dict[str, str]):
        self.names, self.path, self.slab_bytes = names, options["path"], int(options.get("slab_bytes", SLAB_BYTES))
        self.wanted = {a: (int(options.get(f"{a}_from", 0)), int(options.get(f"{a}_to", 1 << 62))) for a in AXES if f"{a}_from" in options or f"{a}_to" in options}

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Takes comparisons of places with whole numbers; gives back all others."""
        for f in filters:
            axis = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            bound = None
            if axis in AXES and isinstance(value := getattr(f, "value", None), int):
                bound = {ds.EqualTo: (value, value + 1), ds.GreaterThan: (value + 1, 1 << 62), ds.GreaterThanOrEqual: (value, 1 << 62), ds.LessThan: (0, value), ds.LessThanOrEqual: (0, value + 1)}.get(type(f))
            if bound:
                lo, hi = self.wanted.get(axis, (0, 1 << 62))
                self.wanted[axis] = (max(lo, bound[0]), min(hi, bound[1]))
            else:
                yield f

    def partitions(self) -> Sequence[Slab]:
        found = [s for p in listed(self.path) for s in slabs(header(p), self.wanted, self.slab_bytes)]
        nothing = Header("", "<f8", 0, AXES[:3], (0, 0, 0))
        return found or [Slab(nothing, ((0, 0),) * 3)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.names) if partition.of.path else iter(())


class NpySource(ds.DataSource):
    """file, z, y, x, v, and c for arrays with four axes."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        axes = sorted(header(listed(self.options["path"])[0]).axes, key=AXES.index)
        return f"file string, {', '.join(f'{a} int' for a in axes)}, v double"

    def reader(self, schema) -> NpyReader:
        return NpyReader(schema.names, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known; filters are pushed to Python sources of the session from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpySource)


def read_array(spark: SparkSession, path: str, columns: str | None = None, slab_bytes: int = SLAB_BYTES, **ranges: tuple[int, int]) -> DataFrame:
    """Points of .npy files of any size; ranges: z=(from, to) and so on, the end left out.  Only these bytes are read.

    columns: a schema with some of the columns, the only ones made.  Files are opened with pyarrow: local
    paths and the stores it knows by their URIs; all executors must reach them.
    """
    register(spark)
    reader = spark.read.format("npy").option("slab_bytes", slab_bytes)
    for axis, (lo, hi) in ranges.items():
        reader = reader.option(f"{axis}_from", lo).option(f"{axis}_to", hi)
    return (reader.schema(columns) if columns else reader).load(path)
