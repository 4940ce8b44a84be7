"""NIfTI-1 images as arrays: a row for each file and time point.

Spark lists the files and reads their headers; what is stored in them is read
by a data source of Spark's, whose tasks each take a range of volumes. Whole
images serve maps over the native space; the features of a mask are gathered
inside the row. Paths are those that pyarrow can open.
"""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.scalar import canonical_digest
from ..functions.storage import file_system
from ..operators.source import ArraySource, picked
from ..operators.spaces import VolumeSpace

#: NIfTI-1 data type codes.
CODES = {2: "uint8", 4: "int16", 8: "int32", 16: "float32", 64: "float64", 256: "int8", 512: "uint16", 768: "uint32", 1024: "int64", 1280: "uint64"}
HEADER_BYTES = 348


@dataclass(frozen=True)
class Header:
    dim: tuple[int, int, int]
    n_times: int
    dtype: str
    affine: tuple[float, ...]
    tr: float
    offset: int
    slope: float
    intercept: float
    order: str


def parse_header(data: bytes) -> Header:
    order = next((o for o in "<>" if struct.unpack(f"{o}i", data[:4])[0] == HEADER_BYTES), None)
    if order is None:
        raise ValueError("no NIfTI-1 header")
    dim = struct.unpack(f"{order}8h", data[40:56])
    code = struct.unpack(f"{order}h", data[70:72])[0]
    pix = struct.unpack(f"{order}8f", data[76:108])
    offset, slope, intercept = struct.unpack(f"{order}3f", data[108:120])
    if code not in CODES:
        raise ValueError(f"data type {code} is not supported")
    qform, sform = struct.unpack(f"{order}2h", data[252:256])
    if sform > 0:
        affine = [*struct.unpack(f"{order}12f", data[280:328]), 0.0, 0.0, 0.0, 1.0]
    elif qform > 0:
        affine = quaternion_affine(struct.unpack(f"{order}3f", data[256:268]), struct.unpack(f"{order}3f", data[268:280]), pix[1:4], pix[0])
    else:
        affine = np.diag([pix[1], pix[2], pix[3], 1.0]).ravel().tolist()
    return Header(tuple(dim[1:4]), max(1, dim[4]) if dim[0] >= 4 else 1, CODES[code], tuple(affine), float(pix[4]), int(offset), slope or 1.0, intercept if slope else 0.0, order)


def quaternion_affine(bcd: Sequence[float], shift: Sequence[float], sizes: Sequence[float], sign: float) -> list[float]:
    """The affine of a rotation given as the last three parts of a unit quaternion, cell sizes, and the third axis' sign (0 counts as 1)."""
    v = np.array(bcd, float)
    w = np.sqrt(max(0.0, 1.0 - v @ v))
    if w == 0.0:
        v = v / np.sqrt(v @ v)
    cross = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    rotation = np.eye(3) + 2 * w * cross + 2 * cross @ cross
    scaled = rotation * np.array([sizes[0], sizes[1], sizes[2] * (-1.0 if sign < 0 else 1.0)])
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = scaled, shift
    return out.ravel().tolist()


def read_volumes(content: bytes) -> tuple[Header, np.ndarray]:
    """Header and values [time, voxel], the first axis of the grid fastest."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    h = parse_header(data)
    n = int(np.prod(h.dim))
    raw = np.frombuffer(data, np.dtype(h.dtype).newbyteorder(h.order), n * h.n_times, h.offset).reshape(h.n_times, n)
    return h, raw.astype(float) * h.slope + h.intercept


def _head(path: str) -> tuple[Header, bool]:
    """A file's header, from its first bytes alone, and whether it is compressed."""
    system, at = file_system(path)
    with system.open_input_file(at) as f:
        data = f.read(HEADER_BYTES)
        packed = data[:2] == b"\x1f\x8b"
        if packed:
            unpack = zlib.decompressobj(31)
            out = unpack.decompress(data, HEADER_BYTES)
            while len(out) < HEADER_BYTES and (more := f.read(4096)):
                out += unpack.decompress(unpack.unconsumed_tail + more, HEADER_BYTES - len(out))
            data = out
    return parse_header(data), packed


def headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, dims, n_times, dtype, affine, tr, size, changed, ...) of each file; no more than the header is read."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, size, changed in zip(b["path"], b["length"], b["changed"], strict=True):
                h, packed = _head(path)
                out.append((path, list(h.dim), h.n_times, h.dtype, list(h.affine), h.tr, size, changed, h.offset, h.slope, h.intercept, h.order, packed))
            yield pd.DataFrame(out, columns=["path", "dims", "n_times", "dtype", "affine", "tr", "size", "changed", "offset", "slope", "intercept", "order", "packed"])

    # without its content column this lists files and reads none
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length", F.unix_micros("modificationTime").alias("changed"))
    return files.mapInPandas(of, "path string, dims array<int>, n_times int, dtype string, affine array<double>, tr double, size long, changed long, offset long, slope double, intercept double, order string, packed boolean")


class VolumeRange(InputPartition):
    """Consecutive volumes of one file."""

    def __init__(self, file: dict, first: int, count: int) -> None:
        self.file, self.first, self.count = file, first, count


class VolumeReader(DataSourceReader):
    """Volumes by ranges; conditions on obs_idx leave out what they exclude before any file is opened."""

    def __init__(self, options: dict) -> None:
        self.files, self.cells = json.loads(options["files"]), int(options["cells"])
        self.per = max(1, int(options.get("range_bytes", 64 << 20)) // max(1, self.cells * 8))
        self.low, self.high, self.among = 1, 1 << 62, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            mine = getattr(f, "attribute", None) == ("obs_idx",)
            if mine and isinstance(f, In):
                self.among = {int(v) for v in f.value} & (self.among or {int(v) for v in f.value})
            elif mine and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif mine and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif mine and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def _wanted(self, file: dict) -> list[tuple[int, int]]:
        """(first volume, count) of stretches asked for, from 0 within the file."""
        a, z = max(self.low, file["start"] + 1), min(self.high, file["start"] + file["n_times"])
        if self.among is None:
            return [(a - file["start"] - 1, z - a + 1)] if a <= z else []
        asked = sorted(i for i in self.among if a <= i <= z)
        cuts = [0, *(k for k in range(1, len(asked)) if asked[k] != asked[k - 1] + 1), len(asked)]
        return [(asked[i] - file["start"] - 1, j - i) for i, j in zip(cuts, cuts[1:], strict=False) if j > i]

    def partitions(self) -> list[VolumeRange]:
        out = []
        for file in self.files:
            wanted = self._wanted(file)
            if wanted and file["packed"]:  # what is compressed is read from its start
                out.append(VolumeRange({**file, "wanted": wanted}, wanted[0][0], wanted[-1][0] + wanted[-1][1] - wanted[0][0]))
                continue
            out += [VolumeRange(file, k, min(self.per, first + n - k)) for first, n in wanted for k in range(first, first + n, self.per)]
        return out or [VolumeRange({}, 0, 0)]

    def read(self, partition: VolumeRange) -> Iterator[pa.RecordBatch]:
        f, n = partition.file, self.cells
        if not partition.count:
            return
        kind = np.dtype(f["dtype"]).newbyteorder(f["order"])
        size = n * kind.itemsize
        system, path = file_system(f["path"])
        known = system.get_file_info(path)
        if known.size != f["size"] or known.mtime_ns // 1_000_000 != f["changed"] // 1_000:
            raise ValueError(f"{f['path']} changed")
        with (system.open_input_stream(path, compression="gzip") if f["packed"] else system.open_input_file(path)) as source:
            if f["packed"]:
                done = f["offset"] + partition.first * size
                for a in range(0, done, 1 << 22):
                    source.read(min(1 << 22, done - a))
            else:
                done = 0
                source.seek(f["offset"] + partition.first * size)
            wanted = {k for first, count in f.get("wanted", [[partition.first, partition.count]]) for k in range(first, first + count)}
            for k in range(partition.first, partition.first + partition.count):
                values = np.frombuffer(source.read(size), kind, n).astype(float) * f["slope"] + f["intercept"]
                done += size
                if k in wanted:
                    yield pa.RecordBatch.from_arrays([pa.array([f["start"] + k + 1], pa.int64()), pa.array([done], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(values))], names=["obs_idx", "read_bytes", "values"])
                    done = 0


class VolumeData(DataSource):
    """Spark's reader of volumes, format "gridloom_nifti"."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_nifti"

    def schema(self) -> str:
        return "obs_idx long, read_bytes long, values array<double>"

    def reader(self, schema) -> VolumeReader:  # noqa: ANN001
        return VolumeReader(self.options)


def volumes(spark: SparkSession, files: Sequence[dict], cells: int, range_bytes: int = 64 << 20) -> DataFrame:
    """(obs_idx, read_bytes, values) of whole volumes. Registers the format, and lets Spark hand it conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeData)
    return spark.read.format("gridloom_nifti").option("files", json.dumps(files)).option("cells", cells).option("range_bytes", range_bytes).load()


def nifti_source(spark: SparkSession, paths: Sequence[str], mask: Sequence[int] | None = None, range_bytes: int = 64 << 20) -> tuple[ArraySource, VolumeSpace]:
    """Files one after the other in the order given; all must agree in grid, affine (to 1e-7) and element type.

    A task reads a range of volumes of about ``range_bytes`` decoded, so that a
    long series is many tasks; a compressed file is one, as it can't be entered
    in the middle. Files that have another size or time than when the source
    was made are refused.
    """
    found = {r["path"]: r for r in headers(spark, paths).collect()}
    by_end = lambda p: next(r for k, r in found.items() if k.split(":", 1)[-1].lstrip("/") == p.split(":", 1)[-1].lstrip("/"))
    rows = [by_end(p) for p in paths]
    first = rows[0]
    if any(r["dims"] != first["dims"] or r["dtype"] != first["dtype"] or np.abs(np.array(r["affine"]) - np.array(first["affine"])).max() > 1e-7 for r in rows):
        raise ValueError("files differ in grid, affine or element type")
    cells = int(np.prod(first["dims"]))
    support = list(mask or range(1, cells + 1))
    files, n = [], 0
    for r in rows:
        files.append({**{c: r[c] for c in ("path", "n_times", "dtype", "size", "changed", "offset", "slope", "intercept", "order", "packed")}, "start": n})
        n += r["n_times"]
    images = volumes(spark, files, cells, range_bytes)
    kept = images.select("obs_idx", "values")
    pieces = (kept if mask is None else picked(kept, support)).select("obs_idx", F.lit(0).alias("chunk"), "values")
    space = VolumeSpace(tuple(first["dims"]), tuple(first["affine"]), None if mask is None else tuple(support))
    source = ArraySource(pieces, (n, len(support)), first["dtype"], max(1, len(support)), frozenset({"block_slice", "serializable", "native_read"}), canonical_digest([[r["path"], r["size"], r["changed"]] for r in rows]), native=kept, filters=True)
    return source, space


def write_nifti(path: str, values: np.ndarray, dim: Sequence[int], tr: float = 2.0) -> None:
    """Write [time, voxel] as float32; for fixtures."""
    h = bytearray(352)
    h[0:4] = struct.pack("<i", HEADER_BYTES)
    h[40:56] = struct.pack("<8h", 4, *dim, len(values), 1, 1, 1)
    h[70:74] = struct.pack("<2h", 16, 32)
    h[76:108] = struct.pack("<8f", 1, 1, 1, 1, tr, 0, 0, 0)
    h[108:120] = struct.pack("<3f", 352, 1, 0)
    h[344:348] = b"n+1\0"
    with open(path, "wb") as f:
        f.write(bytes(h) + np.asarray(values, "<f4").tobytes())
