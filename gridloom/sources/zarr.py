"""Two-dimensional Zarr arrays (format 2 and 3) as lazy arrays.

Metadata is plain JSON. Only the chunks of the grid that hold something asked
for are read, a task each; of a chunk that is not compressed, only the
consecutive rows asked for. Compression by zlib, gzip or zstd needs no library
beyond those at hand, other codecs are refused. Either axis may come first.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import canonical_digest, dtype_bytes
from ..functions.storage import file_system
from ..operators.source import ArraySource, Counts

AXES = ("observation", "feature")


class StaleArray(ValueError):
    """An array whose metadata changed after it was described."""


@dataclass(frozen=True)
class Metadata:
    shape: tuple[int, int]
    chunks: tuple[int, int]
    dtype: str
    order: str  # of bytes: < or >
    codec: str | None
    name: str  # of a chunk's file, of its two numbers
    fill: float = field(compare=False)  # NaN differs from itself
    column_major: bool = False


def _codec(x: str | None) -> str | None:
    if x not in (None, "zlib", "gzip", "zstd"):
        raise ValueError(f"codec {x} is not supported")
    return x


def parse_metadata(text: str) -> Metadata:
    """Of .zarray (format 2) or zarr.json (format 3)."""
    m = json.loads(text)
    fill = m.get("fill_value")
    fill = float("nan") if fill in (None, "NaN") else float(fill)
    if m["zarr_format"] == 2:
        if m.get("filters"):
            raise ValueError("filters are not supported")
        kind = np.dtype(m["dtype"])
        sep = m.get("dimension_separator", ".")
        out = Metadata(tuple(m["shape"]), tuple(m["chunks"]), kind.name, ">" if m["dtype"][0] == ">" else "<", _codec(m["compressor"]["id"] if m.get("compressor") else None), f"{{}}{sep}{{}}", fill, m.get("order") == "F")
    else:
        codecs = {c["name"]: c.get("configuration", {}) for c in m["codecs"]}
        packed = [c for c in codecs if c not in ("bytes", "crc32c")]
        if m["chunk_grid"]["name"] != "regular" or len(packed) > 1 or "crc32c" in codecs:
            raise ValueError("only regular grids with at most one compression are supported")
        key = m.get("chunk_key_encoding", {"name": "default"})
        sep = key.get("configuration", {}).get("separator", "/" if key["name"] == "default" else ".")
        out = Metadata(tuple(m["shape"]), tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), m["data_type"], ">" if codecs.get("bytes", {}).get("endian") == "big" else "<", _codec(packed[0] if packed else None), (f"c{sep}" if key["name"] == "default" else "") + f"{{}}{sep}{{}}", fill)
    if len(out.shape) != 2 or len(out.chunks) != 2 or min(out.shape) < 0 or min(out.chunks) < 1:
        raise ValueError("an array has two dimensions and positive chunks")
    dtype_bytes(out.dtype)
    return out


def read_metadata(uri: str) -> Metadata:
    system, path = file_system(uri)
    for name in ("zarr.json", ".zarray"):
        if system.get_file_info(f"{path}/{name}").is_file:
            with system.open_input_stream(f"{path}/{name}") as f:
                return parse_metadata(f.read().decode())
    raise FileNotFoundError(f"no Zarr array at {uri}")


def consecutive_runs(index: Sequence[int]) -> list[tuple[int, int]]:
    """(first, last) of each stretch of consecutive numbers, repeats left out."""
    out: list[tuple[int, int]] = []
    for i in sorted(set(index)):
        if out and i == out[-1][1] + 1:
            out[-1] = (out[-1][0], i)
        else:
            out.append((i, i))
    return out


def _unpacked(data: bytes, codec: str | None) -> bytes:
    if codec == "zstd":
        return pa.input_stream(pa.BufferReader(data), compression="zstd").read()
    return data if codec is None else zlib.decompress(data, 47)


def _chunk(uri: str, m: Metadata, at: tuple[int, int], rows: list[tuple[int, int]] | None) -> tuple[np.ndarray, int]:
    """A chunk's values, whole or its ``rows`` (first, last from 0 along the first axis) one below the other, and the bytes read; an absent chunk is the fill value."""
    kind = np.dtype(m.dtype).newbyteorder(m.order)
    system, path = file_system(uri)
    path = f"{path}/{m.name.format(*at)}"
    n = sum(z - a + 1 for a, z in rows) if rows else m.chunks[0]
    if not system.get_file_info(path).is_file:
        return np.full((n, m.chunks[1]), m.fill), 0
    with system.open_input_file(path) as f:
        if rows and m.codec is None and not m.column_major:
            size, parts = m.chunks[1] * kind.itemsize, []
            for a, z in rows:
                f.seek(a * size)
                parts.append(f.read((z - a + 1) * size))
            return np.frombuffer(b"".join(parts), kind).reshape(n, m.chunks[1]).astype(float), n * size
        data = f.read()
    x = np.frombuffer(_unpacked(data, m.codec), kind).reshape(m.chunks, order="F" if m.column_major else "C").astype(float)
    return (x if not rows else np.concatenate([x[a : z + 1] for a, z in rows])), len(data)


@dataclass(frozen=True)
class ZarrSource(ArraySource):
    uri: str = field(kw_only=True)
    metadata: Metadata = field(kw_only=True)
    axes: tuple[str, str] = field(kw_only=True, default=AXES)
    rows: tuple[tuple[int, int], ...] | None = field(kw_only=True, default=None)  # runs of observations asked for
    counts: Counts | None = field(kw_only=True, default=None, compare=False)

    def _grid(self) -> tuple[int, int]:
        """Rows and features of a chunk."""
        return self.metadata.chunks if self.axes == AXES else self.metadata.chunks[::-1]

    def plan(self, spark: SparkSession, features: Sequence[int] | None = None) -> DataFrame:
        """(r, c, runs): chunks of the grid that hold something asked for, and which of their rows, from 0."""
        (n, m), (a, b) = self.shape, self._grid()
        columns = range(-(-m // b)) if features is None else sorted({(f - 1) // b for f in features})
        if self.rows is None:
            r = spark.range(-(-n // a)).select(F.col("id").cast("int").alias("r"), F.lit(None).cast("array<struct<a:int,z:int>>").alias("runs"))
        else:
            cut = [(k, max(x, k * a + 1) - k * a - 1, min(y, k * a + a) - k * a - 1) for x, y in self.rows for k in range((x - 1) // a, (y - 1) // a + 1)]
            runs = spark.createDataFrame(cut, "r int, a int, z int")
            r = runs.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("runs"))
        every = F.sequence(F.lit(0), F.lit(len(columns) - 1)) if isinstance(columns, range) else F.array(*map(F.lit, columns))
        return r.withColumn("c", F.explode(every.cast("array<int>")))

    def _pieces(self, features: Sequence[int] | None = None) -> DataFrame:
        uri, m, first, (n, v), (a, b), shown = self.uri, self.metadata, self.axes == AXES, self.shape, self._grid(), self.counts
        tell = None if shown is None else (shown._rows, shown._stored)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh = False
            for batch in batches:
                for r, c, runs in zip(*(batch.column(x).to_pylist() for x in ("r", "c", "runs")), strict=True):
                    if not fresh and read_metadata(uri) != m:
                        raise StaleArray(f"{uri} changed after it was described")
                    fresh = True
                    asked = None if runs is None else [(x["a"], x["z"]) for x in runs]
                    at = np.arange(a) if asked is None else np.concatenate([np.arange(x, z + 1) for x, z in asked])
                    if first:
                        x, size = _chunk(uri, m, (r, c), asked)
                    else:
                        x, size = _chunk(uri, m, (c, r), None)
                        x = x.T[at]
                    at = at + r * a + 1
                    x, at = x[at <= n, : min(b, v - c * b)], at[at <= n]
                    if tell is not None:
                        tell[0].add(len(at))
                        tell[1].add(size)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), c, np.int32)), lists], names=["obs_idx", "chunk", "values"])

        spark = SparkSession.active()
        plan = self.plan(spark, features)
        # as many tasks as chunks, up to the session's number
        return plan.repartition("r", "c").mapInArrow(read, "obs_idx long, chunk int, values array<double>")

    def holding(self, rows: Sequence[int]) -> ZarrSource:
        out = replace(self, rows=tuple(consecutive_runs(rows)))
        return replace(out, pieces=out._pieces())

    def long(self, features: Sequence[int] | None = None, carry: Sequence[str] = ()) -> DataFrame:
        """Chunks without a feature asked for are not read, unless columns are carried."""
        if features is not None and features and not carry:
            return ArraySource.long(replace(self, pieces=self._pieces(features)), features)
        return ArraySource.long(self, features, carry)

    def counting(self) -> tuple[ZarrSource, Counts]:
        """The same array with counts of rows and stored bytes read."""
        counts = Counts(SparkSession.active(), self.dtype)
        out = replace(self, counts=counts)
        return replace(out, pieces=out._pieces()), counts


def zarr_source(spark: SparkSession, uri: str, array_path: str = "/", axes: tuple[str, str] = AXES, shape: tuple[int, int] | None = None, dtype: str | None = None, chunks: tuple[int, int] | None = None) -> ZarrSource:
    """An array described by its metadata; ``shape``, ``dtype`` and ``chunks``, as observations by features, may be told together and are checked when it is read."""
    if not uri or not array_path.startswith("/") or sorted(axes) != sorted(AXES):
        raise ValueError("an array needs a place, a path from / and both axes")
    told = [x is not None for x in (shape, dtype, chunks)]
    if any(told) and not all(told):
        raise ValueError("shape, dtype and chunks are told together or not at all")
    uri = re.sub("/+$", "", uri + array_path)
    m = read_metadata(uri)
    turn = (lambda x: tuple(x)) if axes == AXES else (lambda x: tuple(x)[::-1])
    if all(told):
        m = replace(m, shape=turn(shape), chunks=turn(chunks), dtype=dtype)
    size, grid = turn(m.shape), turn(m.chunks)
    described = ArraySource(spark.createDataFrame([], "obs_idx long, chunk int, values array<double>"), size, m.dtype, grid[1], fingerprint=canonical_digest(["zarr", uri, list(size), list(grid), m.dtype, list(axes)]))
    out = ZarrSource(described.pieces, size, m.dtype, grid[1], fingerprint=described.fingerprint, uri=uri, metadata=m, axes=axes)
    return replace(out.validate(), pieces=out._pieces())


def write_zarr(source: ArraySource, uri: str, rows: int, codec: str | None = None, axes: tuple[str, str] = AXES) -> Metadata:
    """Store an array as format 2, chunks of ``rows`` observations by the array's own chunk width; a task writes whole chunks, again if it is repeated.

    The metadata comes last, so that an array with some is whole.
    """
    _codec(codec)
    (n, m), width, turned = source.shape, min(source.width, max(1, source.shape[1])), axes != AXES
    meta = {
        "zarr_format": 2, "shape": [m, n] if turned else [n, m], "chunks": [width, rows] if turned else [rows, width], "dtype": "<f8", "order": "C",
        "compressor": None if codec is None else {"id": codec}, "fill_value": "NaN", "filters": None,
    }

    def store(key: tuple, table: pa.Table) -> pa.Table:
        r, c = (int(k.as_py()) for k in key)
        x = np.full((rows, width), np.nan)
        for i, v in zip(table.column("obs_idx").to_pylist(), table.column("values").to_pylist(), strict=True):
            x[(i - 1) % rows, : len(v)] = [np.nan if y is None else y for y in v]
        data = np.ascontiguousarray(x.T if turned else x, "<f8").tobytes()
        if codec == "zstd":
            data = pa.compress(data, codec="zstd", asbytes=True)
        elif codec:
            data = zlib.compress(data) if codec == "zlib" else zlib.compress(data, wbits=31)
        system, path = file_system(uri)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{c}.{r}" if turned else f"{path}/{r}.{c}") as f:
            f.write(data)
        return pa.table({"bytes": [len(data)]})

    keyed = source.pieces.withColumn("r", F.floor((F.col("obs_idx") - 1) / rows))
    keyed.groupBy("r", "chunk").applyInArrow(store, "bytes long").agg(F.sum("bytes")).collect()
    system, path = file_system(uri)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/.zarray") as f:
        f.write(json.dumps(meta).encode())
    return parse_metadata(json.dumps(meta))
