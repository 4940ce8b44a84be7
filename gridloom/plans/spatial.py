"""Maps of observations over the space that their features come from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.axis import InvalidAxis
from ..operators.source import picked, whole_rows, with_row
from ..operators.spaces import BasisSpace, CompositeSpace, ParcelSpace, Space, SurfaceSpace, VolumeSpace
from .blocks import OverBudget
from .frame import Frame, Selector

PATHS = ("auto", "native", "reconstruct")


def execution_path(frame: Frame, operation: str = "matrix", assay: str | None = None, path: str = "auto") -> str:
    """matrix, native or reconstruct: native needs a source that can read whole images, and all of its features in order."""
    if operation not in ("matrix", "spatial") or path not in PATHS:
        raise ValueError("operation is matrix or spatial, path is auto, native or reconstruct")
    if operation == "matrix":
        return "matrix"
    source = frame.assays[assay or frame.active_assay].source
    native = source.native is not None and frame.columns() == list(range(1, source.shape[1] + 1))
    if path == "native" and not native:
        raise InvalidAxis("whole images cannot be read of this source or selection")
    return "native" if native and path != "reconstruct" else "reconstruct"


def native_cells(space: Space) -> int:
    """Cells of one map over the space that the features come from."""
    if isinstance(space, CompositeSpace):
        return sum(native_cells(s) for _, s in space.parts)
    if isinstance(space, ParcelSpace) or isinstance(space, BasisSpace) and space.decode is not None:
        return native_cells(space.parent)
    if isinstance(space, VolumeSpace):
        return space.dim[0] * space.dim[1] * space.dim[2]
    return len(space.vertex_ids) if isinstance(space, SurfaceSpace) else space.n_features


def _grid(spark: SparkSession, space: Space) -> DataFrame | None:
    """One row: for each native place the feature that covers it, or null; None where places are features in order."""
    if not isinstance(space, (VolumeSpace, SurfaceSpace)) or isinstance(space, VolumeSpace) and space.support is None:
        return None
    f = space.features(spark).select(F.col("linear" if isinstance(space, VolumeSpace) else "vertex").cast("long").alias("id"), "feat_idx")
    every = spark.range(1, native_cells(space) + 1).join(f, "id", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "feat_idx"))), lambda x: x["feat_idx"]).alias("__at"))


def _decoded(df: DataFrame, space: Space, name: str) -> DataFrame:
    """The array ``name`` of parcels or components as one of the parent's features; a feature without any is null."""
    spark = df.sparkSession
    entries = space.decoder(spark).where("w <> 0").groupBy("target").agg(F.sort_array(F.collect_list(F.struct(F.col("source").alias("s"), "w"))).alias("e"))
    every = spark.range(1, space.parent.n_features + 1).select(F.col("id").cast("int").alias("target")).join(entries, "target", "left")
    ops = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("target", "e"))), lambda x: x["e"]).alias("__ops"))
    value = lambda e: F.when(e.isNotNull(), F.aggregate(e, F.lit(0.0), lambda total, x: total + F.element_at(name, x["s"]) * x["w"]))
    return with_row(df, ops).withColumn(name, F.transform("__ops", value)).drop("__ops")


def _maps(df: DataFrame, space: Space, name: str, part: str = "") -> tuple[DataFrame, list[tuple[str, str]]]:
    """``df`` with an array for each native part of the space that the array ``name`` is a vector of: (part, column)."""
    if isinstance(space, CompositeSpace):
        out: list[tuple[str, str]] = []
        for k, (own, s, n) in enumerate(space._offsets()):
            df, found = _maps(df.withColumn(f"{name}_{k}", F.slice(name, n + 1, s.n_features)), s, f"{name}_{k}", f"{part}/{own}" if part else own)
            out += found
        return df, out
    if isinstance(space, ParcelSpace) or isinstance(space, BasisSpace) and space.decode is not None:
        return _maps(_decoded(df, space, name), space.parent, name, part)
    at = _grid(df.sparkSession, space)
    if at is not None:
        df = with_row(df, at).withColumn(name, F.transform("__at", lambda p: F.element_at(name, p))).drop("__at")
    return df, [(part, name)]


def map_rows_of(space: Space, rows: DataFrame, name: str = "values") -> DataFrame:
    """``rows`` with ``maps``, an array of (part, values), in place of the vector ``name``: values over all native places, null where no feature covers one.

    A place is the linear index in a grid, the vertex of a mesh or the feature
    of an index; ``part`` is the path of a composite's part, empty otherwise.
    All of it happens inside the row, by position.
    """
    df, parts = _maps(rows, space, name)
    made = F.array(*[F.struct(F.lit(p).alias("part"), F.col(c).alias("values")) for p, c in parts])
    return df.select(*[c for c in rows.columns if c != name], made.alias("maps"))


def exploded(maps: DataFrame) -> DataFrame:
    """(other columns, part, place, value) of rows with ``maps``."""
    keys = [c for c in maps.columns if c != "maps"]
    each = maps.select(*keys, F.explode("maps").alias("m")).select(*keys, "m.part", F.posexplode("m.values").alias("p", "value"))
    return each.select(*keys, "part", (F.col("p") + 1).cast("long").alias("place"), "value")


def reconstruct(space: Space, vectors: DataFrame, of: DataFrame) -> DataFrame:
    """(columns of ``of``, part, place, value) of long vectors (columns of ``of``, feat_idx, value), each gathered to a row first; features that a vector lacks are null."""
    keys = of.columns
    found = vectors.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feat_idx", "value"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(1), F.lit(space.n_features)), lambda f: F.element_at("m", f))
    return exploded(map_rows_of(space, of.join(found, keys, "left").select(*keys, dense.alias("values"))))


def vectorize_rows(space: VolumeSpace, grids: DataFrame, name: str = "values") -> DataFrame:
    """Rows whose array over a whole grid becomes one over the space's features."""
    return grids if space.support is None else picked(grids, list(space.support), name)


def image_rows(frame: Frame, assay: str | None = None, path: str = "auto") -> DataFrame:
    """(obs_id, maps) of every observation of a frame or view.

    The native path reads whole images and blanks what no feature covers; the
    other reads the features and lays them out. Both give the same maps.
    """
    way = execution_path(frame, "spatial", assay, path)
    a = frame.assays[assay or frame.active_assay].source
    o = frame.observations.table.select(F.col(frame.observations.id).alias("obs_id"), F.col("idx").alias("obs_idx"))
    if way == "native":
        images = a.native.join(o, "obs_idx").select("obs_id", "values")
        at = _grid(images.sparkSession, frame.space)
        if at is not None:
            images = with_row(images, at).select("obs_id", F.zip_with("values", "__at", lambda v, p: F.when(p.isNotNull(), v)).alias("values"))
        return images.select("obs_id", F.array(F.struct(F.lit("").alias("part"), "values")).alias("maps"))
    columns = frame.columns()
    rows = whole_rows(a.meeting(o), ["obs_id"])
    if columns != list(range(1, a.shape[1] + 1)):
        rows = picked(rows, columns)
    return map_rows_of(frame.space, rows.select("obs_id", "values"))


def spatial_maps(frame: Frame, observations: Selector | None = None, assay: str | None = None, budget: int | None = 2 << 30, path: str = "auto") -> DataFrame:
    """(obs_id, part, place, value): a map for each observation selected. Maps beyond ``budget`` bytes in all are refused before any read; None lets them be."""
    view = frame if observations is None else frame.take(observations)
    if budget is not None and (need := native_cells(view.space) * 8 * view.observations.count()) > budget:
        raise OverBudget(f"maps of {need} bytes exceed {budget}")
    return exploded(image_rows(view, assay, path))


def spatial_map(frame: Frame, observation: str | int, assay: str | None = None) -> DataFrame:
    """(part, place, value) of one observation, by identifier or position."""
    return spatial_maps(frame, [observation], assay).drop("obs_id")


def execute_spatial(frame: Frame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, assay: str | None = None, budget: int = 512 << 20, path: str = "auto") -> DataFrame:
    """``f`` on each observation's map (obs_id, part, place, value), one in memory at a time; a map beyond ``budget`` bytes is refused.

    Maps come as rows, so that nothing is shuffled.
    """
    if (need := native_cells(frame.space) * 8) > budget:
        raise OverBudget(f"a map of {need} bytes exceeds {budget}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(len(b)):
                maps = b.column("maps").slice(i, 1).flatten()
                values, parts = maps.field("values"), maps.field("part")
                n = pc.list_value_length(values).to_numpy(zero_copy_only=False)
                yield f(pd.DataFrame({"obs_id": b.column("obs_id")[i].as_py(), "part": np.repeat(np.array(parts.to_pylist(), object), n), "place": np.concatenate([np.arange(1, k + 1) for k in n]), "value": values.flatten().to_numpy(zero_copy_only=False)}))

    def as_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in run(batches):
            yield from pa.Table.from_pandas(pdf, schema=out, preserve_index=False).to_batches()

    rows = image_rows(frame, assay, path)
    out = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return rows.mapInArrow(as_arrow, schema)
