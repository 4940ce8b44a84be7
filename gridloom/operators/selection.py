"""Which features and time points are asked for, and the slice of an array that they give.

A selector is resolved against a space to (pos, feat_idx): positions count from
1 in the order asked for, and what is asked for twice is there twice. One that
meets no feature is an error. Selectors by place need a volume; the others take
any space.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .series import NothingSelected
from .source import BROADCAST_POSITIONS, ArraySource, _positions, checked
from .spaces import Space, VolumeSpace, within_sphere


class Selector:
    """Kinds say with ``table`` which features they are."""

    def table(self, space: Space, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def resolve(self, space: Space, spark: SparkSession) -> DataFrame:
        found = self.table(space, spark).select(F.col("pos").cast("long").alias("pos"), F.col("feat_idx").cast("int").alias("feat_idx"))
        if not found.limit(1).count():
            raise NothingSelected(f"{type(self).__name__} meets no feature")
        return found


def _volume(space: Space) -> VolumeSpace:
    if not isinstance(space, VolumeSpace):
        raise TypeError(f"a selector by place needs a volume, not {type(space).__name__}")
    return space


def _in_order(features: DataFrame) -> DataFrame:
    """Features in their own order; a space's features are metadata of bounded size."""
    return features.select("feat_idx", F.row_number().over(Window.orderBy("feat_idx")).alias("pos"))


@dataclass(frozen=True)
class Every(Selector):
    def table(self, space: Space, spark: SparkSession) -> DataFrame:
        return space.features(spark).select("feat_idx", F.col("feat_idx").alias("pos"))


@dataclass(frozen=True)
class Positions(Selector):
    """Features by position; one beyond the space is an error."""

    index: tuple[int, ...]

    def table(self, space: Space, spark: SparkSession) -> DataFrame:
        return _positions(spark, checked(self.index, space.n_features), "feat_idx")


@dataclass(frozen=True)
class At(Selector):
    """Cells by grid coordinates. Outside the grid is an error; a cell of the grid that is no feature is left out, with a warning."""

    coords: tuple[tuple[int, int, int], ...]

    def table(self, space: Space, spark: SparkSession) -> DataFrame:
        v = _volume(space)
        for c in self.coords:
            if len(c) != 3 or any(int(x) != x or not 1 <= x <= n for x, n in zip(c, v.dim, strict=True)):
                raise IndexError(f"{tuple(c)} is no cell of a grid of {v.dim}")
        linear = [int(i) + (int(j) - 1) * v.dim[0] + (int(k) - 1) * v.dim[0] * v.dim[1] for i, j, k in self.coords]
        found = _positions(spark, linear, "linear").join(v.features(spark).select("linear", "feat_idx"), "linear")
        gone = len(linear) - found.count()
        if gone:
            warnings.warn(f"{gone} cells asked for are no features", stacklevel=3)
            found = found.withColumn("pos", F.row_number().over(Window.orderBy("pos")))  # of the cells that the caller named
        return found


@dataclass(frozen=True)
class Ball(Selector):
    """Cells within ``radius`` cells of ``center``, which may lie between cells."""

    center: tuple[float, float, float]
    radius: float

    def __post_init__(self) -> None:
        if len(self.center) != 3 or not self.radius > 0:
            raise ValueError("a ball has a centre of three coordinates and a positive radius")

    def table(self, space: Space, spark: SparkSession) -> DataFrame:
        return _in_order(_volume(space).features(spark).where(within_sphere(self.center, self.radius)))


@dataclass(frozen=True)
class Region(Selector):
    """Cells where an array over the grid, the first axis fastest, is neither 0 nor NaN; those that are no features are left out."""

    cells: np.ndarray

    def table(self, space: Space, spark: SparkSession) -> DataFrame:
        v, cells = _volume(space), np.asarray(self.cells)
        if cells.shape != tuple(v.dim):
            raise ValueError(f"a region of {cells.shape} does not fit a grid of {v.dim}")
        flat = np.nan_to_num(cells.astype(float)).ravel(order="F") != 0
        linear = _positions(spark, (np.flatnonzero(flat) + 1).tolist(), "linear").drop("pos")
        return _in_order(v.features(spark).join(linear, "linear", "left_semi"))


@dataclass(frozen=True)
class Flags(Selector):
    """Features where a mask is true, over the features or over the whole grid."""

    mask: tuple[bool, ...]

    def table(self, space: Space, spark: SparkSession) -> DataFrame:
        if isinstance(space, VolumeSpace) and len(self.mask) == math.prod(space.dim):
            return Region(np.asarray(self.mask).reshape(space.dim, order="F")).table(space, spark)
        if len(self.mask) != space.n_features:
            raise ValueError(f"a mask of {len(self.mask)} is as long as neither the features nor the grid")
        return _positions(spark, [i for i, m in enumerate(self.mask, 1) if m], "feat_idx")


def selector_of(x: object) -> Selector:
    """The selector that a plain value stands for: nothing, positions, flags, a grid of flags, or three columns of coordinates."""
    if x is None:
        return Every()
    if isinstance(x, Selector):
        return x
    a = np.asarray(x)
    if a.dtype == bool and a.ndim == 1:
        return Flags(tuple(a.tolist()))
    if a.ndim == 3 and a.dtype.kind in "biuf":
        return Region(a)
    if a.dtype.kind in "iuf" and a.ndim == 2 and a.shape[1] == 3:
        return At(tuple(map(tuple, a.tolist())))
    if a.dtype.kind in "iuf" and a.ndim == 1:
        return Positions(tuple(a.tolist()))
    raise TypeError(f"{type(x).__name__} selects nothing: give positions, flags, coordinates or a selector")


@dataclass(frozen=True)
class Slice:
    """Time points by features, unread; ``features`` are (pos, feat_idx), ``times`` (time_pos, obs_idx, ...) or None for all."""

    source: ArraySource
    features: DataFrame
    times: DataFrame | None = None
    labels: DataFrame | None = None

    def rows(self) -> DataFrame:
        """(time_pos, obs_idx, labels, values): a row for each time point, its values in the order of the features.

        Each piece of a row gives up what is asked of it, so that only that
        is put together where a row has several pieces.
        """
        s, width = self.source, self.source.width
        z = F.col("feat_idx") - 1
        asked = self.features.groupBy(F.floor(z / width).cast("int").alias("chunk")).agg(F.collect_list(F.struct(F.col("pos"), (z % width + 1).cast("int").alias("at"))).alias("asked"))
        few = self.features.count() <= BROADCAST_POSITIONS
        cut = s.pieces.select("obs_idx", "chunk", "values").join(F.broadcast(asked) if few else asked, "chunk")
        taken = cut.select("obs_idx", F.transform("asked", lambda x: F.struct(x["pos"].alias("pos"), F.element_at("values", x["at"]).alias("v"))).alias("x"))
        if s.shape[1] > width:
            taken = taken.groupBy("obs_idx").agg(F.flatten(F.collect_list("x")).alias("x"))
        rows = taken.select("obs_idx", F.array_sort("x")["v"].alias("values"))
        rows = rows.withColumn("time_pos", F.col("obs_idx").cast("long")) if self.times is None else rows.join(self.times, "obs_idx")
        extra = [] if self.labels is None else [c for c in self.labels.columns if c != "obs_idx"]
        rows = rows if self.labels is None else rows.join(self.labels, "obs_idx")
        return rows.select("time_pos", "obs_idx", *extra, "values")

    def long(self) -> DataFrame:
        """(time_pos, obs_idx, labels, pos, feat_idx, signal)."""
        cells = self.rows().select("*", F.posexplode("values").alias("p", "signal")).drop("values")
        named = self.features.select("pos", "feat_idx")
        few = named.count() <= BROADCAST_POSITIONS
        return cells.withColumn("pos", F.col("p").cast("long") + 1).drop("p").join(F.broadcast(named) if few else named, "pos")

    def matrix(self, max_cells: int = 10_000_000) -> np.ndarray:
        """Time by features, in memory; more than ``max_cells`` cells is an error before any is read."""
        n = self.source.shape[0] if self.times is None else self.times.count()
        m = self.features.count()
        if n * m > max_cells:
            raise ValueError(f"{n} x {m} cells are more than {max_cells}: use rows() or long()")
        found = self.rows().select("time_pos", "values").toArrow()
        order = np.argsort(found["time_pos"].to_numpy())
        flat = found["values"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        return flat.reshape(len(order), m)[order]


def sliced(source: ArraySource, space: Space, selector: object = None, timepoints: Sequence[int] | Sequence[bool] | None = None, labels: DataFrame | None = None) -> Slice:
    """The slice of an array that a selector and time points ask for.

    Time points are all, flags as many as there are, or positions, whose order
    and repeats are kept; one that does not exist is an error. ``labels`` are
    columns by ``obs_idx``, such as the run and the time in it, for the rows.
    """
    spark = source.pieces.sparkSession
    if space.n_features != source.shape[1]:
        raise ValueError(f"a space of {space.n_features} features for an array of {source.shape[1]}")
    features = selector_of(selector).resolve(space, spark)
    if timepoints is None:
        return Slice(source, features, None, labels)
    asked = checked([x.item() if isinstance(x, np.generic) else x for x in timepoints], source.shape[0])
    held = source.holding(asked)
    return Slice(replace(source, pieces=held.pieces, parts=()), features, _positions(spark, asked, "obs_idx", "time_pos"), labels)
