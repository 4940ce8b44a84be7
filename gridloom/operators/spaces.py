"""Feature spaces: the typed domain of a feature axis.

A space is a descriptor with a digest of what makes it what it is, and tables:
its features (feat_idx from 1, feature_id, ...), and for parcels and bases the
linear operators between it and its parent, as (target, source, w) triples.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, fields
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import canonical_digest, grid_index

OPERATOR = "target int, source int, w double"


class IncompatibleSpaces(ValueError):
    """Two spaces that differ."""


@dataclass(frozen=True)
class Space:
    """Base of all spaces; fields marked with identity=False don't enter the digest."""

    @cached_property
    def digest(self) -> str:
        return canonical_digest([type(self).__name__, self])

    @property
    def n_features(self) -> int:
        raise NotImplementedError

    def features(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def adjacency(self, spark: SparkSession) -> DataFrame | None:
        """(a, b) of neighbouring features, both ways; None where a space has no neighbours."""
        return None

    def restrict(self, index: Sequence[int]) -> Space:
        raise NotImplementedError


def compatible(x: Space, y: Space) -> bool:
    return type(x) is type(y) and x.digest == y.digest


def assert_compatible(x: Space, y: Space) -> None:
    if not compatible(x, y):
        raise IncompatibleSpaces(f"{type(x).__name__} {x.digest[:12]} and {type(y).__name__} {y.digest[:12]}")


@dataclass(frozen=True)
class IndexSpace(Space):
    n: int
    ids: tuple[str, ...] | None = None
    namespace: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def n_features(self) -> int:
        return self.n

    def features(self, spark: SparkSession) -> DataFrame:
        df = spark.range(1, self.n + 1).select(F.col("id").cast("int").alias("feat_idx"))
        if self.ids is None:
            return df.withColumn("feature_id", F.concat(F.lit("feature-"), F.col("feat_idx").cast("string")))
        return df.withColumn("feature_id", F.element_at(F.array(*map(F.lit, self.ids)), F.col("feat_idx")))

    def restrict(self, index: Sequence[int]) -> IndexSpace:
        ids = self.ids or tuple(f"feature-{i}" for i in range(1, self.n + 1))
        return IndexSpace(len(index), tuple(ids[i - 1] for i in index), self.namespace)


@dataclass(frozen=True)
class VolumeSpace(Space):
    """A grid; ``support`` lists the linear indices that are features, in order (None: all)."""

    dim: tuple[int, int, int]
    affine: tuple[float, ...] = tuple(float(x) for x in np.eye(4).ravel())
    support: tuple[int, ...] | None = None
    template: str | None = None
    units: str = "mm"
    note: dict = field(default_factory=dict, metadata={"identity": False})

    def __post_init__(self) -> None:
        n = math.prod(self.dim)
        if len(self.dim) != 3 or n < 1 or len(self.affine) != 16:
            raise ValueError("a volume needs three positive dimensions and a 4 x 4 affine")
        if self.support is not None and (len(set(self.support)) != len(self.support) or any(not 1 <= i <= n for i in self.support)):
            raise ValueError("support must be unique positions in the grid")

    @property
    def n_features(self) -> int:
        return math.prod(self.dim) if self.support is None else len(self.support)

    def features(self, spark: SparkSession) -> DataFrame:
        if self.support is None:
            df = spark.range(1, math.prod(self.dim) + 1).select(F.col("id").cast("int").alias("feat_idx"), F.col("id").alias("linear"))
        else:
            df = spark.createDataFrame(list(enumerate(self.support, 1)), "feat_idx int, linear long")
        named = df.withColumn("feature_id", F.concat(F.lit("voxel-"), F.col("linear").cast("string")))
        return named.select("feat_idx", "feature_id", "linear", *grid_index(F.col("linear"), self.dim))

    def adjacency(self, spark: SparkSession) -> DataFrame:
        """Six neighbours: each feature looks its neighbours up by linear index."""
        nx, ny, nz = self.dim
        f = self.features(spark)
        step = lambda ok, d: F.when(ok, F.col("linear") + d)
        near = F.array(
            step(F.col("i") > 1, -1), step(F.col("i") < nx, 1), step(F.col("j") > 1, -nx), step(F.col("j") < ny, nx), step(F.col("k") > 1, -nx * ny), step(F.col("k") < nz, nx * ny)
        )
        a = f.select(F.col("feat_idx").alias("a"), F.explode(near).alias("linear")).where("linear is not null")
        return a.join(f.select("linear", F.col("feat_idx").alias("b")), "linear").select("a", "b")

    def restrict(self, index: Sequence[int]) -> VolumeSpace:
        have = self.support or tuple(range(1, math.prod(self.dim) + 1))
        return VolumeSpace(self.dim, self.affine, tuple(have[i - 1] for i in index), self.template, self.units, self.note)

    def vectorize(self, grid: DataFrame) -> DataFrame:
        """(feat_idx, value) of a table (linear, value)."""
        return self.features(grid.sparkSession).select("feat_idx", "linear").join(grid, "linear", "left").select("feat_idx", "value")

    def reconstruct(self, vector: DataFrame, of: DataFrame | None = None) -> DataFrame:
        """(linear, value) of the whole grid; cells that no feature covers are null, not 0.

        ``of`` has a row for each of many vectors; they are told apart by its columns, which ``vector`` has too.
        """
        spark, keys = vector.sparkSession, [] if of is None else of.columns
        grid = F.sequence(F.lit(1), F.lit(math.prod(self.dim)).cast("long"))
        every = (spark.range(1) if of is None else of).select(*keys, F.explode(grid.cast("array<bigint>")).alias("linear"))
        cells = self.features(spark).select("feat_idx", "linear").join(vector, "feat_idx").select(*keys, "linear", "value")
        return every.join(cells, [*keys, "linear"], "left")


@dataclass(frozen=True)
class SurfaceSpace(Space):
    """Vertices of a mesh. ``triangles`` hold 1-based positions among all vertices."""

    vertex_ids: tuple[str, ...]
    hemisphere: tuple[str, ...]
    triangles: tuple[tuple[int, int, int], ...] = ()
    support: tuple[int, ...] | None = None
    medial_wall: tuple[int, ...] = ()
    template: str | None = None
    units: str = "mm"

    def __post_init__(self) -> None:
        if len(set(self.vertex_ids)) != len(self.vertex_ids) or len(self.hemisphere) != len(self.vertex_ids):
            raise ValueError("vertices need unique ids and a hemisphere each")

    def kept(self) -> list[int]:
        wall = set(self.medial_wall)
        return [i for i in (self.support or range(1, len(self.vertex_ids) + 1)) if i not in wall]

    @property
    def n_features(self) -> int:
        return len(self.kept())

    def features(self, spark: SparkSession) -> DataFrame:
        seen: dict[str, int] = {}
        rows = []
        for n, i in enumerate(self.kept(), 1):
            h = self.hemisphere[i - 1]
            seen[h] = seen.get(h, 0) + 1
            rows.append((n, self.vertex_ids[i - 1], i, h, seen[h]))
        return spark.createDataFrame(rows, "feat_idx int, feature_id string, vertex int, hemisphere string, within int")

    def adjacency(self, spark: SparkSession) -> DataFrame:
        f = self.features(spark).select("feat_idx", "vertex")
        t = spark.createDataFrame([list(x) for x in self.triangles] or [], "x int, y int, z int")
        sides = F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p in "xyz" for q in "xyz" if p != q])
        e = t.select(F.explode(sides).alias("e")).select("e.p", "e.q").distinct()
        return e.join(f.toDF("a", "p"), "p").join(f.toDF("b", "q"), "q").select("a", "b")

    def restrict(self, index: Sequence[int]) -> SurfaceSpace:
        have = self.kept()
        return SurfaceSpace(self.vertex_ids, self.hemisphere, self.triangles, tuple(have[i - 1] for i in index), self.medial_wall, self.template, self.units)


@dataclass(frozen=True)
class ParcelSpace(Space):
    """Parcels over a parent. ``membership``: (parcel position, parent feature, weight)."""

    parent: Space
    parcel_ids: tuple[str, ...]
    membership: tuple[tuple[int, int, float], ...]
    atlas: str
    aggregation: str = "mean"

    def __post_init__(self) -> None:
        if self.aggregation not in ("mean", "sum"):
            raise ValueError("aggregation is mean or sum")
        total = {p: 0.0 for p in range(1, len(self.parcel_ids) + 1)}
        for p, s, w in self.membership:
            if p not in total or not 1 <= s <= self.parent.n_features or w < 0:
                raise ValueError("membership names an unknown parcel or feature, or has a negative weight")
            total[p] += w
        if min(total.values(), default=1) <= 0:
            raise ValueError("every parcel needs positive weight")

    @property
    def n_features(self) -> int:
        return len(self.parcel_ids)

    def features(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, f"{self.atlas}:{p}", p) for i, p in enumerate(self.parcel_ids, 1)], "feat_idx int, feature_id string, parcel string")

    def members(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([list(m) for m in self.membership], OPERATOR)

    def encoder(self, spark: SparkSession) -> DataFrame:
        """From parent to parcels: weights over their total for means, plain for sums."""
        m = self.members(spark)
        if self.aggregation == "sum":
            return m
        total = m.groupBy("target").agg(F.sum("w").alias("t"))
        return m.join(total, "target").select("target", "source", (F.col("w") / F.col("t")).alias("w"))

    def decoder(self, spark: SparkSession) -> DataFrame:
        """From parcels to parent: a feature gets the mean of its parcels by weight."""
        m = self.members(spark).where("w > 0")
        total = m.groupBy("source").agg(F.sum("w").alias("t"))
        return m.join(total, "source").select(F.col("source").alias("target"), F.col("target").alias("source"), (F.col("w") / F.col("t")).alias("w"))

    def adjacency(self, spark: SparkSession) -> DataFrame | None:
        """Parcels that have neighbouring members."""
        near = self.parent.adjacency(spark)
        if near is None:
            return None
        m = self.members(spark).where("w > 0")
        p = near.join(m.select(F.col("source").alias("a"), F.col("target").alias("p")), "a").join(m.select(F.col("source").alias("b"), F.col("target").alias("q")), "b")
        return p.where("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()

    def restrict(self, index: Sequence[int]) -> ParcelSpace:
        at = {p: n for n, p in enumerate(index, 1)}
        return ParcelSpace(self.parent, tuple(self.parcel_ids[i - 1] for i in index), tuple((at[p], s, w) for p, s, w in self.membership if p in at), self.atlas, self.aggregation)


@dataclass(frozen=True)
class BasisSpace(Space):
    """Components of a linear basis over a parent: an encoder [component x parent] and maybe its decoder [parent x component]."""

    parent: Space
    component_ids: tuple[str, ...]
    encode: tuple[tuple[float, ...], ...]
    decode: tuple[tuple[float, ...], ...] | None = None
    tolerance: float = 1e-8

    def __post_init__(self) -> None:
        e = np.array(self.encode, float)
        if e.shape != (len(self.component_ids), self.parent.n_features):
            raise ValueError("the encoder must be components by parent features")
        if self.decode is not None:
            d = np.array(self.decode, float)
            if d.shape != e.shape[::-1] or np.abs(e @ d - np.eye(len(e))).max() > self.tolerance:
                raise ValueError("the encoder must be a left inverse of the decoder")

    @property
    def n_features(self) -> int:
        return len(self.component_ids)

    def features(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.component_ids, 1)), "feat_idx int, feature_id string")

    @staticmethod
    def _triples(spark: SparkSession, a: np.ndarray) -> DataFrame:
        return spark.createDataFrame([(int(i) + 1, int(j) + 1, float(a[i, j])) for i, j in np.argwhere(a != 0)], OPERATOR)

    def encoder(self, spark: SparkSession) -> DataFrame:
        return self._triples(spark, np.array(self.encode, float))

    def decoder(self, spark: SparkSession) -> DataFrame:
        if self.decode is None:
            raise ValueError("this basis has no decoder")
        return self._triples(spark, np.array(self.decode, float))

    def restrict(self, index: Sequence[int]) -> BasisSpace:
        """With a decoder, the encoder of fewer components is its least-squares inverse anew."""
        keep = [i - 1 for i in index]
        ids = tuple(self.component_ids[i] for i in keep)
        if self.decode is None:
            return BasisSpace(self.parent, ids, tuple(self.encode[i] for i in keep), None, self.tolerance)
        return basis_from_decoder(self.parent, ids, np.array(self.decode, float)[:, keep], self.tolerance)


def basis_from_decoder(parent: Space, component_ids: Sequence[str], decoder: np.ndarray, tolerance: float = 1e-8) -> BasisSpace:
    """Encoder = pseudo-inverse by singular values; a decoder without full column rank is an error."""
    d = np.array(decoder, float)
    u, s, vt = np.linalg.svd(d, full_matrices=False)
    if not len(s) or s.min() <= max(d.shape) * s.max() * np.finfo(float).eps:
        raise ValueError("the decoder's columns are dependent")
    e = (vt.T / s) @ u.T
    return BasisSpace(parent, tuple(component_ids), tuple(map(tuple, e.tolist())), tuple(map(tuple, d.tolist())), tolerance)


@dataclass(frozen=True)
class CompositeSpace(Space):
    """Named parts one after the other."""

    parts: tuple[tuple[str, Space], ...]

    def __post_init__(self) -> None:
        if len({n for n, _ in self.parts}) != len(self.parts) or not self.parts:
            raise ValueError("parts need unique names")

    @property
    def n_features(self) -> int:
        return sum(s.n_features for _, s in self.parts)

    def _offsets(self) -> list[tuple[str, Space, int]]:
        out, n = [], 0
        for name, s in self.parts:
            out.append((name, s, n))
            n += s.n_features
        return out

    def features(self, spark: SparkSession) -> DataFrame:
        out = None
        for name, s, n in self._offsets():
            f = s.features(spark)
            f = f.withColumns({"feat_idx": (F.col("feat_idx") + n).cast("int"), "feature_id": F.concat(F.lit(f"{name}::"), F.col("feature_id")), "part": F.lit(name)})
            out = f if out is None else out.unionByName(f, allowMissingColumns=True)
        return out

    def adjacency(self, spark: SparkSession) -> DataFrame | None:
        out = None
        for _, s, n in self._offsets():
            if (e := s.adjacency(spark)) is not None:
                e = e.select((F.col("a") + n).cast("int").alias("a"), (F.col("b") + n).cast("int").alias("b"))
                out = e if out is None else out.unionByName(e)
        return out

    def pack(self, vectors: dict[str, DataFrame]) -> DataFrame:
        """(feat_idx, value) of parts' vectors, whatever the order they are given in."""
        out = None
        for name, _, n in self._offsets():
            v = vectors[name].select((F.col("feat_idx") + n).cast("int").alias("feat_idx"), "value")
            out = v if out is None else out.unionByName(v)
        return out

    def restrict(self, index: Sequence[int]) -> CompositeSpace:
        parts = []
        for name, s, n in self._offsets():
            own = [i - n for i in index if n < i <= n + s.n_features]
            if own:
                parts.append((name, s.restrict(own)))
        return CompositeSpace(tuple(parts))


def within_sphere(center: Sequence[float], radius: float) -> Column:
    """Grid cells whose distance from ``center``, in cells, is at most ``radius``."""
    return F.sqrt(F.pow(F.col("i") - center[0], 2) + F.pow(F.col("j") - center[1], 2) + F.pow(F.col("k") - center[2], 2)) <= radius


_KINDS = {k.__name__: k for k in (IndexSpace, VolumeSpace, SurfaceSpace, ParcelSpace, BasisSpace, CompositeSpace)}


def to_plain(x: object) -> object:
    """A space as what JSON can hold; from_plain() gives it back."""
    if isinstance(x, Space):
        return {"space": type(x).__name__, **{f.name: to_plain(getattr(x, f.name)) for f in fields(x)}}
    if isinstance(x, (list, tuple)):
        return [to_plain(v) for v in x]
    return x


def from_plain(x: object) -> object:
    if isinstance(x, dict) and x.get("space") in _KINDS:
        return _KINDS[x["space"]](**{k: from_plain(v) for k, v in x.items() if k != "space"})
    return tuple(from_plain(v) for v in x) if isinstance(x, list) else x
