"""Low-rank arrays: scores by observation times loadings by feature, multiplied as they are read.

A latent array holds (obs_idx, scores) and (feat_idx, loadings, offset), one
array of k numbers a row. It is an array like any other, whose cells are made
when they are asked for: a read of few features or observations meets the
loadings and scores of these alone. Scores are packed in tiles of some hundred
rows, loadings in blocks of as many features; a tile meets each block by an
equi-join on the block's number and is multiplied as two matrices, so that no
table of observations by components by features is made. Loadings are broadcast
where their size, known from the shape, allows.

pca() finds such a factorisation of an array by subspace iteration.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import canonical_digest
from ..functions.storage import written
from .source import ArraySource, checked, whole_rows

TILE = 256
BROADCAST_BYTES = 32 << 20


def _matrix(rows: pa.ListArray, k: int) -> np.ndarray:
    """Rows of k numbers; NaN for null."""
    flat = rows.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(flat) != len(rows) * k:
        raise ValueError(f"not all rows have {k} components")
    return flat.reshape(len(rows), k)


def _lists(x: np.ndarray, null_nan: bool = False) -> pa.ListArray:
    ends = np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32) if x.size else np.zeros(len(x) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel(), from_pandas=null_nan))


def _tiles(scores: DataFrame, k: int, carry: Sequence[str]) -> DataFrame:
    """Rows of a partition packed by ``TILE``: arrays of obs_idx and carried columns, and the scores as one array."""
    names = ["obs_idx", *carry]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), TILE):
                part = b.slice(a, TILE)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([*[one(part.column(c)) for c in names], one(pa.array(_matrix(part.column("scores"), k).ravel()))], names=[*names, "scores"])

    schema = T.StructType([T.StructField(c, T.ArrayType(scores.schema[c].dataType)) for c in names] + [T.StructField("scores", T.ArrayType(T.DoubleType()))])
    return scores.select(*names, "scores").mapInArrow(pack, schema)


@dataclass(frozen=True)
class LatentSource(ArraySource):
    scores: DataFrame = field(kw_only=True, compare=False)  # obs_idx long, scores array<double>; and run_id, if loadings have it
    loadings: DataFrame = field(kw_only=True, compare=False)  # feat_idx int, loadings array<double>, offset double
    k: int = field(kw_only=True, default=0)
    runs: bool = field(kw_only=True, default=False)
    factors: tuple[ArraySource, ArraySource, DataFrame | None] | None = field(kw_only=True, default=None, compare=False)  # scores, loadings and offset as they came, while nothing is selected

    def _made(self, features: Sequence[int] | None = None, carry: Sequence[str] = ()) -> DataFrame:
        """(obs_idx, carried columns, chunk, feats, values): the products of every tile with every block."""
        own, run = self.loadings, ["run_id"] if self.runs else []
        if features is None:
            n, number, place = self.shape[1], F.floor((F.col("feat_idx") - 1) / self.width), F.col("feat_idx")
        else:
            at = self.loadings.sparkSession.createDataFrame(list(enumerate(features)), "__at long, feat_idx int")
            own = own.join(F.broadcast(at), "feat_idx")
            n, number, place = len(features), F.floor(F.col("__at") / self.width), F.col("__at")
        packed = F.sort_array(F.collect_list(F.struct(place.alias("p"), "feat_idx", "loadings", "offset")))
        blocks = own.groupBy(*run, number.cast("int").alias("chunk")).agg(packed.alias("__block"))
        if n * self.k * 8 <= BROADCAST_BYTES and not run:
            blocks = F.broadcast(blocks)
        tiles = _tiles(self.scores, self.k, [*carry, *run])
        if run:  # a tile may hold rows of several runs
            tiles = _tiles(self.scores.repartition("run_id").sortWithinPartitions("run_id", "obs_idx"), self.k, [*carry, *run]).withColumn("__runs", F.array_distinct("run_id"))
            tiles = tiles.withColumnRenamed("run_id", "__run").withColumn("run_id", F.explode("__runs")).drop("__runs")
        pairs = tiles.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n // self.width) - 1))))).join(blocks, [*run, "chunk"])
        names, k = ["obs_idx", *carry], self.k

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(len(b)):
                    cell = lambda c: b.column(c).slice(i, 1).flatten()  # noqa: B023, E731
                    rows, block = {c: cell(c) for c in names}, cell("__block")
                    s, w = cell("scores").to_numpy(zero_copy_only=False).reshape(-1, k), _matrix(block.field("loadings"), k)
                    if run:
                        mine = np.flatnonzero(np.array(cell("__run").to_pylist(), object) == b.column("run_id")[i].as_py())
                        s, rows = s[mine], {c: x.take(pa.array(mine)) for c, x in rows.items()}
                    v = s @ w.T + block.field("offset").fill_null(0.0).to_numpy(zero_copy_only=False)
                    feats = block.field("feat_idx").to_numpy()
                    out = [*rows.values(), pa.array(np.full(len(s), b.column("chunk")[i].as_py(), np.int32)), _lists(np.broadcast_to(feats, (len(s), len(feats))).astype(np.int32)), _lists(v, True)]
                    yield pa.RecordBatch.from_arrays(out, names=[*names, "chunk", "feats", "values"])

        schema = T.StructType([self.scores.schema[c] for c in names] + [T.StructField("chunk", T.IntegerType()), T.StructField("feats", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])
        keep = [*names, "scores", "chunk", "__block", *(["__run", "run_id"] if run else [])]
        return pairs.select(*keep).mapInArrow(multiply, schema)

    def meeting(self, rows: DataFrame) -> LatentSource:
        scores = self.scores.join(rows, "obs_idx", "inner" if len(rows.columns) > 1 else "left_semi")
        return _whole(replace(self, scores=scores), [c for c in rows.columns if c != "obs_idx"])

    def _held(self, features: Sequence[int]) -> LatentSource:
        """Without the shards of the loadings that hold none of ``features``."""
        if self.factors is None or not self.factors[1].parts:
            return self
        _, loadings, offset = self.factors
        return replace(self, loadings=_with_offset(loadings.holding(features), offset))

    def long(self, features: Sequence[int] | None = None, carry: Sequence[str] = ()) -> DataFrame:
        asked = None if features is None else sorted(set(features))
        if asked == []:
            return self.long(carry=carry).where(F.lit(False))
        made = (self if asked is None else self._held(asked))._made(asked, carry)
        return made.select("obs_idx", *carry, F.explode(F.arrays_zip("feats", "values")).alias("x")).select("obs_idx", *carry, F.col("x.feats").alias("feat_idx"), F.col("x.values").alias("value"))

    def holding(self, rows: Sequence[int]) -> LatentSource:
        """The scores of ``rows`` alone; shards of the scores that hold none of them leave the plan."""
        if self.factors is not None and self.factors[0].parts:
            held = whole_rows(self.factors[0].holding(rows)).withColumnRenamed("values", "scores")
            return replace(self, scores=held).meeting(self.scores.sparkSession.createDataFrame([(i,) for i in sorted(set(rows))], "obs_idx long"))
        asked = self.scores.sparkSession.createDataFrame([(i,) for i in sorted(set(rows))], "obs_idx long")
        return self.meeting(asked)

    def view(self, observations: Sequence[int] | None = None, features: Sequence[int] | None = None) -> ArraySource:
        """A latent array again: of the scores and loadings selected."""
        spark, out = self.scores.sparkSession, self
        if observations is not None:
            asked = checked(observations, self.shape[0])
            at = spark.createDataFrame(list(zip(asked, range(1, len(asked) + 1), strict=True)), "obs_idx long, __pos long")
            scores = out.scores.join(at, "obs_idx").withColumn("obs_idx", F.col("__pos")).drop("__pos")
            out = replace(out, scores=scores, factors=None, shape=(len(asked), out.shape[1]))
        if features is not None:
            asked = checked(features, self.shape[1])
            at = spark.createDataFrame(list(zip(asked, range(1, len(asked) + 1), strict=True)), "feat_idx int, __pos int")
            loadings = out.loadings.join(at, "feat_idx").withColumn("feat_idx", F.col("__pos")).drop("__pos")
            out = replace(out, loadings=loadings, factors=None, shape=(out.shape[0], len(asked)))
        return _whole(replace(out, fingerprint=canonical_digest([self.fingerprint, list(observations or []), list(features or [])])))


def _whole(x: LatentSource, carry: Sequence[str] = ()) -> LatentSource:
    return replace(x, pieces=x._made(None, carry).select("obs_idx", *carry, "chunk", "values"))


def latent_source(scores: ArraySource, loadings: ArraySource, offset: DataFrame | None = None, width: int = TILE) -> LatentSource:
    """The array scores x loadings' + offset.

    ``scores`` is an array of observations by components, ``loadings`` one of
    features by components; ``offset`` (feat_idx, offset) is 0 where it has no
    row. Null or NaN factors give null cells.
    """
    (n, k), (m, j) = scores.shape, loadings.shape
    if k != j or not k:
        raise ValueError(f"scores have {k} components, loadings {j}")
    rows = whole_rows(scores).withColumnRenamed("values", "scores")
    return _whole(LatentSource(rows, (n, m), "float64", width, fingerprint=canonical_digest(["latent", scores.fingerprint, loadings.fingerprint]), scores=rows, loadings=_with_offset(loadings, offset), k=k, factors=(scores, loadings, offset)))


def _with_offset(loadings: ArraySource, offset: DataFrame | None) -> DataFrame:
    own = whole_rows(loadings).select(F.col("obs_idx").cast("int").alias("feat_idx"), F.col("values").alias("loadings"))
    if offset is None:
        return own.withColumn("offset", F.lit(0.0))
    return own.join(offset.select(F.col("feat_idx").cast("int").alias("feat_idx"), F.col("offset").cast("double")), "feat_idx", "left")


def latent_runs(runs: Sequence[LatentSource]) -> LatentSource:
    """Runs one below the other, each with its own loadings; they must agree in features and components."""
    first = runs[0]
    if any(r.shape[1] != first.shape[1] or r.k != first.k or r.runs for r in runs):
        raise ValueError("runs must agree in features and components")
    n, scores, loadings = 0, None, None
    for i, r in enumerate(runs, 1):
        s = r.scores.select((F.col("obs_idx") + n).alias("obs_idx"), "scores", F.lit(i).alias("run_id"))
        w = r.loadings.withColumn("run_id", F.lit(i))
        scores, loadings = (s, w) if scores is None else (scores.unionByName(s), loadings.unionByName(w))
        n += r.shape[0]
    return _whole(replace(first, scores=scores, loadings=loadings, factors=None, shape=(n, first.shape[1]), runs=True, fingerprint=canonical_digest([r.fingerprint for r in runs])))


def _pass(rows: DataFrame, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A' A q of the centred rows A: tasks add up their parts, groups of tasks theirs, Spark the few that are left."""
    v, l = q.shape
    shared = rows.sparkSession.sparkContext.broadcast((mean, q))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (mu, basis), total = shared.value, np.zeros((v, l))
        for b in batches:
            for a in range(0, len(b), TILE):
                x = _matrix(b.column("values").slice(a, TILE), v) - mu
                total += x.T @ (x @ basis)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(v, dtype=np.int32)), _lists(total)], names=["f", "z"])

    parts = rows.select("values").mapInArrow(part, "f int, z array<double>")
    added = parts.select("f", F.posexplode("z").alias("j", "x")).groupBy("f", "j").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros((v, l))
    out[added.column("f").to_numpy(), added.column("j").to_numpy()] = added.column("x").to_numpy()
    shared.unpersist()
    return out


@dataclass(frozen=True)
class Pca:
    scores: DataFrame  # obs_idx, scores
    loadings: DataFrame  # feat_idx, loadings, offset
    variance: tuple[float, ...]  # of each component, largest first
    shape: tuple[int, int]

    def source(self, width: int = TILE) -> LatentSource:
        """The array that the components give back."""
        k = len(self.variance)
        return _whole(LatentSource(self.scores, self.shape, "float64", width, fingerprint=canonical_digest(["pca", self.shape, [float(x) for x in self.variance]]), scores=self.scores, loadings=self.loadings, k=k))


def pca(source: ArraySource, k: int, oversample: int = 16, exact_features: int = 512, passes: int = 60, tolerance: float = 1e-10, max_entries: int = 8_000_000, seed: int = 1) -> Pca:
    """The k leading principal components of an array's observations, features centred.

    Subspace iteration: each pass over the rows multiplies a basis of k +
    ``oversample`` vectors by the features' covariance, added up by tasks, and
    makes it orthonormal, until the leading variances settle. With at most
    ``exact_features`` features the basis is the whole space and one pass is
    exact. The basis, features x (k + oversample) numbers, is the one thing that
    driver and tasks hold whole; more than ``max_entries`` is an error: map to
    parcels first. A component's largest loading is positive. Nulls are an error.
    """
    n, v = source.shape
    if not 1 <= k <= min(n, v):
        raise ValueError(f"between 1 and {min(n, v)} components")
    l = v if v <= exact_features else min(v, k + oversample)
    if v * l > max_entries:
        raise ValueError(f"{v} features by {l} vectors are more than {max_entries} numbers")
    rows = written(whole_rows(source).withColumn("values", F.when(F.exists("values", lambda x: x.isNull() | F.isnan(x)), F.raise_error(F.lit("components need every cell")).cast("array<double>")).otherwise(F.col("values"))))
    sums = rows.select(F.posexplode("values").alias("f", "x")).groupBy("f").agg(F.avg("x").alias("m")).toArrow()
    mean = np.zeros(v)
    mean[sums.column("f").to_numpy()] = sums.column("m").to_numpy()
    q = np.eye(v) if l == v else np.linalg.qr(np.random.default_rng(seed).normal(size=(v, l)))[0]
    had = None
    for _ in range(1 if l == v else passes):
        z = _pass(rows, mean, q)
        values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1]
        basis = q @ turn[:, :k]
        if had is not None and np.abs(values - had).max() <= tolerance * max(values[0], 1e-300):
            break
        had = values
        q = np.linalg.qr(z)[0] if l < v else q
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(k)])
    shared = rows.sparkSession.sparkContext.broadcast((mean, basis))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mu, w = shared.value
        for b in batches:
            for a in range(0, len(b), TILE):
                part = b.slice(a, TILE)
                yield pa.RecordBatch.from_arrays([part.column("obs_idx"), _lists((_matrix(part.column("values"), v) - mu) @ w)], names=["obs_idx", "scores"])

    scores = written(rows.select("obs_idx", "values").mapInArrow(project, "obs_idx long, scores array<double>"))
    loadings = rows.sparkSession.createDataFrame([(i + 1, basis[i].tolist(), float(mean[i])) for i in range(v)], "feat_idx int, loadings array<double>, offset double")
    return Pca(scores, loadings, tuple((np.maximum(values, 0) / max(1, n - 1)).tolist()), (n, v))
