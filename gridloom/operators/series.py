"""Runs of time points, spatial selectors, and slices of time by feature."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranges import in_ranges
from .spaces import VolumeSpace, within_sphere


class NothingSelected(ValueError):
    """A selector that meets no feature."""


def run_table(points: DataFrame, run: str, tr: float) -> DataFrame:
    """(run_id, length, TR, duration) of each run."""
    return points.groupBy(F.col(run).alias("run_id")).agg(F.count(F.lit(1)).alias("length")).withColumns({"TR": F.lit(float(tr)), "duration": F.col("length") * F.lit(float(tr))})


def run_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("n_runs"), F.sum("length").alias("n_timepoints"), F.sum("duration").alias("total_duration"))


def expand_runs(runs: DataFrame) -> DataFrame:
    """(run_id, timepoint, run_time): a row for each time point of each run."""
    return runs.select("run_id", "TR", F.explode(F.sequence(F.lit(1), F.col("length").cast("int"))).alias("timepoint")).select("run_id", "timepoint", ((F.col("timepoint") - 1) * F.col("TR")).alias("run_time"))


def block_ids(points: DataFrame, run: str, within: str) -> DataFrame:
    """Points with ``blockid``, the position of their run, and ``sample``, their own among all; runs in order of id.

    What is summed in one place is a row a run.
    """
    runs = points.groupBy(run).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(run)
    placed = runs.select(run, F.row_number().over(w).alias("blockid"), (F.sum("n").over(w) - F.col("n")).alias("__before"))
    at = F.row_number().over(Window.partitionBy(run).orderBy(within))
    return points.withColumn("__at", at).join(placed, run).withColumn("sample", F.col("__at") + F.col("__before")).drop("__at", "__before")


def temporal_info(runs: DataFrame, asked: DataFrame | None = None, order: Sequence[str] = ("subject_id", "run_id")) -> DataFrame:
    """(index, subject_id, run_id, timepoint) of global time indices: they meet the runs' cumulative lengths by equal parts (see in_ranges). Without ``asked``, every index of every run, without a join."""
    end = F.sum("length").over(Window.orderBy(*order))
    spans = runs.withColumn("end", end).withColumn("before", F.col("end") - F.col("length"))
    if asked is None:
        every = spans.where("length > 0").select("before", *order, F.explode(F.sequence(F.lit(1).cast("long"), F.col("length").cast("long"))).alias("timepoint"))
        return every.select((F.col("before") + F.col("timepoint")).alias("index"), *order, "timepoint")
    return in_ranges(asked, "index", spans, "before", "end").select("index", *order, (F.col("index") - F.col("before")).alias("timepoint"))


def select_voxels(space: VolumeSpace, features: DataFrame, where: Column) -> DataFrame:
    found = features.where(where)
    if not found.limit(1).count():
        raise NothingSelected("the selector meets no feature")
    return found


def sphere(space: VolumeSpace, spark, center: Sequence[float], radius: float) -> DataFrame:
    """Features of a volume within ``radius`` cells of ``center``."""
    return select_voxels(space, space.features(spark), within_sphere(center, radius))


def voxels(space: VolumeSpace, spark, coords: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Features at grid coordinates; those outside the support are dropped."""
    asked = spark.createDataFrame([tuple(map(int, c)) for c in coords], "i int, j int, k int").distinct()
    found = space.features(spark).join(F.broadcast(asked), ["i", "j", "k"], "left_semi")
    return select_voxels(space, found, F.lit(True))


def masked(space: VolumeSpace, spark, mask: Sequence[bool]) -> DataFrame:
    """Features where a mask over the whole grid, or over the features, is true."""
    f = space.features(spark)
    at = "linear" if len(mask) == space.dim[0] * space.dim[1] * space.dim[2] else "feat_idx"
    if at == "feat_idx" and len(mask) != space.n_features:
        raise ValueError("a mask is as long as the grid or the features")
    hits = spark.createDataFrame([(i,) for i, m in enumerate(mask, 1) if m], f"{at} long")
    return select_voxels(space, f.join(hits, at, "left_semi"), F.lit(True))


def series(cells: DataFrame, times: DataFrame, features: DataFrame) -> DataFrame:
    """(run_id, timepoint, voxel, signal) of the time points and features selected, long."""
    return cells.join(times.select("obs_idx", "run_id", "timepoint"), "obs_idx").join(features.select("feat_idx"), "feat_idx", "left_semi").select("run_id", "timepoint", F.col("feat_idx").alias("voxel"), F.col("value").alias("signal"))


def column_stats(cells: DataFrame) -> DataFrame:
    return cells.groupBy("feat_idx").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance"), F.max("value").alias("maximum"))


def reconstruct_latent(scores: DataFrame, loadings: DataFrame, offset: DataFrame | None = None, max_components: int = 10_000) -> DataFrame:
    """(t, v, value) = sum over k of score * loading, plus the voxel's offset (its run's, if it has a run_id), of long tables (t, k, score) and (v, k, loading).

    Each run takes its own loadings if they have a run_id. Scores are gathered
    to a row a time point, loadings to a row a voxel, and multiplied in blocks
    (see latent.py); components that a row lacks count as 0. Voxels are whole
    numbers.
    """
    from .latent import TILE, LatentSource

    run = ["run_id"] if "run_id" in loadings.columns and "run_id" in scores.columns else []
    keep = ["run_id"] if "run_id" in scores.columns else []
    ks = [r[0] for r in loadings.select("k").distinct().orderBy("k").limit(max_components + 1).collect()]
    if len(ks) > max_components:
        raise ValueError(f"more than {max_components} components")
    at = scores.sparkSession.createDataFrame(list(zip(ks, range(len(ks)), strict=True)), T.StructType([loadings.schema["k"], T.StructField("__at", T.IntegerType())]))

    def rows(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
        """A row for each ``by``, its values in the order of the components, 0 where it has none."""
        found = df.where(F.col(value).isNotNull()).join(F.broadcast(at), "k").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__at", F.col(value).cast("double").alias("x")))).alias("e"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(len(ks) - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
        return found.withColumn("m", F.map_from_entries("e")).select(*by, dense.alias(f"{value}s"))

    if not ks:
        return scores.select(*keep, "t").join(loadings.select("v"), F.lit(False)).withColumn("value", F.lit(None).cast("double"))
    left = rows(scores, [*keep, "t"], "score").withColumn("obs_idx", F.monotonically_increasing_id())
    ends = loadings.agg(F.min("v").alias("a"), F.max("v").alias("z")).first()
    place = (F.col("v") - (ends["a"] - 1)).cast("int").alias("feat_idx")
    right = rows(loadings, [*run, "v"], "loading").select(*run, place, F.col("loadings"))
    if offset is not None:
        by = [*(c for c in run if c in offset.columns), "feat_idx"]
        right = right.join(offset.select(*by[:-1], place, F.col("offset").cast("double")), by, "left")
    else:
        right = right.withColumn("offset", F.lit(0.0))
    carry = [*(c for c in keep if c not in run), "t"]
    own = LatentSource(left, (0, int(ends["z"] - ends["a"] + 1)), width=TILE, scores=left, loadings=right, k=len(ks), runs=bool(run))
    if run:  # products know their time point; the run comes along as one of its fields
        own = replace(own, scores=left.withColumn("t", F.struct("run_id", "t")))
    made = own._made(None, carry).select(*carry, F.explode(F.arrays_zip("feats", "values")).alias("x")).select(*carry, (F.col("x.feats") + (ends["a"] - 1)).cast(loadings.schema["v"].dataType).alias("v"), F.col("x.values").alias("value"))
    return made.select("t.run_id", "t.t", "v", "value") if run else made.select(*keep, "t", "v", "value")


def component_info(scores: DataFrame, loadings: DataFrame) -> DataFrame:
    """Of each component: variance of its scores, length and sparsity of its loadings."""
    a = scores.groupBy("k").agg(F.var_samp("score").alias("score_variance"))
    b = loadings.groupBy("k").agg(F.sqrt(F.sum(F.col("loading") * F.col("loading"))).alias("norm"), (1 - F.sum((F.col("loading") != 0).cast("int")) / F.count(F.lit(1))).alias("sparsity"))
    return a.join(b, "k", "full")


def project(data: DataFrame, loadings: DataFrame, max_components: int = 1_000) -> DataFrame:
    """(t, k, score): least-squares scores of data (t, v, value); the k by k system is solved on the driver, for at most ``max_components``."""
    import numpy as np

    if (n := loadings.select("k").distinct().count()) > max_components:
        raise ValueError(f"{n} components are more than {max_components}")

    gram = loadings.alias("a").join(loadings.alias("b"), "v").groupBy(F.col("a.k").alias("k"), F.col("b.k").alias("l")).agg(F.sum(F.col("a.loading") * F.col("b.loading")).alias("g")).collect()
    ks = sorted({r["k"] for r in gram})
    at = {k: i for i, k in enumerate(ks)}
    g = np.zeros((len(ks), len(ks)))
    for r in gram:
        g[at[r["k"]], at[r["l"]]] = r["g"]
    inverse = np.linalg.inv(g)
    solve = data.sparkSession.createDataFrame([(k, m, float(inverse[at[k], at[m]])) for k in ks for m in ks], "k long, m long, w double")
    raw = data.join(loadings, "v").groupBy("t", "k").agg(F.sum(F.col("value") * F.col("loading")).alias("x"))
    return raw.join(F.broadcast(solve), "k").groupBy("t", F.col("m").alias("k")).agg(F.sum(F.col("x") * F.col("w")).alias("score"))
