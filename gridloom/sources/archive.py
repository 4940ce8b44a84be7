"""A study's scans as Parquet tables, compressed to parcels or to scores of a template.

assay (by subject, task, run): scan_name, timepoint, feature, value
scan_index: scan_name, subject, task, session, run, n_time, time_offset, has_events, has_confounds
events, confounds, censor: by scan_name
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.latent import pca
from ..operators.series import project, reconstruct_latent
from ..operators.source import ArraySource

NAMES = ("subject", "session", "task", "run")


@dataclass(frozen=True)
class Archive:
    assay: DataFrame
    scan_index: DataFrame
    events: DataFrame
    confounds: DataFrame
    censor: DataFrame

    def subset(self, **wanted: list[str]) -> Archive:
        """Scans whose subject, session, task and run are among those wanted; partitions of others are not read."""
        if odd := set(wanted) - set(NAMES):
            raise ValueError(f"unknown {sorted(odd)}")
        keep = lambda df: _where(df, wanted)
        index = keep(self.scan_index)
        scans = F.broadcast(index.select("scan_name"))
        own = lambda df: df.join(scans, "scan_name", "left_semi")
        return Archive(keep(self.assay), index, own(self.events), own(self.confounds), own(self.censor))

    def distinct(self, name: str) -> DataFrame:
        """Values of a name, in order; none when all are missing."""
        return self.scan_index.where(F.col(name).isNotNull()).select(name).distinct().orderBy(name)

    def reconstruct(self, loadings: DataFrame, offset: DataFrame | None = None) -> DataFrame:
        """Voxels of an archive of scores: (run_id, t, v, value), run_id the scan; loadings with a run_id are the scan's own, else shared."""
        scores = self.assay.select(F.col("scan_name").alias("run_id"), F.col("timepoint").alias("t"), F.col("feature").alias("k"), F.col("value").alias("score"))
        return reconstruct_latent(scores, loadings, offset)


def _where(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    for c, values in wanted.items():
        df = df.where(F.col(c).isin(list(values)))
    return df


def scan_names(files: DataFrame, names: Sequence[str] = NAMES) -> DataFrame:
    """The scans of a table of files or rows: its distinct names."""
    return files.select(*names).distinct()


def scan_index(scans: DataFrame, cells: DataFrame, events: DataFrame, confounds: DataFrame) -> DataFrame:
    """One row a scan, in order of name, with where its time points begin among all."""
    length = cells.groupBy("scan_name").agg(F.max("timepoint").cast("int").alias("n_time"), F.countDistinct("feature").cast("int").alias("n_features"))
    has = lambda df, c: df.select("scan_name").distinct().withColumn(c, F.lit(True))
    before = F.coalesce(F.sum("n_time").over(Window.orderBy("scan_name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = scans.join(length, "scan_name").join(has(events, "has_events"), "scan_name", "left").join(has(confounds, "has_confounds"), "scan_name", "left")
    return out.withColumn("time_offset", before).fillna(False, ["has_events", "has_confounds"])


def parcel_cells(cells: DataFrame, parcels: DataFrame) -> DataFrame:
    """Means of voxels by parcel: cells (scan_name, timepoint, voxel, value), parcels (voxel, feature)."""
    return cells.join(parcels, "voxel").groupBy("scan_name", "timepoint", "feature").agg(F.avg("value").alias("value"))


def template_cells(cells: DataFrame, loadings: DataFrame) -> DataFrame:
    """Least-squares scores on a template's loadings (v, k, loading), scan by time point."""
    at = cells.select(F.struct("scan_name", "timepoint").alias("t"), F.col("voxel").alias("v"), "value")
    return project(at, loadings).select("t.scan_name", "t.timepoint", F.col("k").alias("feature"), F.col("score").alias("value"))


def write(cells: DataFrame, scans: DataFrame, events: DataFrame, confounds: DataFrame, path: str, censor: DataFrame | None = None) -> None:
    """Write an archive; the assay is laid out by subject, task and run. Without ``censor`` no time point is censored."""
    points = cells.select("scan_name", "timepoint").distinct()
    flags = points.withColumn("censor", F.lit(0)) if censor is None else points.join(censor, ["scan_name", "timepoint"], "left").fillna(0, ["censor"])
    cells.join(scans, "scan_name").write.partitionBy("subject", "task", "run").parquet(f"{path}/assay")
    scan_index(scans, cells, events, confounds).write.parquet(f"{path}/scan_index")
    for name, df in (("events", events), ("confounds", confounds), ("censor", flags)):
        df.write.parquet(f"{path}/{name}")


def write_components(sources: Mapping[str, ArraySource], k: int, scans: DataFrame, events: DataFrame, confounds: DataFrame, path: str, censor: DataFrame | None = None) -> None:
    """An archive of each scan's scores on its own ``k`` leading components, with the loadings and offsets that give it back.

    ``sources`` has the array of each scan by its name. Loadings (run_id, v, k,
    loading) and offsets (run_id, v, offset) are kept beside the archive.
    """
    cells = loadings = offsets = None
    for name, source in sources.items():
        found = pca(source, k)
        own = found.scores.select(F.lit(name).alias("scan_name"), F.col("obs_idx").cast("int").alias("timepoint"), F.posexplode("scores").alias("p", "value"))
        own = own.select("scan_name", "timepoint", (F.col("p") + 1).alias("feature"), "value")
        at = found.loadings.select(F.lit(name).alias("run_id"), F.col("feat_idx").alias("v"), "loadings", "offset")
        of = at.select("run_id", "v", F.posexplode("loadings").alias("p", "loading")).select("run_id", "v", (F.col("p") + 1).alias("k"), "loading")
        cells, loadings, offsets = (x if had is None else had.unionByName(x) for had, x in ((cells, own), (loadings, of), (offsets, at.drop("loadings"))))
    if cells is None:
        raise ValueError("no scan")
    write(cells, scans, events, confounds, path, censor)
    loadings.write.parquet(f"{path}/loadings")
    offsets.write.parquet(f"{path}/offsets")


def read_components(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Loadings and offsets of an archive of components, as Archive.reconstruct() takes them."""
    return spark.read.parquet(f"{path}/loadings"), spark.read.parquet(f"{path}/offsets")


def read(spark: SparkSession, path: str) -> Archive:
    names = {c: "string" for c in NAMES}
    assay = spark.read.parquet(f"{path}/assay")
    assay = assay.withColumns({c: F.col(c).cast(t) for c, t in names.items()})
    return Archive(assay, *[spark.read.parquet(f"{path}/{n}") for n in ("scan_index", "events", "confounds", "censor")])
