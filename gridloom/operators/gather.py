"""Gathers: rows of an array by a table of positions, sparse rows, and subjects over their common support."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import canonical_digest
from .feature_map import FeatureMap
from .source import ArraySource, picked, row_sharded, whole_rows


def row_gather(source: ArraySource, rows: DataFrame, n: int) -> ArraySource:
    """The array whose row ``pos`` is row ``row`` of ``source``; a null ``row`` gives nulls.

    ``rows`` is (pos from 1 to n, row). Each row that is asked for is read once,
    however often it occurs; a row that ``source`` lacks is an error that the
    task meeting it raises.
    """
    rows = rows.select(F.col("pos").cast("long").alias("pos"), F.col("row").cast("long").alias("row"))
    held = source.meeting(rows.where("row is not null").select(F.col("row").alias("obs_idx")).distinct()).pieces
    chunks = max(1, -(-source.shape[1] // source.width))
    size = F.least(F.lit(source.width), F.lit(source.shape[1]) - F.col("chunk") * source.width).cast("int")
    every = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    met = every.join(held.withColumnRenamed("obs_idx", "row"), ["row", "chunk"], "left")
    none = F.array_repeat(F.lit(None).cast("double"), size)
    lacking = F.col("row").isNotNull() & F.col("values").isNull()
    values = F.when(lacking, F.raise_error(F.lit("a row to gather is not in the array")).cast("array<double>")).otherwise(F.coalesce("values", none))
    pieces = met.select(F.col("pos").alias("obs_idx"), "chunk", values.alias("values"))
    return replace(source, pieces=pieces, shape=(n, source.shape[1]), shards=None, parts=(), native=None, filters=False, fingerprint=canonical_digest([source.fingerprint, "gathered", n]))


@dataclass(frozen=True)
class SparseSource:
    """Rows of which only some features are held: (obs_idx, indices, values), indices ascending from 1.

    An absent value is 0; a row whose ``indices`` are null is all null. Rows
    without any value may be absent.
    """

    rows: DataFrame
    shape: tuple[int, int]

    def view(self, observations: Sequence[int] | None = None, features: Sequence[int] | None = None) -> SparseSource:
        """Rows and features selected, each once, in the order given."""
        spark, out = self.rows.sparkSession, self
        if observations is not None:
            at = spark.createDataFrame([(r, p) for p, r in enumerate(observations, 1)], "obs_idx long, __pos long")
            out = SparseSource(out.rows.join(at, "obs_idx").select(F.col("__pos").alias("obs_idx"), "indices", "values"), (len(list(observations)), self.shape[1]))
        if features is not None:
            asked = list(features)
            if len(set(asked)) != len(asked):
                raise ValueError("features of a sparse view are each taken once")
            place = {f: p for p, f in enumerate(asked, 1)}
            at = spark.createDataFrame([([place.get(i) for i in range(1, self.shape[1] + 1)],)], "__at array<int>")
            moved = F.transform(F.arrays_zip("indices", "values"), lambda x: F.struct(F.element_at("__at", x["indices"]).alias("i"), x["values"].alias("v")))
            kept = F.array_sort(F.filter(moved, lambda x: x["i"].isNotNull()))
            df = out.rows.withColumn("__one", F.lit(0)).join(F.broadcast(at.withColumn("__one", F.lit(0))), "__one").select("obs_idx", kept.alias("e"))
            out = SparseSource(df.select("obs_idx", F.col("e.i").alias("indices"), F.col("e.v").alias("values")), (out.shape[0], len(asked)))
        return out

    def lift(self, rows: DataFrame, n: int) -> SparseSource:
        """The sparse rows that ``rows`` (pos, row) stand for: a null ``row`` is all null, a row that is held nowhere is all 0."""
        rows = rows.select(F.col("pos").cast("long").alias("pos"), F.col("row").cast("long").alias("row"))
        met = rows.join(self.rows.withColumnRenamed("obs_idx", "row"), "row", "left")
        known = F.col("row").isNotNull() & F.col("indices").isNull() & F.col("values").isNull()
        empty = lambda t: F.array().cast(f"array<{t}>")
        return SparseSource(met.select(F.col("pos").alias("obs_idx"), F.when(known, empty("int")).otherwise(F.col("indices")).alias("indices"), F.when(known, empty("double")).otherwise(F.col("values")).alias("values")), (n, self.shape[1]))

    def map(self, m: FeatureMap) -> SparseSource:
        """Values mapped to the target space, still sparse: only what a held value reaches."""
        w = m.operator.where("w <> 0").select(F.col("source").alias("i"), "target", "w")
        cells = self.rows.where("indices is not null").select("obs_idx", F.explode(F.arrays_zip("indices", "values")).alias("x")).select("obs_idx", F.col("x.indices").alias("i"), F.col("x.values").alias("v"))
        reached = cells.join(w, "i").groupBy("obs_idx", "target").agg(F.when(F.count("v") == F.count(F.lit(1)), F.sum(F.col("v") * F.col("w"))).alias("v"))
        packed = reached.groupBy("obs_idx").agg(F.sort_array(F.collect_list(F.struct(F.col("target").cast("int").alias("i"), "v"))).alias("e"))
        found = packed.select("obs_idx", F.col("e.i").alias("indices"), F.col("e.v").alias("values"))
        return SparseSource(found.unionByName(self.rows.where("indices is null")), (self.shape[0], m.target.n_features))

    def long(self) -> DataFrame:
        """(obs_idx, feat_idx, value) of what is held."""
        return self.rows.select("obs_idx", F.explode(F.arrays_zip("indices", "values")).alias("x")).select("obs_idx", F.col("x.indices").alias("feat_idx"), F.col("x.values").alias("value"))

    def dense(self) -> ArraySource:
        """All values, absent ones as 0; rows that are absent too."""
        n, m = self.shape
        every = self.rows.sparkSession.range(1, n + 1).withColumnRenamed("id", "obs_idx").join(self.rows.withColumn("__held", F.lit(True)), "obs_idx", "left")
        by = F.map_from_arrays("indices", "values")
        value = F.transform(F.sequence(F.lit(1), F.lit(m)), lambda f: F.when(F.map_contains_key("__by", f), F.element_at("__by", f)).otherwise(F.lit(0.0)))
        null = F.col("__held") & F.col("indices").isNull()
        made = every.withColumn("__by", F.coalesce(by, F.create_map().cast("map<int,double>"))).select("obs_idx", F.lit(0).alias("chunk"), F.when(null, F.array_repeat(F.lit(None).cast("double"), m)).otherwise(value).alias("values"))
        return ArraySource(made, (n, m), "float64", max(1, m), fingerprint=canonical_digest(["sparse", n, m]))


def sparse_source(cells: DataFrame, shape: tuple[int, int]) -> SparseSource:
    """From (obs_idx, feat_idx, value); zeros are not held, and a cell that repeats is an error of the task that meets it."""
    held = cells.where("value is null or value <> 0").select(F.col("obs_idx").cast("long").alias("obs_idx"), F.struct(F.col("feat_idx").cast("int").alias("i"), F.col("value").cast("double").alias("v")).alias("x"))
    e = held.groupBy("obs_idx").agg(F.sort_array(F.collect_list("x")).alias("e"))
    once = F.when(F.size(F.array_distinct("e.i")) < F.size("e"), F.raise_error(F.lit("a cell repeats")).cast("array<int>")).otherwise(F.col("e.i"))
    return SparseSource(e.select("obs_idx", once.alias("indices"), F.col("e.v").alias("values")), shape)


def common_support(subjects: Sequence[tuple[ArraySource, Sequence[int]]], subject_ids: Sequence[str] | None = None, strict: str = "identical", volume: int | None = None, least_overlap: float = 0.95) -> tuple[ArraySource, list[int]]:
    """Subjects one below the other over the voxels that all of them have, and these voxels.

    Each subject is an array and the voxel of each of its features. "identical"
    needs equal supports; "intersect" that each shares at least
    ``least_overlap`` with the first's, of the ``volume`` where it is given, of
    the first's support otherwise. Arrays are gathered by position inside their
    rows, whatever the order of their voxels.
    """
    if strict not in ("identical", "intersect"):
        raise ValueError("strict is identical or intersect")
    supports = [list(s) for _, s in subjects]
    for (source, _), s in zip(subjects, supports, strict=True):
        if len(set(s)) != len(s) or len(s) != source.shape[1]:
            raise ValueError("a support has a voxel of its own for each feature")
    first = set(supports[0])
    if strict == "identical" and any(set(s) != first for s in supports):
        raise ValueError("supports differ")
    common = sorted(first.intersection(*map(set, supports)))
    of = volume or max(1, len(first))
    if strict == "intersect" and (not common or any(len(first & set(s)) / of < least_overlap for s in supports)):
        raise ValueError("supports overlap too little")
    gathered = []
    for (source, _), s in zip(subjects, supports, strict=True):
        at = {v: i for i, v in enumerate(s, 1)}
        rows = whole_rows(source) if s == common else picked(whole_rows(source), [at[v] for v in common])
        gathered.append(ArraySource(rows.select("obs_idx", F.lit(0).alias("chunk"), "values"), (source.shape[0], len(common)), source.dtype, max(1, len(common)), fingerprint=canonical_digest([source.fingerprint, common])))
    return row_sharded(gathered, subject_ids), common
