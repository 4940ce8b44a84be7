"""Linear maps between feature spaces.

An operator is a table (target, source, w); absent entries are 0. Only entries
that are not zero contribute; a null among them makes the target null. An
operator of at most ``ROW_ENTRIES`` entries (16 MB) is cut by the arrays'
chunks and broadcast, a row a chunk: every piece is mapped within its row to
the targets that its chunk has entries for. Arrays of one chunk are done then;
of others an observation's few parts are added up. Larger operators map by a
join on the source feature and a sum by target. With targets named, only
columns that contribute are cut out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import canonical_digest, propagating_sum
from .source import ArraySource, whole_rows, with_row
from .spaces import BasisSpace, ParcelSpace, Space

BROADCAST_ROWS = 1_000_000
ROW_ENTRIES = 1_000_000
RULES = ("linear", "independent_variance")


@dataclass(frozen=True)
class FeatureMap:
    source: Space
    target: Space
    operator: DataFrame = field(compare=False)
    kind: str = "linear"

    def digest(self) -> str:
        return canonical_digest([self.source.digest, self.target.digest, self.kind])

    def validate(self) -> FeatureMap:
        bad = self.operator.where((F.col("target") < 1) | (F.col("target") > self.target.n_features) | (F.col("source") < 1) | (F.col("source") > self.source.n_features) | F.col("w").isNull() | F.isnan("w"))
        if bad.limit(1).count() or self.operator.groupBy("target", "source").count().where("count > 1").limit(1).count():
            raise ValueError("the operator has entries outside the spaces, repeated or without a weight")
        return self


def map_to(target: Space, spark) -> FeatureMap:
    """The map that a parcel or basis space brings along."""
    if not isinstance(target, (ParcelSpace, BasisSpace)):
        raise TypeError("only parcels and bases have a map of their own")
    return FeatureMap(target.parent, target, target.encoder(spark), "parcel" if isinstance(target, ParcelSpace) else "basis")


def apply_map(cells: DataFrame, operator: DataFrame, rule: str = "linear", keys: Sequence[str] = ("obs_idx",), feature: str = "feat_idx") -> DataFrame:
    """(keys, feat_idx, value) in the target space of long cells (keys, feat_idx, value)."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    w = operator.where("w <> 0").select(F.col("source").alias(feature), F.col("target").alias("__target"), (F.col("w") * F.col("w") if rule == RULES[1] else F.col("w")).alias("__w"))
    if w.count() <= BROADCAST_ROWS:
        w = F.broadcast(w)
    return cells.join(w, feature).groupBy(*keys, "__target").agg(propagating_sum(F.col("value"), F.col("__w")).alias("value")).withColumnRenamed("__target", feature)


def _placed(m: FeatureMap, rule: str, columns: Sequence[int] | None) -> DataFrame:
    """(target, at, w) of entries that are not zero, ``at`` the position of the source feature in the array."""
    w = F.col("w") * F.col("w") if rule == RULES[1] else F.col("w")
    entries = m.operator.where("w <> 0").select("target", F.col("source").alias("at"), w.alias("w"))
    if columns is None:
        return entries
    at = m.operator.sparkSession.createDataFrame(list(enumerate(columns, 1)), "at int, __to int")
    return entries.join(at, "at").select("target", F.col("__to").alias("at"), "w")


def map_rows(source: ArraySource, m: FeatureMap, rule: str = "linear", columns: Sequence[int] | None = None) -> DataFrame:
    """(obs_idx, values) with a value for each target; a target without entries is 0, one that a null enters is null.

    ``columns`` are the positions in the array of the map's source features, in
    their order; without them, the array's columns are those features.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    entries = _placed(m, rule, columns)
    none = m.operator.sparkSession.range(1, m.target.n_features + 1).select(F.col("id").cast("int").alias("target")).join(entries, "target", "left_anti")
    if m.operator.count() > ROW_ENTRIES:
        return _by_cells(source, entries, none)
    chunk = F.floor((F.col("at") - 1) / source.width).cast("int")
    per_target = entries.groupBy(chunk.alias("chunk"), "target").agg(F.sort_array(F.collect_list(F.struct(((F.col("at") - 1) % source.width + 1).cast("int").alias("s"), "w"))).alias("e"))
    # targets without entries are 0 in the first chunk, so that every observation has each target
    every = per_target.unionByName(none.select(F.lit(0).alias("chunk"), "target", F.array().cast("array<struct<s:int,w:double>>").alias("e")))
    ops = every.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("target", "e"))).alias("__ops"))
    value = lambda t: F.aggregate(t["e"], F.lit(0.0), lambda total, x: total + F.element_at("values", x["s"]) * x["w"])
    pieces = source.pieces.join(F.broadcast(ops), "chunk")
    if source.shape[1] <= source.width:
        return pieces.select("obs_idx", F.transform("__ops", value).alias("values"))
    part = F.transform("__ops", lambda t: F.struct(t["target"].alias("target"), value(t).alias("value")))
    # dealt by observation once; both sums follow that
    parts = pieces.select("obs_idx", F.explode(part).alias("x")).select("obs_idx", "x.target", "x.value").repartition("obs_idx")
    return _gathered(parts.groupBy("obs_idx", "target").agg(propagating_sum(F.col("value")).alias("value")))


def _gathered(cells: DataFrame) -> DataFrame:
    """(obs_idx, values) of (obs_idx, target, value) with every target."""
    return cells.groupBy("obs_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("target", "value"))), lambda x: x["value"]).alias("values"))


def _by_cells(source: ArraySource, entries: DataFrame, none: DataFrame) -> DataFrame:
    """Rows of an operator too large to broadcast."""
    cells = source.long().join(entries.withColumnRenamed("at", "feat_idx"), "feat_idx").groupBy("obs_idx", "target").agg(propagating_sum(F.col("value"), F.col("w")).alias("value"))
    zeros = none.agg(F.collect_list("target").alias("t"))
    empty = source.pieces.where("chunk = 0").select("obs_idx").join(F.broadcast(zeros), F.lit(True)).select("obs_idx", F.explode("t").alias("target"), F.lit(0.0).alias("value"))
    return _gathered(cells.unionByName(empty))


def mapped(source: ArraySource, m: FeatureMap, rule: str = "linear", targets: Sequence[int] | None = None) -> DataFrame:
    """(obs_idx, feat_idx, value) of targets that have entries; with ``targets``, only columns that these need are read."""
    if targets is None:
        rows = map_rows(source, m, rule)
        have = m.operator.where("w <> 0").select(F.col("target").cast("int").alias("feat_idx")).distinct()
        cells = rows.select("obs_idx", F.posexplode("values").alias("p", "value")).select("obs_idx", (F.col("p") + 1).cast("int").alias("feat_idx"), "value")
        n = have.count()
        if n == m.target.n_features:
            return cells
        return cells.join(F.broadcast(have) if n <= BROADCAST_ROWS else have, "feat_idx", "left_semi").select("obs_idx", "feat_idx", "value")
    op = m.operator.where(F.col("target").isin(list(targets)))
    needed = [r["source"] for r in op.where("w <> 0").select("source").distinct().collect()]
    return apply_map(source.long(needed), op, rule)


def regular_parcels(cells: DataFrame, size: int, aggregation: str = "mean") -> DataFrame:
    """Parcels of ``size`` consecutive features, straight from the cells."""
    parcel = (F.floor((F.col("feat_idx") - 1) / size) + 1).cast("int").alias("parcel")
    value = propagating_sum(F.col("value"))
    return cells.groupBy("obs_idx", parcel).agg((value / F.count(F.lit(1)) if aggregation == "mean" else value).alias("value"))


def median(values: Column) -> Column:
    """Of an array; null if any value is."""
    n = F.size(values)
    at = lambda s, k: F.element_at(s, k.cast("int"))
    middle = F.transform(F.array(F.array_sort(values)), lambda s: (at(s, F.floor((n + 1) / 2)) + at(s, F.floor(n / 2) + 1)) / 2)
    return F.when(~F.exists(values, lambda x: x.isNull()), F.element_at(middle, 1))


def trimmed_mean(share: float) -> Callable[[Column], Column]:
    """The mean without the lowest and highest ``share`` of the values, rounded down; null if any value is."""

    def of(values: Column) -> Column:
        n = F.size(values)
        cut = F.floor(n * share).cast("int")
        kept = F.slice(F.array_sort(values), cut + 1, n - 2 * cut)
        return F.when(~F.exists(values, lambda x: x.isNull()), F.aggregate(kept, F.lit(0.0), lambda t, x: t + x) / (n - 2 * cut))

    return of


def parcel_summary(source: ArraySource, parcels: ParcelSpace, summary: Callable[[Column], Column] = median) -> DataFrame:
    """(obs_idx, values) with any summary of each parcel's members, as a function of the array of their values, inside the row.

    Members are those with a positive weight, in order; weights play no part. A
    row with several chunks is put together first, as a summary needs all members at once.
    """
    spark = source.pieces.sparkSession
    members = parcels.members(spark).where("w > 0").groupBy("target").agg(F.sort_array(F.collect_list(F.col("source").cast("int"))).alias("m"))
    every = members.agg(F.transform(F.sort_array(F.collect_list(F.struct("target", "m"))), lambda x: x["m"]).alias("__members"))
    values = F.transform("__members", lambda m: summary(F.transform(m, lambda p: F.element_at("values", p))))
    return with_row(whole_rows(source), every).select("obs_idx", values.alias("values"))
