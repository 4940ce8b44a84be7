"""Which features are valid for whom: deduplicated masks and a table that assigns them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import canonical_digest, pack_bits
from .source import ArraySource

BROADCAST_FLAGS = 8_000_000


@dataclass(frozen=True)
class Validity:
    """``masks``: (mask_id, feat_idx, valid), whole; ``assigned``: (entity_id, mask_id)."""

    masks: DataFrame
    assigned: DataFrame
    entity: str = "entity"

    def n_masks(self) -> int:
        return self.masks.select("mask_id").distinct().count()

    def matrix(self) -> DataFrame:
        """(entity_id, feat_idx, valid)."""
        return self.assigned.join(self.masks, "mask_id").select("entity_id", "feat_idx", "valid")

    def coverage(self) -> DataFrame:
        """Share of entities for which each feature is valid, from how often each mask is used."""
        used = self.assigned.groupBy("mask_id").agg(F.count(F.lit(1)).alias("n"))
        return _share(self.masks.join(used, "mask_id"))

    def observation_coverage(self, observations: DataFrame, entity_id: str) -> DataFrame:
        used = self.of_observations(observations, entity_id).groupBy("mask_id").agg(F.count(F.lit(1)).alias("n"))
        return _share(self.masks.join(used, "mask_id"))

    def of_observations(self, observations: DataFrame, entity_id: str) -> DataFrame:
        """Observations with their mask_id; one that resolves to no mask is an error, raised when it is read."""
        a = self.assigned.select(F.col("entity_id").alias(entity_id), "mask_id")
        found = observations.join(a, entity_id, "left")
        return found.withColumn("mask_id", F.when(F.col("mask_id").isNull(), F.raise_error(F.lit("an observation has no mask"))).otherwise(F.col("mask_id")))

    def packed(self, width: int) -> DataFrame:
        """(mask_id, chunk, flags): each mask's flags by chunks of ``width`` features, in order."""
        chunk = F.floor((F.col("feat_idx") - 1) / width).cast("int").alias("chunk")
        return self.masks.groupBy("mask_id", chunk).agg(F.transform(F.sort_array(F.collect_list(F.struct("feat_idx", "valid"))), lambda x: x["valid"]).alias("flags"))

    def masked_source(self, source: ArraySource, observations: DataFrame, entity_id: str) -> ArraySource:
        """``source`` with null where its observation's mask is not valid.

        ``observations``: (obs_idx, entity_id). Every observation meets its
        mask once, and each piece its flags, which are applied by position
        inside the row: no cell is moved.
        """
        of = self.of_observations(observations, entity_id).select("obs_idx", "mask_id")
        flags = self.packed(source.width)
        if self.masks.limit(BROADCAST_FLAGS + 1).count() <= BROADCAST_FLAGS:
            flags = F.broadcast(flags)
        pieces = source.pieces.join(of, "obs_idx").join(flags, ["mask_id", "chunk"])
        kept = F.zip_with("values", "flags", lambda v, ok: F.when(ok, v))
        return ArraySource(pieces.select("obs_idx", "chunk", kept.alias("values")), source.shape, "float64", source.width, fingerprint=canonical_digest([source.fingerprint, "masked", self.entity]))

    def masked(self, cells: DataFrame, observations: DataFrame, entity_id: str) -> DataFrame:
        """Long cells whose invalid values are null; arrays are masked by masked_source(), without moving cells."""
        of = self.of_observations(observations, entity_id).select("obs_idx", "mask_id")
        bad = self.masks.where(~F.col("valid")).select("mask_id", "feat_idx", F.lit(True).alias("__bad"))
        joined = cells.join(of, "obs_idx").join(bad, ["mask_id", "feat_idx"], "left")
        return joined.select("obs_idx", "feat_idx", F.when(F.col("__bad").isNull(), F.col("value")).alias("value"))


def _share(df: DataFrame) -> DataFrame:
    return df.groupBy("feat_idx").agg((F.sum(F.col("valid").cast("int") * F.col("n")) / F.sum("n")).alias("coverage"))


def from_flags(spark: SparkSession, flags: Mapping[str, Sequence[bool]], entity: str = "entity") -> Validity:
    """From a few masks that the caller holds; equal ones are kept once."""
    ids, masks, assigned = {}, [], []
    for e, f in flags.items():
        bits = pack_bits(f)
        if bits not in ids:
            ids[bits] = f"mask-{canonical_digest([bits.hex(), len(f)])}"
            masks += [(ids[bits], i, bool(v)) for i, v in enumerate(f, 1)]
        assigned.append((e, ids[bits]))
    return Validity(spark.createDataFrame(masks, "mask_id string, feat_idx int, valid boolean"), spark.createDataFrame(assigned, "entity_id string, mask_id string"), entity)


def from_long(df: DataFrame, entity: str = "entity") -> Validity:
    """From (entity_id, feat_idx, valid): one array of flags an entity, deduplicated by the whole SHA-256 of the flags."""
    per = df.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("feat_idx", "valid"))).alias("f"))
    pattern = F.concat_ws("", F.transform("f", lambda x: x["valid"].cast("int").cast("string")))
    known = per.select("entity_id", "f", F.concat(F.lit("mask-"), F.sha2(pattern, 256)).alias("mask_id"))
    masks = known.dropDuplicates(["mask_id"]).select("mask_id", F.explode("f").alias("x")).select("mask_id", "x.feat_idx", "x.valid")
    return Validity(masks, known.select("entity_id", "mask_id"), entity)


def combined(df: DataFrame, strict: str | None = None, reference: str | None = None, least_overlap: float = 0.95) -> DataFrame:
    """(feat_idx, valid): valid for all, of (entity_id, feat_idx, valid).

    ``strict`` "identical" needs masks equal to the reference's, "intersect"
    that each shares at least ``least_overlap`` of all features with it, valid
    in both; else the task that compares them raises an error. The reference is
    the smallest entity unless named.
    """
    if strict not in (None, "identical", "intersect"):
        raise ValueError("strict is identical or intersect")
    both = df.groupBy("feat_idx").agg(F.bool_and("valid").alias("valid"))
    if strict is None:
        return both
    first = F.lit(reference) if reference is not None else F.lit(df.agg(F.min("entity_id")).first()[0])
    ref = df.where(F.col("entity_id") == first).select("feat_idx", F.col("valid").alias("__ref"))
    share = F.avg((F.col("valid") & F.col("__ref")).cast("double")) if strict == "intersect" else F.avg((F.col("valid") == F.col("__ref")).cast("double"))
    least = df.join(ref, "feat_idx").groupBy("entity_id").agg(share.alias("s")).agg(F.min("s").alias("s"))
    bad = F.coalesce(F.col("s"), F.lit(1.0)) < (least_overlap if strict == "intersect" else 1.0)
    told = least.select(F.when(bad, F.raise_error(F.lit("masks differ" if strict == "identical" else "masks overlap too little"))).otherwise(F.lit(True)).alias("__ok"))
    return both.withColumn("__ok", F.lit(True)).join(F.broadcast(told), "__ok").select("feat_idx", "valid")
