"""Plans of rectangular blocks, and functions run on each block by Spark."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalar import canonical_digest, dtype_bytes
from ..operators.source import ArraySource


class OverBudget(MemoryError):
    """What was asked for is larger than its budget."""


@dataclass(frozen=True)
class BlockPlan:
    shape: tuple[int, int]
    block: tuple[int, int]
    dtype: str
    layout: str
    fingerprint: str

    @property
    def counts(self) -> tuple[int, int]:
        return tuple(-(-n // b) if n else 0 for n, b in zip(self.shape, self.block, strict=True))  # type: ignore[return-value]

    def manifest(self, spark: SparkSession) -> DataFrame:
        """A row for each block: its ranges, cells and bytes; image-wise plans number observations fastest."""
        rows, cols = self.counts
        b = spark.range(1, rows * cols + 1).withColumnRenamed("id", "block_id")
        z = F.col("block_id") - 1
        r, c = (z % rows, F.floor(z / rows)) if self.layout == "imagewise" else (F.floor(z / cols), z % cols)
        if not rows * cols:
            r = c = F.lit(0)
        n = dtype_bytes(self.dtype)
        b = b.withColumns({"obs_start": (r * self.block[0] + 1).cast("long"), "feat_start": (c * self.block[1] + 1).cast("long")})
        b = b.withColumns({"obs_end": F.least(F.col("obs_start") + self.block[0] - 1, F.lit(self.shape[0])), "feat_end": F.least(F.col("feat_start") + self.block[1] - 1, F.lit(self.shape[1]))})
        cells = (F.col("obs_end") - F.col("obs_start") + 1) * (F.col("feat_end") - F.col("feat_start") + 1)
        return b.withColumn("cells", cells.cast("long")).withColumn("bytes", F.col("cells") * n)

    def block_of(self, obs: Column, feat: Column) -> Column:
        r, c = F.floor((obs - 1) / self.block[0]), F.floor((feat - 1) / self.block[1])
        rows, cols = self.counts
        return (c * rows + r if self.layout == "imagewise" else r * cols + c) + 1


def plan_blocks(shape: tuple[int, int], dtype: str = "float64", layout: str = "balanced", chunks: tuple[int, int] | None = None, budget: int = 512 << 20, target: int = 4 << 20, of: str = "") -> BlockPlan:
    """Blocks of at most floor(min(budget, target) / bytes of a cell) cells.

    imagewise: whole rows; featurewise: whole columns; balanced: the chunk's
    shape, whole multiples or parts of it, and as near its aspect as fits.
    """
    n, m = shape
    room = min(budget, target) // dtype_bytes(dtype)
    if layout == "imagewise":
        if m > room:
            raise OverBudget("one observation exceeds the budget")
        block = (max(1, min(n, room // max(1, m))), max(1, m))
    elif layout == "featurewise":
        if n > room:
            raise OverBudget("one feature exceeds the budget")
        block = (max(1, n), max(1, min(m, room // max(1, n))))
    elif layout == "balanced":
        if room < 1:
            raise OverBudget("one cell exceeds the budget")
        a, b = chunks or (max(1, n), max(1, m))
        scale = math.sqrt(room / (a * b))
        rows = max(1, min(n, int(a * scale)))
        cols = max(1, min(m, room // rows))
        rows = max(1, min(n, room // cols))
        block = (rows, cols)
    else:
        raise ValueError(f"unknown layout {layout}")
    return BlockPlan((n, m), block, dtype, layout, canonical_digest([of, n, m, list(block), layout]))


def execute(cells: DataFrame, plan: BlockPlan, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, fingerprint: str | None = None) -> DataFrame:
    """``f`` on the long cells (obs_idx, feat_idx, value) of each block. A plan made for something else is refused."""
    if fingerprint is not None and fingerprint != plan.fingerprint:
        raise ValueError("the plan was made for another selection")
    keyed = cells.withColumn("block_id", plan.block_of(F.col("obs_idx"), F.col("feat_idx")).cast("long"))
    return keyed.groupBy("block_id").applyInPandas(f, schema)


@dataclass(frozen=True)
class Block:
    """Values of a rectangle, NaN for null: a row for each of ``observations``, a column for each feature from ``first_feature`` on."""

    block_id: int
    observations: np.ndarray
    first_feature: int
    values: np.ndarray


def execute_arrays(source: ArraySource, plan: BlockPlan, f: Callable[[Block], pd.DataFrame], schema: str, fingerprint: str | None = None) -> DataFrame:
    """``f`` on each block of an array as a matrix.

    Arrays are cut at the blocks' bounds inside their rows, and what is shuffled
    is a slice of a row, not a row for each cell. A task holds a block at a time.
    """
    if fingerprint is not None and fingerprint != plan.fingerprint:
        raise ValueError("the plan was made for another selection")
    if source.shape != plan.shape:
        raise ValueError("the plan is of another shape")
    _, cols = plan.block
    before, size = F.col("chunk") * source.width, F.size("values")
    cut = source.pieces.where(size > 0).withColumn("__c", F.explode(F.sequence(F.floor(before / cols), F.floor((before + size - 1) / cols))))
    start = F.greatest(F.lit(0), F.col("__c") * cols - before).cast("int")
    end = F.least(size, (F.col("__c") + 1) * cols - before).cast("int")
    first = (before + start + 1).cast("int")
    slices = cut.select(plan.block_of(F.col("obs_idx"), first).cast("long").alias("block_id"), "obs_idx", first.alias("first"), F.slice("values", start + 1, end - start).alias("values"))
    out = to_arrow_schema(slices.sparkSession.createDataFrame([], schema).schema)

    def run(table: pa.Table) -> pa.Table:
        block, table = table.column("block_id")[0].as_py(), table.combine_chunks()
        obs, row = np.unique(table.column("obs_idx").to_numpy(), return_inverse=True)
        firsts, lists = table.column("first").to_numpy(), table.column("values").combine_chunks()
        low = int(firsts.min())
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        x = np.full((len(obs), int((firsts + n).max()) - low), np.nan)
        for at in np.unique(firsts):
            mine = np.flatnonzero(firsts == at)
            x[row[mine], at - low : at - low + n[mine[0]]] = lists.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1)
        return pa.Table.from_pandas(f(Block(block, obs, low, x)), schema=out, preserve_index=False)

    return slices.groupBy("block_id").applyInArrow(run, schema)


def block_apply(cells: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, block_size: int = 4096) -> DataFrame:
    """``f`` on all observations of ``block_size`` features at a time."""
    return cells.withColumn("block_id", F.floor((F.col("feat_idx") - 1) / block_size) + 1).groupBy("block_id").applyInPandas(f, schema)


def within_budget(n_cells: int, dtype: str, budget: int, force: bool = False) -> None:
    if n_cells * dtype_bytes(dtype) > budget and not force:
        raise OverBudget(f"{n_cells} cells exceed {budget} bytes")
