"""Bounded iteration: chunks of features or runs, made by Spark and fetched one at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dataset import Dataset


@dataclass(frozen=True)
class Chunk:
    number: int
    cells: pd.DataFrame  # obs_idx, feat_idx, value


def chunk_of(feature: Column, n_features: int, n_chunks: int) -> Column:
    """Chunk from 1 of each feature: numbers go round in runs of round(n / chunks) features, then are sorted, so that chunks are contiguous.

    After q whole rounds, r features are left: the first chunks take a run more
    of them, one takes what is left of a run, the others have q runs.
    """
    size = max(1, int(n_features / n_chunks + 0.5))
    q, r = divmod(n_features, size * n_chunks)
    longer, rest = divmod(r, size)
    long = (q + 1) * size
    middle = longer * long + q * size + rest
    ceil = lambda c, n: F.ceil(c / F.lit(n)) if n else F.lit(0)
    number = F.when(feature <= longer * long, ceil(feature, long)).when(feature <= middle, F.lit(longer + 1)).otherwise(F.lit(longer + 1) + ceil(feature - middle, q * size))
    return number.cast("int")


def chunks(cells: DataFrame, number: Column, n_chunks: int | None = None) -> Iterator[Chunk]:
    """Chunks in order, one in memory at a time.

    Cells are dealt by chunk once, in stretches of chunk numbers, and each
    partition is streamed: its chunks come as one row each. ``n_chunks`` is the
    largest number; without it, one more pass finds it.
    """
    numbered = cells.select("obs_idx", F.col("feat_idx").cast("int").alias("feat_idx"), F.col("value").cast("double").alias("value"), number.cast("int").alias("__chunk"))
    last = n_chunks or numbered.agg(F.max("__chunk")).first()[0]
    if last is None:
        return
    parts = min(int(last), max(1, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = numbered.repartitionById(parts, F.floor((F.col("__chunk") - 1) * parts / last).cast("int")).sortWithinPartitions("__chunk", "feat_idx", "obs_idx")
    for row in dealt.mapInArrow(_packed, "number int, obs array<long>, feat array<int>, value array<double>").toLocalIterator():
        yield Chunk(row["number"], pd.DataFrame({"obs_idx": row["obs"], "feat_idx": row["feat"], "value": row["value"]}))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, as a row for each chunk; a task holds one chunk and one batch."""
    held, number = [], None

    def row() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        lists = [pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole.column(c).combine_chunks()) for c in ("obs_idx", "feat_idx", "value")]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *lists], names=["number", "obs", "feat", "value"])

    for b in batches:
        at = b.column("__chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if held and int(at[i]) != number:
                yield row()
                held = []
            number = int(at[i])
            held.append(b.slice(i, j - i))
    if held:
        yield row()


def runwise(cells: DataFrame, runs: DataFrame, n_runs: int | None = None) -> Iterator[Chunk]:
    """A chunk for each run; ``runs`` has obs_idx and blockid, a number from 1."""
    return chunks(cells.join(runs.select("obs_idx", "blockid"), "obs_idx"), F.col("blockid"), n_runs)


def strategy(name: str, n_chunks: int | None = None) -> Callable[[Dataset], Iterator[Chunk]]:
    """How a dataset is gone through: voxelwise (a chunk a feature), runwise, or chunkwise in ``n_chunks``, as many as features at most."""
    if name not in ("voxelwise", "runwise", "chunkwise") or name == "chunkwise" and not n_chunks:
        raise ValueError("voxelwise, runwise, or chunkwise with a number of chunks")

    def go(d: Dataset) -> Iterator[Chunk]:
        if name == "runwise":
            return runwise(d.source.long(), d.times().withColumn("blockid", F.col("run_id")), len(d.run_lengths))
        n = d.source.shape[1]
        k = n if name == "voxelwise" else min(n, n_chunks)
        return chunks(d.source.long(), chunk_of(F.col("feat_idx"), n, k), k)

    return go
