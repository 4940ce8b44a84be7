"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import shared_dir, written as cut

__all__ = ["cut", "file_system", "fresh", "held_out", "parts_of", "shared_dir", "shuffle_partitions", "shuffles_removed", "table", "tidied", "training_rows"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name, by whatever path Spark's reader can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """True for the fold that is never learned from: crc32(id as text) mod folds = 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int = 64_000_000) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled documents outside the held-out fold, of ``max_chars`` code points in all.

    The sample is the rows with the smallest xxhash64(doc_id), up to the row
    that would exceed ``max_chars``, so it is the same in every run and what a
    fit brings to the driver is bounded. A text of more than a sixteenth of
    ``max_chars`` is not learned from, so that no few texts use up the sample. Only its ids, at most ``max_rows`` of
    them, are broadcast; its texts are written to the shared folder once. Labels that contradict each other count as the larger
    one; null ids, null labels and repeated rows of an id are left out.
    """
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    sample = cut(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id"))
    # one window over max_rows short rows at most
    sizes = sample.groupBy("doc_id").agg(F.max(F.length("text")).alias("n")).limit(max_rows)
    sizes = sizes.where(F.col("n") <= max(1, max_chars // 16))
    kept = sizes.withColumn("sum", F.sum("n").over(order)).where(F.col("sum") <= max_chars).select("doc_id")
    return sample.join(F.broadcast(kept), "doc_id", "left_semi")


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that none of ``taken`` has, in whatever case."""
    known, out = {c.lower() for c in taken}, f"__{name}"
    while out.lower() in known:
        out += "_"
    return out


def parts_of(batches, rows: int = 500):
    """Arrow batches or arrays in parts of at most ``rows`` rows, which bounds what a worker holds beside its input.

    In the end, what Arrow keeps for later goes back to the system: a worker
    may wait for its next task beside others that need the memory.
    """
    try:
        for b in batches:
            for k in range(0, max(1, len(b)), rows):
                yield b.slice(k, rows)
    finally:
        pa.default_memory_pool().release_unused()


def tidied(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` on a task's batches; in the end, what Arrow keeps for later goes back to the system."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, what an execution was shuffled through goes as soon as it ends, rather than when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def file_system(uri: str):
    """(pyarrow file system, path) of a folder or file, whether local, HDFS or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))
