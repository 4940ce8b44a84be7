"""Axes: tables with a unique identifier for each row, and aligned blocks of several columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordinal import ordinals
from ..functions.storage import written


class InvalidAxis(ValueError):
    """An axis whose identifiers are missing, empty or repeated."""


@dataclass(frozen=True)
class Block:
    """A matrix aligned with an axis: (id, component_id, value), and a table of its components."""

    cells: DataFrame
    components: DataFrame
    role: str = "continuous"
    units: str | None = None


@dataclass(frozen=True)
class Axis:
    """``table`` has ``id`` (string, unique) and ``idx`` (long, from 1), then any columns."""

    table: DataFrame
    id: str
    blocks: Mapping[str, Block] = field(default_factory=dict)

    def ids(self) -> DataFrame:
        return self.table.select(self.id)

    def count(self) -> int:
        return self.table.count()

    def where(self, keep: DataFrame) -> Axis:
        """Rows whose id ``keep`` has; blocks follow lazily."""
        ids = keep.select(self.id)
        blocks = {n: replace(b, cells=b.cells.join(ids.withColumnRenamed(self.id, "id"), "id", "left_semi")) for n, b in self.blocks.items()}
        return replace(self, table=self.table.join(ids, self.id, "left_semi"), blocks=blocks)


def key_problems(df: DataFrame, key: str) -> tuple[int, int]:
    """Rows without a key, and keys that more than one row has: one pass with partial sums."""
    per = df.groupBy(F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    bad = F.col("k").isNull() | (F.col("k") == "")
    r = per.agg(F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("empty"), F.coalesce(F.sum(F.when(~bad & (F.col("n") > 1), 1)), F.lit(0)).alias("repeated")).first()
    return int(r["empty"]), int(r["repeated"])


def axis(df: DataFrame, id: str | None = None, order: Sequence[str] = (), blocks: Mapping[str, Block] | None = None, prefix: str = "id", check: bool = True, idx: str | None = None) -> Axis:
    """An axis over ``df``. Without ``id``, identifiers are made; without ``idx``, rows are numbered by ``order`` (or id)."""
    if id is None:
        id = f"{prefix}_id"
        df = written(df.withColumn(id, F.concat(F.lit(f"{prefix}-"), F.uuid())))  # made once: a plan that ran again would make others
    df = df.withColumn(id, F.col(id).cast("string"))
    if check:
        empty, repeated = key_problems(df, id)
        if empty or repeated:
            raise InvalidAxis(f"{empty} rows without {id}, {repeated} repeated")
    if idx:
        table = df.withColumn("idx", F.col(idx).cast("long"))
    else:
        order = list(order or (id,))
        table = df.join(ordinals(df, [*order, *([id] if id not in order else [])], "idx").select(id, "idx"), id)
    return Axis(table, id, dict(blocks or {}))


def block(wide: DataFrame, id: str, components: Sequence[str], **options) -> Block:
    """A block from a table with a column for each component."""
    cells = wide.select(F.col(id).cast("string").alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("component_id"), F.col(c).cast("double").alias("value")) for c in components])).alias("x")).select("id", "x.*")
    table = wide.sparkSession.createDataFrame([(c, i) for i, c in enumerate(components, 1)], "component_id string, idx int")
    return Block(cells, table, **options)


def negative(table: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """All rows but those named."""
    return table.join(gone.select(on), on, "left_anti")
