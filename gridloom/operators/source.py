"""Lazy arrays of observations by features.

An array is a table of row pieces: (obs_idx, chunk, values), with obs_idx from 1
and values the cells of one chunk of ``width`` features. The long form (obs_idx,
feat_idx, value) is made where cells are joined. Selections are lazy; a read
keeps the order and the duplicates of what was asked for.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranges import in_ranges
from ..functions.scalar import DTYPES, canonical_digest, dtype_bytes

WIDTH = 4096
BROADCAST_POSITIONS = 100_000
CAPABILITIES = frozenset({"block_slice", "serializable"})


@dataclass(frozen=True)
class ArraySource:
    pieces: DataFrame  # obs_idx long, chunk int, values array<double>
    shape: tuple[int, int]
    dtype: str = "float64"
    width: int = WIDTH
    capabilities: frozenset[str] = CAPABILITIES
    fingerprint: str = ""
    shards: DataFrame | None = field(default=None, compare=False)  # shard_id, start, end, n_observation, ...
    parts: tuple[tuple[int, int, DataFrame], ...] = field(default=(), compare=False)  # first and last row, and pieces, of each shard
    native: DataFrame | None = field(default=None, compare=False)  # obs_idx, values: whole images, over all cells of the space's grid
    filters: bool = False  # whether what reads the pieces takes filters on obs_idx

    def descriptor(self) -> dict[str, object]:
        return {"shape": list(self.shape), "dtype": self.dtype, "chunks": [1, min(self.width, max(1, self.shape[1]))], "capabilities": sorted(self.capabilities), "fingerprint": self.fingerprint}

    def validate(self) -> ArraySource:
        n, m = self.shape
        if n < 0 or m < 0 or self.dtype not in DTYPES or self.width < 1 or not CAPABILITIES <= self.capabilities or not self.fingerprint:
            raise ValueError(f"invalid source {self.descriptor()}")
        return self

    def holding(self, rows: Sequence[int]) -> ArraySource:
        """The same array without the shards that hold none of ``rows``: their branches leave the plan, and nothing of them is read."""
        wanted = sorted(set(rows))
        if self.filters and wanted:
            some = F.col("obs_idx").isin(wanted) if len(wanted) <= 1000 else F.col("obs_idx").between(wanted[0], wanted[-1])
            return replace(self, pieces=self.pieces.where(some), native=None if self.native is None else self.native.where(some))
        if not self.parts:
            return self
        at = lambda i: bisect_left(wanted, i)
        kept = tuple(p for p in self.parts if at(p[0]) < at(p[1] + 1))
        pieces = None
        for _, _, own in kept:
            pieces = own if pieces is None else pieces.unionByName(own)
        return replace(self, pieces=self.pieces.where(F.lit(False)) if pieces is None else pieces, parts=kept)

    def meeting(self, rows: DataFrame) -> ArraySource:
        """The observations in ``rows`` (obs_idx, and columns that the pieces then carry), numbered as before."""
        return replace(self, pieces=self.pieces.join(rows, "obs_idx", "inner" if len(rows.columns) > 1 else "left_semi"))

    def long(self, features: Sequence[int] | None = None, carry: Sequence[str] = ()) -> DataFrame:
        """(obs_idx, feat_idx, value) and columns of the pieces to carry; asked features are cut out of the arrays before any cell is made."""
        if features is None:
            cells = self.pieces.select("obs_idx", *carry, "chunk", F.posexplode("values").alias("p", "value"))
            return cells.select("obs_idx", *carry, (F.col("chunk") * self.width + F.col("p") + 1).cast("int").alias("feat_idx"), "value")
        wanted = sorted(set(features))
        chunks = sorted({(f - 1) // self.width for f in wanted})
        pick = F.array(*[F.struct(F.lit(f).alias("feat_idx"), ((f - 1) // self.width == F.col("chunk")).alias("here"), F.try_element_at("values", F.lit((f - 1) % self.width + 1)).alias("value")) for f in wanted])
        if not wanted:
            return self.long(carry=carry).where(F.lit(False))
        return self.pieces.where(F.col("chunk").isin(chunks)).select("obs_idx", *carry, F.explode(pick).alias("x")).where("x.here").select("obs_idx", *carry, "x.feat_idx", "x.value")

    def view(self, observations: Sequence[int] | None = None, features: Sequence[int] | None = None) -> ArraySource:
        """Composed lazily: a view of a view is one join on each axis."""
        spark, (n, m) = self.pieces.sparkSession, self.shape
        rows = None if observations is None else checked(observations, n)
        pieces = (self if rows is None else self.holding(rows)).pieces
        if rows is not None:
            pieces = pieces.join(_positions(spark, rows, "obs_idx"), "obs_idx").select(F.col("pos").alias("obs_idx"), "chunk", "values")
            n = len(rows)
        if features is not None:
            asked = checked(features, m)
            pieces = picked(whole_rows(replace(self, pieces=pieces)), asked).select("obs_idx", F.lit(0).alias("chunk"), "values")
            m = len(asked)
        gone = set() if features is None else {"native_read"}
        return replace(self, pieces=pieces, shape=(n, m), width=self.width if features is None else max(1, m), capabilities=self.capabilities - gone, shards=None, parts=(), native=None, filters=False, fingerprint=canonical_digest([self.fingerprint, list(observations or []), list(features or [])]))

    def read(self, observations: Sequence[int] | None = None, features: Sequence[int] | None = None) -> DataFrame:
        """(obs_pos, feat_pos, obs_idx, feat_idx, value), positions in the order asked for, duplicates kept."""
        spark = self.pieces.sparkSession
        asked = None if observations is None else checked(observations, self.shape[0])
        held = self if asked is None else self.holding(asked)
        cells = held.long(None if features is None else checked(features, self.shape[1]))
        rows = None if asked is None else _positions(spark, asked, "obs_idx", "obs_pos")
        cols = _positions(spark, checked(features, self.shape[1]), "feat_idx", "feat_pos") if features is not None else None
        cells = cells.join(rows, "obs_idx") if rows is not None else cells.withColumn("obs_pos", F.col("obs_idx"))
        cells = cells.join(cols, "feat_idx") if cols is not None else cells.withColumn("feat_pos", F.col("feat_idx").cast("long"))
        return cells.select("obs_pos", "feat_pos", "obs_idx", "feat_idx", "value")


def whole_rows(source: ArraySource, carry: Sequence[str] = ()) -> DataFrame:
    """(obs_idx, values) with all features of an observation in one array; a shuffle where there are several chunks."""
    if source.shape[1] <= source.width:
        return source.pieces.select("obs_idx", *carry, "values")
    return source.pieces.groupBy("obs_idx", *carry).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "values"))), lambda x: x["values"])).alias("values"))


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row, which is broadcast."""
    return df.withColumn("__one", F.lit(0)).join(F.broadcast(one.withColumn("__one", F.lit(0))), "__one").drop("__one")


def picked(rows: DataFrame, positions: Sequence[int | None], name: str = "values") -> DataFrame:
    """Rows whose array ``name`` is gathered by position, in the order given, inside the row; a position that is None gives null."""
    at = rows.sparkSession.createDataFrame([(list(positions),)], "__at array<int>")
    return with_row(rows, at).withColumn(name, F.transform("__at", lambda p: F.element_at(name, p))).drop("__at")


def checked(index: Sequence[int] | Sequence[bool], n: int) -> list[int]:
    """1-based positions; a logical index must be as long as the axis."""
    index = list(index)
    if index and all(isinstance(i, bool) for i in index):
        if len(index) != n:
            raise IndexError(f"a logical index needs {n} elements")
        return [i + 1 for i, keep in enumerate(index) if keep]
    if any(i is None or isinstance(i, bool) or int(i) != i or not 1 <= i <= n for i in index):
        raise IndexError(f"positions must be whole numbers from 1 to {n}")
    return [int(i) for i in index]


def _positions(spark: SparkSession, index: Sequence[int], name: str, pos: str = "pos") -> DataFrame:
    """A table of positions that the caller holds, to be broadcast up to ``BROADCAST_POSITIONS`` of them."""
    df = spark.createDataFrame([(int(i), p) for p, i in enumerate(index, 1)], f"{name} long, {pos} long")
    return F.broadcast(df) if len(index) <= BROADCAST_POSITIONS else df


def from_arrays(df: DataFrame, obs_idx: Column | str, values: Column | str, shape: tuple[int, int], name: str, dtype: str = "float64", width: int = WIDTH) -> ArraySource:
    """A source over a table that has one array of all features for each observation."""
    v = (F.col(values) if isinstance(values, str) else values).cast("array<double>")
    i = (F.col(obs_idx) if isinstance(obs_idx, str) else obs_idx).cast("long")
    if shape[1] <= width:
        pieces = df.select(i.alias("obs_idx"), F.lit(0).alias("chunk"), v.alias("values"))
    else:
        cut = F.transform(F.sequence(F.lit(0), F.lit(-(-shape[1] // width) - 1)), lambda c: F.struct(c.alias("chunk"), F.slice(v, c * width + 1, F.lit(width)).alias("values")))
        pieces = df.select(i.alias("obs_idx"), F.explode(cut).alias("x")).select("obs_idx", "x.chunk", "x.values")
    return ArraySource(pieces, shape, dtype, width, fingerprint=canonical_digest([name, list(shape), dtype])).validate()


def memory_source(spark: SparkSession, rows: Sequence[Sequence[float | None]], dtype: str = "float64", width: int = WIDTH) -> ArraySource:
    """A source over a small matrix that the caller holds."""
    data = [[None if x is None else float(x) for x in r] for r in rows]
    m = len(data[0]) if data else 0
    if any(len(r) != m for r in data):
        raise ValueError("rows differ in length")
    df = spark.createDataFrame([(i, r) for i, r in enumerate(data, 1)], "i long, v array<double>")
    source = from_arrays(df, "i", "v", (len(data), m), "memory", dtype, width)
    return replace(source, fingerprint=canonical_digest([data, dtype]))


def row_sharded(sources: Sequence[ArraySource], shard_ids: Sequence[str] | None = None, shard_data: dict[str, Sequence[object]] | None = None) -> ArraySource:
    """Sources one below the other; each shard stays a branch of the plan, and a read of rows leaves out the branches that hold none of them."""
    if not sources:
        raise ValueError("no sources")
    ids = list(shard_ids or (f"shard-{i}" for i in range(1, len(sources) + 1)))
    if len(set(ids)) != len(sources):
        raise ValueError("shard ids must be unique, one for each source")
    first = sources[0]
    if any(s.shape[1] != first.shape[1] or s.dtype != first.dtype or s.width != first.width for s in sources):
        raise ValueError("shards must agree in features, element type and chunk width")
    if any(s.shape[0] == 0 for s in sources):
        raise ValueError("a shard has no rows")
    rows, start, pieces, parts = [], 1, None, []
    for k, (s, i) in enumerate(zip(sources, ids, strict=True)):
        end = start + s.shape[0] - 1
        own = s.pieces.select((F.col("obs_idx") + (start - 1)).alias("obs_idx"), "chunk", "values")
        pieces = own if pieces is None else pieces.unionByName(own)
        parts.append((start, end, own))
        rows.append((i, start, end, s.shape[0], s.fingerprint, *[v[k] for v in (shard_data or {}).values()]))
        start = end + 1
    names = ["shard_id", "start", "end", "n_observation", "source_fingerprint", *(shard_data or {})]
    manifest = first.pieces.sparkSession.createDataFrame(rows, names)
    return ArraySource(pieces, (start - 1, first.shape[1]), first.dtype, first.width, fingerprint=canonical_digest([ids, [s.fingerprint for s in sources]]), shards=manifest, parts=tuple(parts))


def append_shards(x: ArraySource, sources: Sequence[ArraySource], shard_ids: Sequence[str]) -> ArraySource:
    """A new source with further shards; ``x`` stays as it is."""
    if x.shards is None:
        raise ValueError("not a sharded source")
    more = row_sharded(sources, shard_ids)
    if more.shape[1] != x.shape[1] or more.width != x.width:
        raise ValueError("shards must agree in features and chunk width")
    held = x.shards.join(more.shards, "shard_id", "left_semi").count()
    if held or set(x.shards.columns) != set(more.shards.columns):
        raise ValueError("shard ids or columns clash")
    n = x.shape[0]
    shifted = more.shards.withColumns({"start": F.col("start") + n, "end": F.col("end") + n})
    pieces = x.pieces.unionByName(more.pieces.withColumn("obs_idx", F.col("obs_idx") + n))
    return replace(x, pieces=pieces, shape=(n + more.shape[0], x.shape[1]), shards=x.shards.unionByName(shifted), parts=(*x.parts, *((a + n, z + n, own.withColumn("obs_idx", F.col("obs_idx") + n)) for a, z, own in more.parts)), fingerprint=canonical_digest([x.fingerprint, more.fingerprint]))


def manifest_of(df: DataFrame, shard: str, order: Sequence[str] = ()) -> DataFrame:
    """Ranges that shards of a table take when laid one after the other: shard_id, start, end, n_observation."""
    from pyspark.sql import Window

    counts = df.groupBy(F.col(shard).alias("shard_id")).agg(F.count(F.lit(1)).alias("n_observation"))
    end = F.sum("n_observation").over(Window.orderBy(*(order or ("shard_id",))))
    return counts.withColumn("end", end).withColumn("start", F.col("end") - F.col("n_observation") + 1).select("shard_id", "start", "end", "n_observation")


def locate_rows(manifest: DataFrame, asked: DataFrame, row: str = "obs_idx") -> DataFrame:
    """Shard and local row of each global row asked for, duplicates kept. The manifest has a row a shard."""
    found = in_ranges(asked, row, manifest.withColumn("__before", F.col("start") - 1), "__before", "end").drop("__before")
    return found.withColumn("local", F.col(row) - F.col("start") + 1)


def as_source(spark: SparkSession, x: object, **options) -> ArraySource:
    """A source of whatever holds an array: a source, a matrix that the caller holds, or a table (obs_idx, values)."""
    if isinstance(x, ArraySource):
        return x.validate()
    if isinstance(x, DataFrame):
        n = x.agg(F.max("obs_idx").alias("n"), F.max(F.size("values")).alias("m")).first()
        return from_arrays(x, "obs_idx", "values", (int(n["n"] or 0), int(n["m"] or 0)), options.pop("name", "table"), **options)
    return memory_source(spark, [list(r) for r in x], **options)


class Counts:
    """What a counted source has read, added up by the tasks that read it: rows, values and bytes; tasks that are repeated count again."""

    def __init__(self, spark: SparkSession, dtype: str) -> None:
        self._spark, self._bytes = spark, dtype_bytes(dtype)
        self.reset()

    def reset(self) -> None:
        self._rows, self._values, self._stored = (self._spark.sparkContext.accumulator(0) for _ in range(3))

    @property
    def rows(self) -> int:
        return self._rows.value

    @property
    def values(self) -> int:
        return self._values.value

    @property
    def bytes(self) -> int:
        return self.values * self._bytes

    @property
    def stored(self) -> int:
        """Bytes of files read, of sources that count them."""
        return self._stored.value


def counting(source: ArraySource) -> tuple[ArraySource, Counts]:
    """``source`` with counts of what is read of it, to show that a plan reads nothing or leaves shards out."""
    counts = Counts(source.pieces.sparkSession, source.dtype)
    rows, values = counts._rows, counts._values

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows.add(b.num_rows)
            values.add(len(b.column("values").flatten()))
            yield b

    return replace(source, pieces=source.pieces.mapInArrow(through, source.pieces.schema)), counts


def faulty(source: ArraySource, message: str = "injected failure") -> ArraySource:
    """``source`` whose every read fails in the task; its descriptor can be asked as before."""
    fail = F.raise_error(F.lit(message)).cast("array<double>")
    return replace(source, pieces=source.pieces.withColumn("values", F.when(F.col("obs_idx").isNotNull(), fail).otherwise(F.col("values"))))
