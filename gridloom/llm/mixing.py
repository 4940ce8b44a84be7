"""Mixing sources to target weights by proportionate-fair scheduling.

A source's rows are cut into blocks of ``block_rows``. With weight w, its i-th
block (from 1) is released at floor((i-1)/w) and due at ceil(i/w), counted in
blocks of the whole mix. Each slot goes to the released block that is due
first. As the weights sum to 1, every block meets its window, so that at any
time a source has had less than one block more or less than its share.

Weights are taken as they are: as whole numbers in their exact ratio. The
schedule has a line for each block. It is worked out on the driver, block by
block, and handed to Spark in parts of ``chunk`` blocks as one row for each
source in it. What passes there is bounded: a block has ``block_rows`` rows, or
as many as make at most ``max_blocks`` blocks of all rows, so that the driver's
work is the same for any larger input; the guarantee is in blocks and does not
change. Rows get their slots by a join on (source, block).

A ``period`` makes the mix repeat. Weights are then whole units of that many
slots, by largest remainders, one unit at least; what the mix holds to is those
units, which are the weights themselves where these are whole in them.
At the end of a period every source has had exactly its units, so block
c * units + j of a source has the slot of its block j, c periods later. The
driver works out one period, as long for any number of rows; the slots and
windows of all blocks follow from it in Spark, and blocks keep ``block_rows``
rows at any size. This is the way for large tables: unlike the exact schedule,
it costs the driver nothing as they grow.

Ranks within a source are not taken by one window over the source, which may
hold a third of all rows: rows are dealt by a hash of all their columns to
salts of about ``salt_rows`` rows in all, 64 at least, ranked within (source,
salt) by a hash of the id, and shifted by the counts of the salts before.

Defined cases: null sources form one source of their own; rows whose id is null
or repeats are dealt by their other columns, and rows alike in all columns are
interchangeable; an empty table gives an empty result; input columns with a
result's name are replaced by mix() and returned as they were by interleaved().
No row is dropped: once the first source has run out, the blocks left keep
their windows but not the weights, so ``in_mix`` is true before that. In a mix
that repeats they keep their slots as well, and those of a source that has run
out stay empty.
"""

from __future__ import annotations

import heapq
import math
import uuid
from array import array
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .common import fresh, shared_dir

_SOURCE = "__source"
ADDED = ("block", "slot", "release", "due", "place", "in_mix")


def edf_slots(units: Mapping[str, int], blocks: Mapping[str, int]) -> Iterator[tuple[str, int, int, int, int, bool]]:
    """(source, block, slot, release, due, in_mix) of all ``blocks``, in order of their slots; weights are units over their sum."""
    total = sum(units.values())
    release = lambda s, i: i * total // units[s]
    waiting = [(0, s, 0) for s in sorted(blocks)]  # by release
    ready: list[tuple[int, str, int, int]] = []  # by deadline
    t, in_mix = 0, True
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            r, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // units[s]), s, i, r))
        due, s, i, r = heapq.heappop(ready)
        if i == blocks[s]:  # its turn, and nothing left
            in_mix = False
            continue
        if t >= due:
            raise AssertionError("a block missed its deadline")
        yield s, i, t, r, due, in_mix
        heapq.heappush(waiting, (release(s, i + 1), s, i + 1))
        t += 1


def edf_period(units: Mapping[str, int]) -> Iterator[tuple[str, int]]:
    """(source, place from 0 among its blocks) of every slot of one period."""
    return ((s, i) for s, i, *_ in edf_slots(units, units))


def exact_units(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in the exact ratio of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if exact and min(exact.values()) <= 0:
        raise ValueError("weights must be positive")
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def weight_units(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole units, at least 1 each, that sum to ``period``, by largest remainders."""
    total = float(sum(weights.values()))
    if total <= 0 or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    period = max(period, len(weights))
    exact = {s: w / total * period for s, w in weights.items()}
    units = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    while (short := period - sum(units.values())) > 0:
        for s in order[:short]:
            units[s] += 1
    while sum(units.values()) > period:
        units[max(units, key=lambda s: (units[s], s))] -= 1
    return units


def _key(source: str) -> Column:
    """A key for every source; the null source's is no other's."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def source_counts(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy(_key(source).alias(_SOURCE)).agg(F.count(F.lit(1)).alias("rows"))


def _schedule(spark: SparkSession, units: Mapping[str, int], blocks: Mapping[str, int], chunk: int) -> DataFrame:
    """Every block's slot; beyond one part of ``chunk`` blocks, parts are written to the shared folder as they are made."""
    lines = edf_slots(units, blocks)
    schema = f"{_SOURCE} string, first long, slots array<long>, releases array<long>, dues array<long>, n_mix int"

    def part() -> DataFrame:
        rows: dict[str, list] = {}
        for s, i, slot, release, due, in_mix in islice(lines, chunk):
            row = rows.setdefault(s, [i, [], [], [], 0])
            for to, x in zip(row[1:4], (slot, release, due), strict=True):
                to.append(x)
            row[4] += in_mix
        return spark.createDataFrame([(s, *row) for s, row in rows.items()], schema)

    n = sum(blocks.values())
    if n <= chunk:
        found = part()
    else:
        base = f"{shared_dir(spark)}/gridloom-slots-{uuid.uuid4().hex}"
        for _ in range(-(-n // chunk)):
            part().write.mode("append").parquet(base)
        found = spark.read.schema(schema).parquet(base)
    each = found.select(_SOURCE, "first", "n_mix", F.posexplode(F.arrays_zip("slots", "releases", "dues")).alias("k", "x"))
    out = each.select(_SOURCE, (F.col("first") + F.col("k")).alias("block"), F.col("x.slots").alias("slot"), F.col("x.releases").alias("release"), F.col("x.dues").alias("due"), (F.col("k") < F.col("n_mix")).alias("in_mix"))
    return F.broadcast(out) if n <= chunk else out


def _repeated(blocks: DataFrame, source: str, units: Mapping[str, int], counts: Mapping[str, int], block_rows: int) -> DataFrame:
    """Blocks with their slots, windows and ``in_mix``, all from the slots of one period, which are broadcast: a row for each source, with the slots of its units as an array."""
    at: dict[str, array] = {s: array("q") for s in units}
    for t, (s, _) in enumerate(edf_period(units)):
        at[s].append(t)
    cycle = sum(units.values())
    missing = {s: divmod(-(-n // block_rows), units[s]) for s, n in counts.items()}  # each source's first block that isn't there
    end = min((c * cycle + at[s][j] for s, (c, j) in missing.items()), default=0)
    unit, slots = (fresh(x, blocks.columns) for x in ("units", "slots"))
    period = blocks.sparkSession.createDataFrame([(s, units[s], x.tolist()) for s, x in at.items()], f"{source} string, {unit} long, {slots} array<long>")
    return (
        blocks.join(F.broadcast(period), source)
        .withColumn("slot", F.expr(f"block div {unit} * {cycle} + {slots}[int(block % {unit})]"))
        .withColumn("release", F.expr(f"block * {cycle} div {unit}"))
        .withColumn("due", F.expr(f"((block + 1) * {cycle} + {unit} - 1) div {unit}"))
        .withColumn("in_mix", F.col("slot") < end)
        .drop(unit, slots)
    )


def hash_of_all(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed, by which mix() deals rows to salts."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not f.dataType.simpleString().count("map<") and not isinstance(f.dataType, T.VariantType)]
    return F.xxhash64(*plain)


def mix(
    df: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    source: str = "source",
    row_id: str = "doc_id",
    block_rows: int = 16,
    max_blocks: int = 1_000_000,
    period: int | None = None,
    temperature: float = 0.5,
    salt_rows: int = 20_000,
    max_sources: int = 100_000,
    chunk: int = 250_000,
    deal_by: Column | None = None,
) -> DataFrame:
    """Add ``block`` (from 0, within the source), ``slot``, ``release``, ``due``, ``place`` (within the block) and ``in_mix``.

    Without ``weights``, a source's weight is its row count to the power
    ``temperature``; sources that ``weights`` doesn't name get its least weight.
    More than ``max_sources`` sources is an error, as their weights are held on
    the driver. A ``period`` makes the mix repeat; ``max_blocks`` and ``chunk``
    are for exact schedules. ``deal_by`` is a whole number by which rows go to salts; without
    it, it is a hash of all columns.
    """
    spark = df.sparkSession
    counts = {r[_SOURCE]: r["rows"] for r in source_counts(df, source).limit(max_sources + 1).collect()}
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    if weights is None:
        w = {s: n**temperature for s, n in counts.items()}
    else:
        named = {("" if s is None else f"={s}"): v for s, v in weights.items()}
        w = {s: named.get(s, min(named.values())) for s in counts}
    total = sum(counts.values())
    if period is None:
        block_rows = max(block_rows, -(-total // max(1, max_blocks - len(counts))))

    src, salt, tie, rank, before = (fresh(x, df.columns) for x in ("source", "salt", "tie", "rank", "before"))
    salts = max(64, -(-total // salt_rows))
    deal = hash_of_all(df) if deal_by is None else deal_by
    rows = df.withColumns({src: _key(source), tie: deal}).withColumn(salt, F.pmod(tie, F.lit(salts))).drop(*ADDED)
    running = Window.partitionBy(src).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    shifts = rows.groupBy(src, salt).agg(F.count(F.lit(1)).alias("n")).select(src, salt, F.coalesce(F.sum("n").over(running), F.lit(0)).alias(before))
    number = F.row_number().over(Window.partitionBy(src, salt).orderBy(F.xxhash64(row_id, F.lit(1)), row_id, tie)) - 1
    ranked = rows.withColumn(rank, number.cast("long")).join(shifts, [src, salt]).withColumn(rank, F.col(rank) + F.col(before))
    blocks = ranked.withColumns({"block": F.floor(F.col(rank) / block_rows).cast("long"), "place": (F.col(rank) % block_rows).cast("int")})
    if period is None or not w:
        slots = _schedule(spark, exact_units(w), {s: -(-n // block_rows) for s, n in counts.items()}, chunk)
        placed = blocks.join(slots.withColumnRenamed(_SOURCE, src), [src, "block"])
    else:
        placed = _repeated(blocks, src, weight_units(w, period), counts, block_rows)
    return placed.drop(src, salt, tie, rank, before)


def interleaved(df: DataFrame, source: str = "source", row_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df``, same columns, in the order of the mix: by slot, then place. Slots are those that mix() gives the same rows."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    packed = df.select(F.col(source).alias("__from"), F.col(row_id).alias("__id"), hash_of_all(df).alias("__deal"), row.alias("__row"))
    mixed = mix(packed, source="__from", row_id="__id", deal_by=F.col("__deal"), **options)
    return mixed.repartitionByRange("slot").sortWithinPartitions("slot", "place").select("__row.*")
