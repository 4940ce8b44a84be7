"""Joins of points with ranges, by equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_ranges(points: DataFrame, at: str, ranges: DataFrame, before: str, end: str) -> DataFrame:
    """Points with every range they lie in, ``before`` < point <= ``end``; columns of both.

    The stretch from the first range to the last is cut into about four equal
    parts a range. A range goes to the parts that it touches, a point to its
    own, and both meet by an equi-join on the part, where a range join without
    equality would try every pair. One pass over the ranges finds the stretch.
    """
    ends = ranges.agg(F.min(before).alias("a"), F.max(end).alias("z"), F.count(F.lit(1)).alias("n")).first()
    low = float(ends["a"] or 0)
    size = max(1.0, (float(ends["z"] or 0) - low) / (4 * ends["n"] + 1))
    part = lambda c: F.floor((F.col(c).cast("double") - low) / size)  # noqa: E731  never falls as values grow
    spread = ranges.where(F.col(before) < F.col(end)).withColumn("__part", F.explode(F.sequence(part(before), part(end))))
    inside = (F.col(at) > F.col(before)) & (F.col(at) <= F.col(end))
    return points.withColumn("__part", part(at)).join(spread, "__part").where(inside).drop("__part")
