"""Positions from 1 in a global order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written


def ordinals(df: DataFrame, order: Sequence[str], name: str = "ord", carry: Sequence[str] = ()) -> DataFrame:
    """(order columns, carried columns, ``name``): each row's position when sorted by ``order``.

    Rows are dealt by ranges, written once with the number of their range, then
    numbered within the range and shifted by the counts of the ranges before.
    """
    columns = list(dict.fromkeys([*order, *carry]))
    dealt = written(df.select(*columns).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = (
        dealt.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    )
    number = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn(name, number).join(before, "__part").withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__part", "__before")
