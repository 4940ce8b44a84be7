"""Subjects: one row each, with verbs that filter, extend, join, sample, map and fold them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordinal import ordinals
from .axis import InvalidAxis, key_problems


def validated(subjects: DataFrame, id: str) -> DataFrame:
    empty, repeated = key_problems(subjects, id)
    if empty or repeated:
        raise InvalidAxis(f"{empty} subjects without {id}, {repeated} repeated")
    return subjects


def strict(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which ``predicate`` is true; a null predicate is an error, raised by the task that meets it."""
    told = F.when(predicate.isNull(), F.raise_error(F.lit("a predicate is null"))).otherwise(predicate)
    return df.where(told)


def filter_subjects(subjects: DataFrame, *predicates: Column) -> DataFrame:
    every = F.lit(True)
    for p in predicates:
        every = every & F.when(p.isNull(), F.raise_error(F.lit("a predicate is null"))).otherwise(p)
    return subjects.where(every)


def mutate_subjects(subjects: DataFrame, **columns: Column) -> DataFrame:
    """Columns one after the other, so that later ones see earlier ones."""
    for name, c in columns.items():
        subjects = subjects.withColumn(name, c)
    return subjects


def left_join_subjects(subjects: DataFrame, other: DataFrame, id: str, by: Sequence[str] | None = None) -> DataFrame:
    """Keys: those given, else the columns in common, but the id alone if it isn't one of them. Rows multiply as matches do."""
    if by is None:
        common = [c for c in subjects.columns if c in other.columns]
        by = common if id in common else [id]
    return subjects.join(other, list(by), "left")


def sample_subjects(subjects: DataFrame, n: int | Mapping[str, int], seed: int, strata: str | None = None, id: str = "subject_id", replace: bool = False) -> DataFrame:
    """Exactly ``n`` rows, or as many of each stratum; with replacement, drawn as ranks modulo the stratum's size.

    More rows than there are is an error without replacement; so is any row of none with it.
    """
    key = F.xxhash64(F.col(id), F.lit(seed))
    group = [strata] if strata else []
    counts = {r[0] if strata else None: r["n"] for r in subjects.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = dict.fromkeys(counts or [None], n) if isinstance(n, int) else dict(n)
    if short := {s: k for s, k in asked.items() if k > (counts.get(s, 0) if not replace else k * counts.get(s, 0))}:
        raise ValueError(f"more rows are asked for than there are: {short}")
    if not replace and not strata:
        return subjects.orderBy(key, id).limit(int(n))
    spark = subjects.sparkSession
    kind = subjects.schema[strata].dataType.simpleString() if strata else "string"
    wanted = spark.createDataFrame(list(asked.items()), f"__s {kind}, __d int")
    if not strata:
        ranked = subjects.join(ordinals(subjects.select(id, key.alias("__k")), ["__k", id], "__r").select(id, "__r"), id).withColumn("__s", F.lit(None).cast("string"))
    else:
        # numbered by ranges over all strata, then from each stratum's first, so that a large stratum is many tasks
        placed = ordinals(subjects.select(F.col(strata).alias("__s"), F.col(id).alias("__id"), key.alias("__k")), ["__s", "__k", "__id"], "__g")
        first = placed.groupBy(F.col("__s").alias("__t")).agg((F.min("__g") - 1).alias("__before"))
        number = placed.join(first, F.col("__s").eqNullSafe(F.col("__t"))).select("__id", (F.col("__g") - F.col("__before")).alias("__r"))
        ranked = subjects.withColumn("__s", F.col(strata)).join(number, F.col(id) == F.col("__id")).drop("__id")
    same = F.col("a.__s").eqNullSafe(F.col("b.__s"))
    if not replace:
        return ranked.alias("a").join(F.broadcast(wanted).alias("b"), same & (F.col("__r") <= F.col("__d"))).select("a.*").drop("__r", "__s")
    sizes = spark.createDataFrame(list(counts.items()), f"__s {kind}, __n long").alias("a").join(wanted.alias("b"), same).select("a.__s", "__n", "__d")
    draws = sizes.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__d")))).select("__s", (F.pmod(F.xxhash64("__i", F.lit(seed)), F.col("__n")) + 1).alias("__r"))
    return ranked.alias("a").join(draws.alias("b"), same & (F.col("a.__r") == F.col("b.__r"))).select("a.*").drop("__r", "__s")


def iterate(subjects: DataFrame, order_by: str | None = None, prefetch: bool = False) -> Iterator[Row]:
    """Rows one partition at a time; nulls of ``order_by`` come last."""
    return (subjects.orderBy(F.asc_nulls_last(order_by)) if order_by else subjects).toLocalIterator(prefetchPartitions=prefetch)


def _unused(name: str, taken: Iterable[str]) -> str:
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def _restored(piece: pd.DataFrame, nulls: np.ndarray, of: Sequence[tuple[str, bool]]) -> pd.DataFrame:
    """The nulls of whole numbers and booleans, which Spark filled: as pandas has them, by columns that hold any."""
    for k in np.flatnonzero(nulls.any(axis=0)):
        name, truth = of[k]
        piece[name] = piece[name].astype(object if truth else "float64").mask(nulls[:, k], None if truth else np.nan)
    return piece


def _stretches(batches: Iterable[pd.DataFrame], names: Sequence[str], first: str, flags: Sequence[str], of: Sequence[tuple[str, bool]]) -> Iterator[pd.DataFrame]:
    """The rows of each subject, which follow each other, from the row that ``first`` marks; a subject may span batches."""

    def whole(parts: list[tuple[pd.DataFrame, np.ndarray]]) -> pd.DataFrame:
        frames, nulls = zip(*parts, strict=True)
        piece = frames[0].reset_index(drop=True) if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        return _restored(piece, np.concatenate(nulls), of) if any(n.any() for n in nulls) else piece

    parts: list[tuple[pd.DataFrame, np.ndarray]] = []
    for batch in batches:
        marks, nulls, rows = batch[first].to_numpy(), batch[list(flags)].to_numpy(bool), batch[list(names)]
        cut = lambda a, b: (rows.iloc[a:b], nulls[a:b])  # noqa: B023, E731
        cuts = [*np.flatnonzero(marks), len(batch)]
        if cuts[0]:
            parts.append(cut(0, cuts[0]))
        for a, b in pairwise(cuts):
            if parts:
                yield whole(parts)
            parts = [cut(a, b)]
    if parts:
        yield whole(parts)


def _together(frames: Iterable[pd.DataFrame], rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """Frames of the same columns and types that follow each other, in frames of about ``rows`` rows."""
    held, n, kind = [], 0, None
    for x in frames:
        now = (list(x.columns), list(x.dtypes))
        if held and (n >= rows or now != kind):
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
        held.append(x)
        n, kind = n + len(x), now
    if held:
        yield pd.concat(held, ignore_index=True)


def group_map(rows: DataFrame, id: str, f: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, on_error: str = "stop") -> DataFrame:
    """``f`` on the rows of each subject; None gives no rows. on_error: stop, or skip the subject.

    Subjects pass to Python and back in batches of many, as most have few rows;
    a subject's rows are together in memory, as ``f`` asks for them.
    """
    if on_error not in ("stop", "skip", "warn"):
        raise ValueError("on_error is stop, warn or skip")

    def run(pdf: pd.DataFrame) -> pd.DataFrame | None:
        try:
            out = f(pdf)
        except Exception:
            if on_error == "stop":
                raise
            if on_error == "warn":
                import warnings

                warnings.warn(f"skipped {pdf[id].iloc[0]!r}", stacklevel=1)
            return None
        if out is not None and not isinstance(out, pd.DataFrame):
            raise TypeError(f"a pandas.DataFrame or None is expected, not {type(out).__name__}")
        return out

    # one batch holds subjects with nulls and without: whole numbers and booleans pass filled, with their nulls beside them
    names, first = rows.columns, _unused("__first", rows.columns)
    of = [(x.name, isinstance(x.dataType, T.BooleanType)) for x in rows.schema.fields if x.nullable and isinstance(x.dataType, (T.IntegralType, T.BooleanType))]
    flags = [_unused(f"__null_{k}", names) for k in range(len(of))]
    start = F.row_number().over(Window.partitionBy(id).orderBy(id)) == 1
    filled = {c: F.coalesce(F.col(c), F.lit(False) if truth else F.lit(0).cast(rows.schema[c].dataType)).alias(c) for c, truth in of}
    marked = rows.withColumn(first, start).select(*[filled.get(c, F.col(c)) for c in names], first, *[F.col(c).isNull().alias(x) for (c, _), x in zip(of, flags, strict=True)])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        outs = map(run, _stretches(batches, names, first, flags, of))
        return _together(x for x in outs if x is not None and len(x))

    return marked.mapInPandas(each, schema)


def group_reduce(mapped: DataFrame, value: str, merge: Callable[[Column, Column], Column], init: Column, order_by: str, run_rows: int = 1024) -> DataFrame:
    """Fold by an associative ``merge``, in the order of ``order_by``.

    Rows are numbered by ranges; runs of ``run_rows`` neighbours are folded to
    one, the results likewise, and so on until one run is left, so that no task
    holds more than runs of that length.
    """
    rows = ordinals(mapped, [order_by], "__at", [value]).select(F.col("__at") - 1, F.col(value)).toDF("__at", "v")
    n = mapped.count()
    while True:
        run = F.floor(F.col("__at") / run_rows)
        part = rows.groupBy(run.alias("__at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "v"))), lambda x: x["v"]).alias("v"))
        n = -(-n // run_rows)
        if n <= 1:
            every = part.agg(F.flatten(F.collect_list("v")).alias("v"))
            return every.select(F.aggregate("v", init, merge).alias(value))
        rows = part.select("__at", F.aggregate(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))), F.element_at("v", 1), merge).alias("v"))
