"""Periodic run detection by Karp-Miller-Rosenberg naming.

A run is a stretch of consecutive words with smallest period q, at least
``least`` words and ``times`` periods long, that no neighbouring word extends
keeping period q.

Words get numbers; the names of level k tell the stretches of 2^k words apart:
a stretch is named after the pair of names of its halves, by sorting the pairs.
Naming ends at the first level on which all names differ, as no longer stretch
occurs twice. Two places are compared by descending levels: where the names of
a level agree, both move on by its length. That gives the longest common
extension, to either side.

A run of period q and length n holds n - q consecutive places whose word is
that of the place q later, at least w = max(least - q, (times - 1) * q). With
2^k <= (w + 1) / 2, these cover a whole cell of the grid of multiples of 2^k; so
for every q, the names of level k at the grid's places are compared with the
names q later, all periods of a level at once, as strided views. The first of
consecutive cells that agree is a candidate, extended to both sides. Of
stretches alike in start and end, the smallest period stays. That takes O(n log n)
comparisons for n words and O(n log n) small numbers of memory for the text at
hand.

Words are ``[^\\x20\\x09-\\x0D]+``.

Defined cases: a null, empty or blank text has no word and no run; very long
texts are taken whole; runs of different periods may overlap and all count;
rows that repeat are taken each by itself; extra columns stay, ones with a
result's name are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .words import parts_by_bytes

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_PART = 2 << 20
_CELLS = 1 << 20  # compared at once


def named(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Names from 0 in the order of the codes, and how many there are."""
    known, names = np.unique(codes, return_inverse=True)
    return names.astype(np.int32), len(known)


def levels(words: np.ndarray, least_level: int) -> list[np.ndarray]:
    """Names of level 0, 1, ..., up to the last on which two are alike; empty if none of ``least_level`` are."""
    names, n = named(words)
    out = []
    while n < len(names):
        out.append(names)
        half = 1 << len(out) - 1
        if len(names) <= half:
            break
        names, n = named(names[:-half].astype(np.int64) * n + names[half:])
    return out if len(out) > least_level else []


def extended(names: list[np.ndarray], i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of the stretch around i whose words are those q later, and the place after its last; i is in it."""
    first, end = i.copy(), i.copy()
    for k in range(len(names) - 1, -1, -1):
        at, size = names[k], 1 << k
        ok = np.flatnonzero(end + q < len(at))
        ok = ok[at[end[ok]] == at[end[ok] + q[ok]]]
        end[ok] += size
        ok = np.flatnonzero(first >= size)
        ok = ok[at[first[ok] - size] == at[first[ok] - size + q[ok]]]
        first[ok] -= size
    return first, end


def _candidates(names: np.ndarray, level: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the first of consecutive cells of 2^level words that recur q later, for q from low to high."""
    size = 1 << level
    rows = -(-len(names) // size)
    for a in range(low, high + 1, step := max(1, _CELLS // rows)):
        z = min(high, a + step - 1)
        # a period's last cells, beyond the names, meet names of none
        padded = np.concatenate([names, np.full(z + size, -1, np.int32)])
        later = np.lib.stride_tricks.as_strided(padded[a:], (rows, z - a + 1), (padded.strides[0] * size, padded.strides[0]))
        same = later == names[::size, None]
        same[1:] &= ~same[:-1]
        cell, q = np.nonzero(same)
        yield cell * size, q + a


def _levels_of(q: np.ndarray, least: int, times: int) -> np.ndarray:
    """The level whose cells every run of each period covers one of."""
    return np.floor(np.log2((np.maximum(least - q, (times - 1) * q) + 1) / 2)).astype(int)


@cache
def _lowest(least: int, times: int) -> int:
    return int(_levels_of(np.arange(1, least + 1), least, times).min())


def find_runs(words: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of numbers, by start, then period."""
    none = np.zeros((0, 3), np.int64)
    n = len(words)
    if n < least:
        return none
    names = levels(words, _lowest(least, times))
    if not names:
        return none
    level_of = _levels_of(np.arange(1, n // times + 1), least, times)
    found = []
    for k in range(len(names)):
        of = np.flatnonzero(level_of == k) + 1
        for low, high in _stretches(of):
            for i, q in _candidates(names[k], k, low, high):
                if len(i):
                    first, end = extended(names, i, q)
                    rows = np.stack([first, end - first + q, q], axis=1)
                    found.append(np.unique(rows[rows[:, 1] >= np.maximum(least, times * q)], axis=0))
    rows = np.concatenate([none, *found])
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)  # a multiple of the period
    rows = rows[np.concatenate([np.ones(min(1, len(rows)), bool), ~same])]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of consecutive numbers."""
    if not len(x):
        return []
    cuts = np.flatnonzero(np.diff(x) > 1)
    return list(zip([int(x[0]), *x[cuts + 1].tolist()], [*x[cuts].tolist(), int(x[-1])], strict=True))


def strongest(runs: np.ndarray) -> int:
    """Which run has the greatest exact length / period; of equal ones the smallest start, then period."""
    best = 0
    for k in range(1, len(runs)):
        (_, a, p), (_, b, q) = runs[best].tolist(), runs[k].tolist()
        if b * p > a * q:
            best = k
    return best


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """False for each word that a run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at exactly these six


def word_numbers(words: list[bytes]) -> np.ndarray:
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()


def find(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """Add ``n_words``, ``runs`` (start, length, period, by start, then period), ``strongest`` (null without runs) and ``collapsed``: each run's first period and all words outside runs, joined by one space."""
    if least < 1 or times < 2:
        raise ValueError("runs have at least one word and two periods")
    run = "struct<start long, length long, period long>"
    out = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("strongest", _RUN), ("collapsed", pa.string())])

    def row(text: str | None) -> tuple[int, np.ndarray, dict | None, str]:
        words = split_words(text)
        runs = find_runs(word_numbers(words), least, times)
        if not len(runs):
            return len(words), runs, None, b" ".join(words).decode()
        kept = np.flatnonzero(kept_words(len(words), runs)).tolist()
        best = dict(zip(_RUN.names, runs[strongest(runs)].tolist(), strict=True))
        return len(words), runs, best, b" ".join([words[i] for i in kept]).decode()

    def of_part(texts: pa.Array) -> pa.Array:
        n, runs, best, collapsed = zip(*map(row, texts.to_pylist()), strict=True)
        ends = pa.array(np.cumsum([0, *map(len, runs)]).astype(np.int32))
        items = pa.StructArray.from_arrays([pa.array(c) for c in np.concatenate(runs).T], fields=list(_RUN))
        columns = [pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, items), pa.array(best, _RUN), pa.array(collapsed, pa.string())]
        return pa.StructArray.from_arrays(columns, fields=list(out))

    @F.arrow_udf(f"struct<n_words long, runs array<{run}>, strongest {run}, collapsed string>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            done = [of_part(x) for x in parts_by_bytes(texts.cast(pa.string()), _PART)]
            yield pa.concat_arrays(done) if done else pa.array([], out)

    name = fresh("periods", [*docs.columns, *out.names])
    return docs.withColumn(name, of(F.col(text))).withColumns({c: F.col(f"{name}.{c}") for c in out.names}).drop(name)
