"""Fill-in-middle transformation.

A text becomes an array of its code points (UTF-32). Code points have classes,
neighbours of different class bound a unit, and the boundaries are the places
where classes change. Two ranks, chosen by digests, pick two of the
boundaries; what lies before, between and after them is prefix, middle and
suffix. With unit "char" every code point is a unit of its own; "word" makes
runs of letters and digits, of white space and of anything else units; "line"
makes lines, with their line ends, units.

The choices of a row depend on its key and ``seed`` alone: h1 to h4 are the
first four 8-digit groups of the hex SHA-256 of ``seed:key``. With m units the
prefix ends after the smaller of h1 % (m + 1) and h2 % (m + 1), the middle after
the larger. A text stays plain if it is empty, holds one of the marks, or
h3 % 100 >= rate; else it is of form spm if h4 % 100 < spm_rate, psm otherwise.

No piece holds a mark, and one can't arise where a piece meets a mark, as marks
begin with ``<``, end in ``>`` and hold neither inside; so the first mark of each
kind is the one put there, and restore() gives back the exact text.

Defined cases: a null text is an empty one, and plain; a null key counts as an
empty one; rows that repeat a key are cut by the same choices; very long texts
are cut whole; extra columns stay, ones with a result's name are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .words import parts_by_bytes

MARKS = ("<P>", "<S>", "<M>")
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")
_OUT = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
_PART = 4 << 20


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A number for each code point; a unit ends where it changes."""
    if unit == "char":
        return np.arange(len(points))
    if unit == "line":
        return np.cumsum(np.r_[False, points[:-1] == 10]) if len(points) else np.zeros(0, int)
    if unit == "word":
        known, at = np.unique(points, return_inverse=True)
        kind = np.array([1 if c.isalnum() else 2 if c.isspace() else 3 for c in map(chr, known.tolist())], np.int8)
        return kind[at] if len(points) else np.zeros(0, np.int8)
    raise ValueError(f"unknown unit {unit!r}")


def bounds(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin, and the end: m + 1 places for m units."""
    if not len(points):
        return np.zeros(1, np.int64)
    of = classes(points, unit)
    return np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(points)]


def cut_text(text: str, h: tuple[int, int, int, int], unit: str = "char", rate: int = 90, spm_rate: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(code points, form, code points of the prefix and of the middle, output)."""
    points = codepoints(text)
    if not text or h[2] % 100 >= rate or any(m in text for m in MARKS):
        return len(points), "plain", None, None, text
    at = bounds(points, unit)
    a, b = sorted(int(at[x % len(at)]) for x in h[:2])
    prefix, middle, suffix = _text(points[:a]), _text(points[a:b]), _text(points[b:])
    p, s, m = MARKS
    if h[3] % 100 < spm_rate:
        return len(points), "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return len(points), "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restore_text(output: str, form: str) -> str:
    """The text that cut_text() made ``output`` of."""
    if form == "plain":
        return output
    p, s, m = MARKS
    first, second = (p, s) if form == "psm" else (s, p)
    if not output.startswith(first):
        raise ValueError(f"no output of form {form}")
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(m)
    return one + middle + two if form == "psm" else two + middle + one


def choices(key: str | Column, seed: int = 1) -> list[Column]:
    """h1 to h4 of a key."""
    c = F.col(key) if isinstance(key, str) else key
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "char", seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars (null if plain) and output to every row."""
    classes(codepoints("ab"), unit)  # a unit that isn't known is an error here

    @F.arrow_udf("struct<n long, form string, prefix_chars long, middle_chars long, output string>")
    def of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, *h in batches:
            done, at = [], 0
            chosen = list(zip(*(x.to_pylist() for x in h), strict=True))
            for part in parts_by_bytes(texts.cast(pa.string()), _PART):
                rows = [cut_text(t or "", chosen[at + i], unit, rate, spm_rate) for i, t in enumerate(part.to_pylist())]
                done.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], fields=list(_OUT)))
                at += len(part)
            yield pa.concat_arrays(done) if done else pa.array([], _OUT)

    name = fresh("infill", [*docs.columns, *ADDED])
    cut = docs.withColumn(name, of(F.col(text), *choices(key, seed)))
    return cut.withColumns({c: F.col(f"{name}.{c}") for c in ADDED}).drop(name)


def restore(rows: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """Add the text that ``output`` was made of, from output and form alone; null where either is null."""

    @F.arrow_udf("string")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            done, at = [], 0
            kinds = forms.to_pylist()
            for part in parts_by_bytes(outputs.cast(pa.string()), _PART):
                done.append(pa.array([None if t is None or kinds[at + i] is None else restore_text(t, kinds[at + i]) for i, t in enumerate(part.to_pylist())], pa.string()))
                at += len(part)
            yield pa.concat_arrays(done) if done else pa.array([], pa.string())

    return rows.withColumn(out, of(F.col(output), F.col(form)))
