"""Scalar rules: element types, digests, identifiers, grid indices, bit masks."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Element types, their bytes, and the Spark type that holds them without loss.
DTYPES = {
    "logical": (4, "boolean"),
    "uint8": (1, "smallint"),
    "int8": (1, "tinyint"),
    "uint16": (2, "int"),
    "int16": (2, "smallint"),
    "float16": (2, "float"),
    "bfloat16": (2, "float"),
    "uint32": (4, "bigint"),
    "int32": (4, "int"),
    "float32": (4, "float"),
    "uint64": (8, "decimal(20,0)"),
    "int64": (8, "bigint"),
    "float64": (8, "double"),
    "complex64": (8, "struct<re:float,im:float>"),
    "complex128": (16, "struct<re:double,im:double>"),
}


def dtype_bytes(dtype: str) -> int:
    if dtype not in DTYPES:
        raise ValueError(f"unknown element type {dtype!r}")
    return DTYPES[dtype][0]


def _plain(x: object) -> object:
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return {f.name: _plain(getattr(x, f.name)) for f in dataclasses.fields(x) if f.metadata.get("identity", True)}
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in sorted(x.items(), key=lambda kv: str(kv[0]))}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if x is None or isinstance(x, (str, int, float, bool)):
        return x
    raise TypeError(f"{type(x).__name__} has no canonical form")


def canonical_json(x: object) -> str:
    return json.dumps(_plain(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_digest(x: object) -> str:
    """SHA-256 of the canonical JSON: equal content, equal digest."""
    return hashlib.sha256(canonical_json(x).encode()).hexdigest()


def row_digest(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def linear_index(i: Column, j: Column, k: Column, dim: Sequence[int]) -> Column:
    """1-based position in a grid whose first axis varies fastest."""
    return i + (j - 1) * dim[0] + (k - 1) * dim[0] * dim[1]


def grid_index(linear: Column, dim: Sequence[int]) -> list[Column]:
    """1-based (i, j, k) of a linear index."""
    z = (linear - 1).cast("long")
    return [
        (z % dim[0] + 1).cast("int").alias("i"),
        (F.floor(z / dim[0]) % dim[1] + 1).cast("int").alias("j"),
        (F.floor(z / (dim[0] * dim[1])) + 1).cast("int").alias("k"),
    ]


def propagating_sum(value: Column, weight: Column | None = None) -> Column:
    """Sum that is null if any value is, unlike SQL's."""
    x = value if weight is None else value * weight
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(x))


def pack_bits(flags: Sequence[bool]) -> bytes:
    out = bytearray(math.ceil(len(flags) / 8))
    for n, f in enumerate(flags):
        if f:
            out[n >> 3] |= 1 << (n & 7)
    return bytes(out)


def unpack_bits(data: bytes, n: int) -> list[bool]:
    return [bool(data[i >> 3] >> (i & 7) & 1) for i in range(n)]


def exact_pattern(value: str) -> str:
    return f"^{re.escape(value)}$"


def relative_path(path: str, root: str) -> str:
    """``path`` below ``root``, with forward slashes; a path outside is an error."""
    import posixpath

    rel = posixpath.relpath(posixpath.normpath(path.replace("\\", "/")), posixpath.normpath(root.replace("\\", "/")))
    if rel == ".." or rel.startswith("../"):
        raise ValueError(f"{path} is not below {root}")
    return rel
