"""A cache of reads: persisted tables by name, the least lately used of which go when their bytes exceed a bound."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

_UNITS = ("B", "KB", "MB", "GB")


def readable(n: float) -> str:
    k = min(len(_UNITS) - 1, int(math.log(n, 1024))) if n >= 1 else 0
    return f"{n / 1024**k:.1f} {_UNITS[k]}"


def persisted_bytes(df: DataFrame) -> int:
    """Bytes of a table that is persisted and was read once, as Spark counted them."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


class ReadCache:
    """Reads that were made once, on the executors' memory and disks. A table larger than the bound is given, not kept."""

    def __init__(self, max_bytes: int = 512 << 20) -> None:
        self._check(max_bytes)
        self.max_bytes, self.hits, self.misses, self.evicted = max_bytes, 0, 0, 0
        self._held: OrderedDict[str, tuple[DataFrame, int]] = OrderedDict()

    @staticmethod
    def _check(n: int) -> None:
        if isinstance(n, bool) or not isinstance(n, (int, float)) or not n > 0:
            raise ValueError("the bound is a positive number of bytes")

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table kept under ``key``, or the one that ``make`` gives, read once and kept."""
        if key in self._held:
            self.hits += 1
            self._held.move_to_end(key)
            return self._held[key][0]
        self.misses += 1
        df = make().persist(StorageLevel.MEMORY_AND_DISK)
        df.count()
        size = persisted_bytes(df)
        if size > self.max_bytes:
            df.unpersist()
            return make()
        self._held[key] = (df, size)
        self._shrink()
        return df

    def _shrink(self) -> None:
        while self.current_bytes > self.max_bytes:
            _, (df, _) = self._held.popitem(last=False)
            df.unpersist()
            self.evicted += 1

    @property
    def current_bytes(self) -> int:
        return sum(n for _, n in self._held.values())

    def keys(self) -> list[str]:
        """Least lately used first."""
        return list(self._held)

    def drop(self, key: str) -> bool:
        if key not in self._held:
            return False
        self._held.pop(key)[0].unpersist()
        return True

    def clear(self) -> None:
        for key in self.keys():
            self.drop(key)

    def resize(self, max_bytes: int) -> None:
        """A new bound, at once."""
        self._check(max_bytes)
        self.max_bytes = max_bytes
        self._shrink()

    def info(self) -> dict[str, object]:
        asked = self.hits + self.misses
        return {
            "max_size": readable(self.max_bytes), "current_size": readable(self.current_bytes), "n_objects": len(self._held), "eviction_policy": "lru", "hits": self.hits, "misses": self.misses,
            "hit_rate": self.hits / asked if asked else None, "evicted": self.evicted, "utilization_pct": round(100 * self.current_bytes / self.max_bytes, 1),
        }


#: The cache that a session shares unless it makes its own.
SHARED = ReadCache()
