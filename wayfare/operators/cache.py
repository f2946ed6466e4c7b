"""Results by canonical key for a limited time: a driver-side table of plans, whose blocks Spark holds on the executors."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame

#: Seconds to live, entries, and the share of the oldest that goes when the table is full.
TTL, CAPACITY, SHARE = 300.0, 10_000, 0.1


class ResultCache:
    """Persisted results; one that has expired is dropped when it is asked for, the oldest tenth when there is no room."""

    def __init__(self, ttl: float = TTL, capacity: int = CAPACITY, clock: Callable[[], float] = time.monotonic) -> None:
        self.ttl, self.capacity, self.clock = ttl, capacity, clock
        self.entries: OrderedDict[str, tuple[float, DataFrame]] = OrderedDict()
        self.hits = self.misses = self.evicted = 0

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        found = self.entries.get(key)
        if found and self.clock() - found[0] <= self.ttl:
            self.hits += 1
            return found[1]
        self.misses += 1
        if found:
            self._drop(key)
        if len(self.entries) >= self.capacity:
            for old in list(self.entries)[: max(1, int(self.capacity * SHARE))]:
                self._drop(old)
                self.evicted += 1
        self.entries[key] = (self.clock(), made := make().persist())
        return made

    def _drop(self, key: str) -> None:
        self.entries.pop(key)[1].unpersist()

    def sweep(self) -> int:
        """Drops what has expired; how many that were."""
        now = self.clock()
        gone = [k for k, (at, _) in self.entries.items() if now - at > self.ttl]
        for k in gone:
            self._drop(k)
        return len(gone)

    def clear(self) -> None:
        for k in list(self.entries):
            self._drop(k)

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"entries": len(self.entries), "capacity": self.capacity, "hits": self.hits, "misses": self.misses, "evicted": self.evicted, "hit_rate": self.hits / asked if asked else 0.0}
