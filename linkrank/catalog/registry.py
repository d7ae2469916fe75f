"""Where the query modules put their queries."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from linkrank.plans.gems import Cutoffs
from linkrank.sources.standins import Inputs


class Entry(NamedTuple):
    build: Callable[[Inputs], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}

# The stand-in tracks have 4 to 30 listeners each, so the cutoffs are scaled down.
CUT = Cutoffs(min_listeners=10, min_ratio=24.0, min_songs=5, low_tier=14, high_tier=18, worst_peak=1)


def query(key: str, sql: str | None = None):
    def add(build: Callable[[Inputs], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"{key} registered twice")
        REGISTRY[key] = Entry(build, sql)
        return build

    return add
