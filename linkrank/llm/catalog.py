"""All queries of this subpackage."""

from __future__ import annotations

from linkrank.llm import (  # noqa: F401  they register their queries
    bytes_dedup,
    chat,
    codes,
    leaks,
    neardup,
    packing,
    pages,
    prefixes,
    private,
    quality,
    ranked,
    simhash,
    substrings,
)
from linkrank.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
