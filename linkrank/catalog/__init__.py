"""The registered queries, each with the SQL text that checks it."""

from linkrank.catalog.registry import REGISTRY  # noqa: F401
from linkrank.catalog import (  # noqa: F401  (importing a module registers its queries)
    aggregates,
    builds,
    entities,
    filters,
    joins,
    quality,
    readers,
    scalars,
    sorts,
    windows,
)
