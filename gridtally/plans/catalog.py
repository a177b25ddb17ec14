"""All registered queries; importing the parts fills the registry."""

from gridtally.plans import (  # noqa: F401
    catalog_joins,
    catalog_keys,
    catalog_quality,
    catalog_rollups,
    catalog_sources,
    catalog_spatial,
    catalog_stats,
)
from gridtally.plans.registry import ORACLE, QUERIES  # noqa: F401
