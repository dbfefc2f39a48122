"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from tessella.plans import files, rasters, shapes, stores, tiles, warps

FLAGSHIP = "fusion_confusion"
QUERIES = tiles.QUERIES | rasters.QUERIES | files.QUERIES | shapes.QUERIES | warps.QUERIES | stores.QUERIES
ORACLE_SQL: dict[str, str] = tiles.ORACLE_SQL | rasters.ORACLE_SQL | files.ORACLE_SQL | shapes.ORACLE_SQL | warps.ORACLE_SQL | stores.ORACLE_SQL | {"vectorize_regions": files.REGIONS_SQL}
