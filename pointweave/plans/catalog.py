"""All queries of the engine."""

from __future__ import annotations

from pointweave.plans import catalog_codebook, catalog_fusion, catalog_general, catalog_observe, catalog_query, catalog_source, catalog_track, catalog_vec, catalog_views
from pointweave.plans.registry import CATALOG

MODULES = (catalog_vec, catalog_observe, catalog_codebook, catalog_query, catalog_track, catalog_general, catalog_fusion, catalog_source, catalog_views)


def queries():
    return dict(CATALOG.run)


def oracle_sql():
    return dict(CATALOG.sql)
