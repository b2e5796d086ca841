"""Registers the queries of the core library."""

from tessera.plans import feature_queries, file_queries, geometry_queries, hierarchy_queries, lod_queries, point_queries, raster_queries  # noqa: F401
