"""Distributed operators on points, clusters, polygons and grids."""
