"""All named queries of the engine: ``QUERIES`` (Spark) and ``ORACLES`` (the same in DuckDB SQL)."""

from __future__ import annotations

from waymark.plans import labels, motion, names, places, reconcile, roads, shapes, territory

QUERIES = {**motion.QUERIES, **names.QUERIES, **reconcile.QUERIES, **places.QUERIES, **shapes.QUERIES, **roads.QUERIES, **territory.QUERIES, **labels.QUERIES}
ORACLES = {**motion.ORACLES, **names.ORACLES, **reconcile.ORACLES, **places.ORACLES, **shapes.ORACLES, **roads.ORACLES, **territory.ORACLES, **labels.ORACLES}
