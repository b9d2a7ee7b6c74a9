"""Queries over the given tables, with SQL for those that SQL can express."""

from wayrisk.queries import economy, hazards, networks, paths, rules, shapes
from wayrisk.queries.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "economy", "hazards", "networks", "paths", "rules", "shapes"]
