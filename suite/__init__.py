"""Queries over the given tables, with the SQL each of them is checked against."""

from suite import catalog, governance, lineage, warehouse

MODULES = [warehouse, catalog, lineage, governance]
