"""Operators for preparing training text at scale: filtering, deduplication, scoring, search, packing.

Each module holds one operator with its own general interface; :mod:`ledgerloom.llm.queries` registers the
thin queries over the given tables. Nothing else in the library imports this subpackage.
"""
