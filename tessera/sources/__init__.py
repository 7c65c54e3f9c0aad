"""Readers of the library's tables."""

from tessera.sources.tables import TABLES, table

__all__ = ["TABLES", "table"]
