"""Registered queries over the star schema and the event stream."""

from tessera.plans.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
